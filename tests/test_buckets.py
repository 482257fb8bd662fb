import threading

import pytest
from pyspark.sql import functions as F

from tessella.sources import buckets


def rows(df):
    return sorted((r.file_path or "", r.n) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    buckets.create(spark.range(2000).select(F.concat(F.lit("f"), "id").alias("file_path"), F.col("id").alias("n")), path, "file_path", 40)
    return path


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def test_a_change_rewrites_what_it_touches(spark, table):
    first = rows(buckets.read(spark, table))
    assert len(first) == 2000
    up = lambda df: df.withColumn("n", F.when(F.col("file_path") == "f7", 70).otherwise(F.col("n"))).filter("file_path <> 'f8'").unionByName(spark.createDataFrame([("new", 1)], "file_path string, n long"))
    assert buckets.change(spark, table, keys(spark, "f7", "f8", "new"), up) == 1
    assert rows(buckets.read(spark, table)) == sorted([(p, 70 if p == "f7" else n) for p, n in first if p != "f8"] + [("new", 1)])
    assert rows(buckets.read(spark, table, 0)) == first
    told = {r.version: r for r in buckets.history(spark, table).collect()}
    assert told[1].n_touched <= 3 and told[1].n_bytes < told[0].n_bytes / 8
    assert buckets.change(spark, table, keys(spark), lambda df: df) == 1  # nothing touched, no version
    assert buckets.change(spark, table, keys(spark, *[f"f{i}" for i in range(2000)]), lambda df: df.limit(0)) == 2
    assert rows(buckets.read(spark, table)) == []
    assert buckets.tidy(spark, table) >= 1 and buckets.versions(spark, table) == [2]


def test_a_lost_writer_leaves_nothing_to_see(spark, table):
    def fails(df):
        return df.withColumn("n", F.when(F.col("n") >= 0, F.raise_error(F.lit("lost")).cast("long")))

    before = rows(buckets.read(spark, table))
    with pytest.raises(Exception, match="lost"):
        buckets.change(spark, table, keys(spark, "f1"), fails)
    with pytest.raises(Exception, match="outside"):
        buckets.change(spark, table, keys(spark, "f1"), lambda df: buckets.read(spark, table))
    assert buckets.versions(spark, table) == [0] and rows(buckets.read(spark, table)) == before
    buckets.tidy(spark, table)
    assert rows(buckets.read(spark, table)) == before


def test_changes_at_once(spark, table):
    """Changes of the same and of different buckets: none is lost."""
    plus = lambda name: lambda df: df.withColumn("n", F.when(F.col("file_path") == name, F.col("n") + 1000).otherwise(F.col("n")))
    names, failed = ["f1", "f1", "f2", "f3"], []

    def run(name):
        try:
            buckets.change(spark, table, keys(spark, name), plus(name))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=(n,)) for n in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = dict(rows(buckets.read(spark, table)))
    assert not failed and (found["f1"], found["f2"], found["f3"]) == (2001, 1002, 1003) and buckets.versions(spark, table) == [0, 1, 2, 3, 4]


def test_empty_tables_and_null_keys(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    buckets.create(spark.createDataFrame([], "file_path string, n long"), path, "file_path")
    assert buckets.read(spark, path).count() == 0
    buckets.change(spark, path, keys(spark, None), lambda df: df.unionByName(spark.createDataFrame([(None, 5)], "file_path string, n long")))
    assert rows(buckets.read(spark, path)) == [("", 5)]
    with pytest.raises(ValueError, match="already"):
        buckets.create(spark.createDataFrame([], "file_path string, n long"), path, "file_path")


def test_sync_of_stored_tables(spark, tmp_path):
    """As sync() over whole tables, and only the buckets of changed files are written."""
    from tessella.operators import sync
    from tessella.schemas import CHUNKS, DOCUMENTS, conform

    now = F.to_timestamp(F.lit("2024-02-01"))
    part = F.concat(F.lit("# Head\n\n"), F.repeat(F.concat(F.lit("Some words of file "), "id", F.lit(". ")), 90), F.lit("\n\n## Next\n\n"), F.repeat(F.lit("More words here. "), 20))
    disk = spark.range(300).select(F.concat(F.lit("a/"), "id", F.lit(".md")).alias("file_path"), F.concat("id", F.lit(".md")).alias("file_name"), part.alias("text"))
    disk = disk.withColumns({"file_size": F.octet_length("text").cast("long"), "file_hash": F.sha2("text", 256), "modified_at": now, "error": F.lit(None).cast("string")})
    none = lambda schema: spark.createDataFrame([], schema)
    paths = [f"file://{tmp_path}/{n}" for n in ("documents", "chunks")]
    buckets.create(none(DOCUMENTS), paths[0], "file_path", 50)
    buckets.create(none(CHUNKS), paths[1], "file_path", 50)
    assert sync.sync_stored(disk, *paths, now) == {"new": 300, "modified": 0, "deleted": 0}
    edited = F.col("file_path") == "a/7.md"
    later = disk.filter("file_path <> 'a/9.md'").withColumn("text", F.when(edited, F.concat("text", F.lit(" and more"))).otherwise(F.col("text"))).withColumn("file_hash", F.sha2("text", 256))
    whole = sync.sync(later, buckets.read(spark, paths[0]), buckets.read(spark, paths[1]), now)
    want = [sorted(map(str, conform(whole[n], s).collect())) for n, s in (("documents", DOCUMENTS), ("chunks", CHUNKS))]
    assert sync.sync_stored(later, *paths, now) == {"new": 0, "modified": 1, "deleted": 1}
    assert [sorted(map(str, buckets.read(spark, p).collect())) for p in paths] == want
    assert all(r.n_touched <= 2 for p in paths for r in buckets.history(spark, p).filter("version = 2").collect())
    assert buckets.read(spark, paths[1]).groupBy("file_path").count().agg(F.min("count")).first()[0] > 2
    assert sync.sync_stored(later, *paths, now) == {"new": 0, "modified": 0, "deleted": 0} and buckets.versions(spark, paths[0]) == [0, 1, 2]
