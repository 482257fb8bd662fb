from pyspark.sql import functions as F

from tessella.operators import positions
from tessella.sources import sinks


def test_positions_equal_a_window(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 211).alias("a"), F.col("id").alias("b")).repartition(7)
    got = positions.numbered(df, ["a", "b"], "place", 5)
    want = sorted((r.a, r.b) for r in df.collect())
    assert sorted((r.place, r.a, r.b) for r in got.collect()) == [(i + 5, *x) for i, x in enumerate(want)]
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert positions.numbered(df.limit(0), ["a"]).count() == 0


def test_ids_of_answers_rise(spark, tmp_path):
    path, now = str(tmp_path / "chat"), F.to_timestamp(F.lit("2024-05-01 00:00:00"))
    say = lambda *ids: spark.createDataFrame([(i, f"q{i}", f"a{i}" if i else "", ["f"]) for i in ids], "query_id long, question string, answer string, sources array<string>")
    for ids in ((0, 1), (0, 1), (7,), (7, 0)):
        sinks.write_answers(say(*ids), path, now)
    got = [r.id for r in spark.read.parquet(path).orderBy("id").collect()]
    assert len(got) == len(set(got)) == 11 and got[:3] == [0, 2, 3]
    last = spark.read.parquet(path).orderBy(F.desc("id")).limit(3).collect()
    assert [(r.role, r.content) for r in last] == [("assistant", "a7"), ("user", "q7"), ("user", "q0")]
