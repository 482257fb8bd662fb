"""Stored tables that change a few files at a time, each change a version.

A table is a folder: data has Parquet files in folders by bucket, a hash of the key column; versions has a small file for
each version that names, for every bucket, the folder which holds it. A change reads the buckets of the keys it touches,
writes those anew into a folder of its own, and then puts down the next version's file by a rename that fails where that
file is there already. So readers see one version whole, what is rewritten follows the change and not the table, and a
writer that is lost leaves a folder which no version names. Of two changes at once the second is put on top of the first
where they touch different buckets, and made again on the new rows where they don't.

Defined results: a null key is a bucket like any other; keys that aren't stored may be touched, which adds rows; rows
must stay in the buckets that are touched (a row elsewhere is an error); a table may be empty, and so may a change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Times that a change is made again because another one was faster.
TRIES = 5


class Conflict(Exception):
    """Another change of the same buckets came first, TRIES times."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))
    return place, place().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions, ascending."""
    place, fs = _files(spark, path)
    return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(place("versions")) if x.getPath().getName().endswith(".json"))


def _told(spark: SparkSession, path: str, version: int) -> dict:
    place, fs = _files(spark, path)
    stream = fs.open(place("versions", f"{version:012d}.json"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _tell(spark: SparkSession, path: str, version: int, told: dict) -> bool:
    """Puts down a version's file; False where it is there."""
    place, fs = _files(spark, path)
    jvm, draft = spark.sparkContext._jvm, place("versions", f"{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(json.dumps(told).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, place("versions", f"{version:012d}.json"), none)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, key: str, buckets: int) -> tuple[str, list[int], int]:
    """A new folder of files by bucket: its name, its buckets, its bytes. Large buckets get several files."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.withColumn("_bucket", _bucket(key, buckets)).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{path}/data/{name}")
    place, fs = _files(spark, path)
    have = [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(place("data", name)) if x.isDirectory() and x.getPath().getName().startswith("_bucket=")]
    return name, have, fs.getContentSummary(place("data", name)).getLength()


def create(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """The table's first version, 0, with the rows of df. The path must be new."""
    name, have, size = _write(df, path, key, buckets)
    told = {"key": key, "buckets": buckets, "schema": df.schema.json(), "folders": {str(b): name for b in have}, "touched": have, "bytes": size}
    if not _tell(df.sparkSession, path, 0, told):
        raise ValueError(f"{path} has a table already")
    return 0


def _rows(spark: SparkSession, path: str, told: dict, only: set | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(told["schema"]))
    parts = [f"{path}/data/{name}/_bucket={b}" for b, name in told["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last by default."""
    return _rows(spark, path, _told(spark, path, versions(spark, path)[-1] if version is None else version))


def change(spark: SparkSession, path: str, touched: DataFrame, rows: Callable[[DataFrame], DataFrame]) -> int:
    """Makes a version in which the buckets of the touched keys (a column named as the key) hold rows(what they held).

    rows gets whole buckets, so it has to keep what it doesn't change. Gives the version's number; nothing is written
    where nothing is touched."""
    told = _told(spark, path, versions(spark, path)[0])
    key, buckets, schema = told["key"], told["buckets"], StructType.fromJson(json.loads(told["schema"]))
    wanted = {r[0] for r in touched.select(_bucket(key, buckets).alias("b")).distinct().collect()}  # of so many buckets
    if not wanted:
        return versions(spark, path)[-1]
    for _ in range(TRIES):
        base = versions(spark, path)[-1]
        told = _told(spark, path, base)
        inside = F.when(_bucket(key, buckets).isin(sorted(wanted)), F.col(f"`{key}`")).otherwise(F.raise_error(F.lit("a row lies outside the touched buckets")).cast(schema[key].dataType))
        new = rows(_rows(spark, path, told, wanted)).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]).withColumn(key, inside)
        name, have, size = _write(new, path, key, buckets)
        now = base
        while True:
            folders = {b: x for b, x in told["folders"].items() if int(b) not in wanted} | {str(b): name for b in have}
            if _tell(spark, path, now + 1, told | {"folders": folders, "touched": sorted(wanted), "bytes": size}):
                return now + 1
            now += 1  # another change was faster
            told = _told(spark, path, now)
            if wanted & set(told["touched"]):
                break
    raise Conflict(f"{TRIES} changes of the same buckets came first")


def history(spark: SparkSession, path: str) -> DataFrame:
    """version, n_touched (buckets) and n_bytes (written) of each version."""
    told = [(v, _told(spark, path, v)) for v in versions(spark, path)]
    return spark.createDataFrame([(v, len(t["touched"]), t["bytes"]) for v, t in told], "version long, n_touched long, n_bytes long")


def tidy(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drops all but the last versions and the folders that none of these names: not while others write. Gives how many folders went."""
    place, fs = _files(spark, path)
    have = versions(spark, path)
    used = {name for v in have[-keep:] for name in _told(spark, path, v)["folders"].values()}
    for v in have[:-keep]:
        fs.delete(place("versions", f"{v:012d}.json"), False)
    gone = [x.getPath() for x in fs.listStatus(place("data")) if x.getPath().getName() not in used]
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)
