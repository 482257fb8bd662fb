"""One ZIP archive made by many tasks.

Each task deflates its files; the files' places in the archive are sums of sizes over ranges of paths, so no task sees all
of them; a file's local header and its line of the central directory are then made where it is, and the end record from the
totals. The archive comes as pieces in order: who stores or sends it puts them one behind the other. Sizes and places
beyond 4 GB, and more than 65,535 files, get the 64-bit fields of the format.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.files import is_safe
from tessella.sources.workspace import written

# Fixed values of the format: the day 1980-01-01, UTF-8 names, deflate, versions, and what stands for a 64-bit value.
_DAY, _FLAGS, _DEFLATE, _VERSION, _VERSION64, _FAR, _MANY = 0x21, 0x800, 8, 20, 45, 0xFFFFFFFF, 0xFFFF


def _extra(*values: int) -> bytes:
    """The 64-bit fields of those values that don't fit."""
    far = [v for v in values if v >= _FAR]
    return struct.pack(f"<HH{len(far)}Q", 1, 8 * len(far), *far) if far else b""


def local_header(name: bytes, crc: int, packed: int, size: int) -> bytes:
    far = max(packed, size) >= _FAR
    extra = struct.pack("<HHQQ", 1, 16, size, packed) if far else b""  # here both or none
    sizes = (_FAR, _FAR) if far else (packed, size)
    return struct.pack("<IHHHHHIIIHH", 0x04034B50, _VERSION64 if far else _VERSION, _FLAGS, _DEFLATE, 0, _DAY, crc, *sizes, len(name), len(extra)) + name + extra


def central_entry(name: bytes, crc: int, packed: int, size: int, place: int) -> bytes:
    extra, cut = _extra(size, packed, place), lambda v: min(v, _FAR)
    version = _VERSION64 if extra else _VERSION
    return struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, version, version, _FLAGS, _DEFLATE, 0, _DAY, crc, cut(packed), cut(size), len(name), len(extra), 0, 0, 0, 0, cut(place)) + name + extra


def end_records(n: int, size: int, place: int) -> bytes:
    """The end of an archive of n files whose central directory has this size and place."""
    out = b""
    if n >= _MANY or size >= _FAR or place >= _FAR:
        out = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, _VERSION64, _VERSION64, 0, 0, n, n, size, place) + struct.pack("<IIQI", 0x07064B50, 0, place + size, 1)
    return out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, _MANY), min(n, _MANY), min(size, _FAR), min(place, _FAR), 0)


def placed(members: DataFrame, start: int = 0, size: str = "length") -> DataFrame:
    """members (file_path and a size) with place: the sum of the sizes before, from start, in the order of the paths."""
    held = written(members.repartitionByRange("file_path").sortWithinPartitions("file_path").withColumn("_range", F.spark_partition_id()), "members")
    sums = sorted((r[0], r[1]) for r in held.groupBy("_range").agg(F.sum(size)).collect())  # a row a partition
    firsts = list(zip([r for r, _ in sums], accumulate([start, *(n for _, n in sums[:-1])]), strict=True)) if sums else []
    offsets = members.sparkSession.createDataFrame(firsts, "_range int, _first long")
    before = F.sum(size).over(Window.partitionBy("_range").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1))
    return held.join(F.broadcast(offsets), "_range").withColumn("place", F.col("_first") + F.coalesce(before, F.lit(0))).drop("_range", "_first")


def one_archive(files: DataFrame) -> DataFrame:
    """section, place and piece: the archive of files (file_path, content; each path once) in the order of section and place.
    An unsafe path is an error."""
    ok = F.when(is_safe(F.col("file_path")), F.col("file_path")).otherwise(F.raise_error(F.concat(F.lit("unsafe path "), F.col("file_path"))).cast("string"))
    rows = files.select(ok.alias("file_path"), F.coalesce(F.col("content").cast("binary"), F.lit("").cast("binary")).alias("content"))

    def deflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["file_path"], pdf["content"], strict=True):
                z = zlib.compressobj(wbits=-15)
                data, name, raw = z.compress(content) + z.flush(), path.encode(), bytes(content)
                head = local_header(name, zlib.crc32(raw), len(data), len(raw))
                out.append((path, zlib.crc32(raw), len(data), len(raw), head + data, len(head) + len(data)))
            yield pd.DataFrame(out, columns=["file_path", "crc", "packed", "size", "piece", "length"])

    local = placed(rows.mapInPandas(deflate, "file_path string, crc long, packed long, size long, piece binary, length long"))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [central_entry(p.encode(), c, k, n, at) for p, c, k, n, at in zip(pdf["file_path"], pdf["crc"], pdf["packed"], pdf["size"], pdf["place"], strict=True)]
            yield pd.DataFrame({"file_path": pdf["file_path"], "piece": made, "length": [len(x) for x in made]})

    body = int(local.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])
    central = placed(local.select("file_path", "crc", "packed", "size", "place").mapInPandas(entries, "file_path string, piece binary, length long"), body)
    n, size = central.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    end = files.sparkSession.createDataFrame([(2, body + int(size), bytearray(end_records(int(n), int(size), body)))], "section int, place long, piece binary")
    part = lambda df, section: df.select(F.lit(section).alias("section"), "place", "piece")
    return part(local, 0).unionByName(part(central, 1)).unionByName(end)
