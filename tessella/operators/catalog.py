"""Packs and trees: catalog search, imported flags, directory trees, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_packs(packs: DataFrame, query: str | None, name: str = "name", description: str = "description", tags: str = "tags") -> DataFrame:
    """Packs with the text in their name, description or a tag, in any case; all packs for a blank one."""
    q = (query or "").strip().lower()
    if not q:
        return packs
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    return packs.filter(has(F.col(name)) | has(F.col(description)) | F.coalesce(F.exists(F.col(tags), lambda x: F.lower(x).contains(q)), F.lit(False)))


def with_imported(packs: DataFrame, files: DataFrame, pack: str = "pack_id") -> DataFrame:
    """packs with imported: whether any file is in its folder."""
    have = files.select(F.col(pack).alias("_p")).distinct()
    return packs.join(have, packs[pack].eqNullSafe(have["_p"]), "left").select(*[packs[c] for c in packs.columns], F.col("_p").isNotNull().alias("imported"))


def pack_files_to_import(wanted: DataFrame, files: DataFrame, pack: str = "pack_id") -> DataFrame:
    """The files of the packs that aren't imported yet; a pack with files of its own is skipped whole."""
    return wanted.join(files.select(pack).distinct(), pack, "left_anti")


def tree(paths: DataFrame, path: str = "file_path") -> DataFrame:
    """Distinct nodes of the paths: node_path, parent, name, depth (from 1), type (directory or file).

    A path makes a node for each of its prefixes; a node that is also a longer path's prefix is a directory.
    """
    parts = paths.select(F.filter(F.split(F.col(path), "/"), lambda x: x != "").alias("p")).filter("size(p) > 0")
    nodes = parts.select(F.explode(F.expr("transform(sequence(1, size(p)), i -> struct(slice(p, 1, i) as at, i < size(p) as inner))")).alias("n"))
    once = nodes.groupBy(F.array_join("n.at", "/").alias("node_path"), F.size("n.at").alias("depth")).agg(F.max("n.inner").alias("_d"))
    name = F.substring_index("node_path", "/", -1)
    return once.select("node_path", F.when(F.col("depth") > 1, F.expr("left(node_path, length(node_path) - length(substring_index(node_path, '/', -1)) - 1)")).otherwise("").alias("parent"), name.alias("name"), "depth", F.when(F.col("_d"), "directory").otherwise("file").alias("type"))


def tree_order() -> list[Column]:
    """Siblings in the order of a listing: directories first, then by name in any case."""
    return [F.col("parent"), (F.col("type") != "directory"), F.lower("name"), F.col("name")]


def files_of(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'file'")


def progress(processed: Column, total: Column) -> Column:
    """Percent done, rounded half up; 0 of nothing."""
    return F.when(total > 0, F.floor(processed.cast("double") / total * 100 + 0.5).cast("long")).otherwise(F.lit(0).cast("long"))
