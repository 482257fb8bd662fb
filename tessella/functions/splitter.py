"""Recursive text splitting into overlapping chunks, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

SIZE, OVERLAP = 1000, 200
# Tried in this order.
SEPARATORS = ("\n\n", "\n", " ", "")
#: Characters of chunks that are Python strings at once.
HELD = 1 << 20


def _pieces(text: str, separator: str) -> list[str]:
    """The text cut before each separator, which stays with what follows."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [p for p in (head, *(separator + t for t in tail)) if p]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, held, total = [], [], 0
    for p in pieces:
        if held and total + len(p) > size:
            if whole := "".join(held).strip():
                out.append(whole)
            while total > overlap or (total and total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if whole := "".join(held).strip():
        out.append(whole)
    return out


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: tuple = SEPARATORS) -> list[str]:
    """Chunks of at most size characters, by the first separator that occurs; longer pieces go to the next ones."""
    text = text or ""
    at = next(i for i, s in enumerate(separators) if s in text)
    out, small = [], []
    for p in _pieces(text, separators[at]):
        if len(p) < size or at + 1 == len(separators):
            small.append(p)
            continue
        out += _pack(small, size, overlap)
        small = []
        out += split_text(p, size, overlap, separators[at + 1 :])
    return out + _pack(small, size, overlap)


def _cut(texts: pa.Array) -> pa.Array:
    """The chunks of each text, null for a null one. Texts become Python strings one at a time, their chunks about HELD
    characters at a time, so that a worker holds little besides the Arrow batch."""
    sizes, gone, some, held, parts = [0], [], [], 0, []
    for t in texts:
        found = split_text(t.as_py()) if t.is_valid else []
        gone.append(not t.is_valid)
        sizes.append(sizes[-1] + len(found))
        some += found
        held += sum(map(len, found))
        if held > HELD:
            parts.append(pa.array(some, pa.string()))
            some, held = [], 0
    parts.append(pa.array(some, pa.string()))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.concat_arrays(parts), mask=pa.array(gone, pa.bool_()))


@arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def split_each(texts: pa.Array) -> pa.Array:
    """The chunks of each text of an array; null for a null one, which needs no split."""
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), _cut(texts.flatten()), mask=pc.is_null(texts))


def split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of a key and a text: the key, the chunks' numbers and the chunks; none of a null."""
    for b in batches:
        keys, at, some, held = [], [], [], 0
        for row in range(b.num_rows):
            found = split_text(b.column(1)[row].as_py())
            keys += [row] * len(found)
            at += range(len(found))
            some += found
            held += sum(map(len, found))
            if some and (held > HELD or row + 1 == b.num_rows):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys)), pa.array(at, pa.int32()), pa.array(some, pa.string())], [b.schema.names[0], "chunk_index", "content"])
                keys, at, some, held = [], [], [], 0
