"""YAML frontmatter of Markdown as a struct column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessella.functions.text import frontmatter_yaml

FIELDS = ("title", "category", "tags", "difficulty", "pack_id")
SCHEMA = T.StructType([T.StructField(f, T.ArrayType(T.StringType()) if f == "tags" else T.StringType()) for f in FIELDS])


def parse_yaml(block: str | None) -> dict:
    """The known fields; malformed YAML, or YAML that isn't a mapping, has none."""
    import yaml

    none = dict.fromkeys(FIELDS) | {"tags": []}
    try:
        found = yaml.safe_load(block) if block else None
    except yaml.YAMLError:
        return none
    if not isinstance(found, dict):
        return none
    tags = found.get("tags", [])
    out = {k: None if found.get(k) is None else str(found[k]) for k in FIELDS if k != "tags"}
    return out | {"tags": [tags] if isinstance(tags, str) else [str(t) for t in tags] if isinstance(tags, list) else []}


@pandas_udf(SCHEMA)
def _parse(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_yaml(b) for b in blocks], columns=list(FIELDS))


def frontmatter(text: Column) -> Column:
    return _parse(frontmatter_yaml(text))
