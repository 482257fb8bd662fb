"""The queries over the reference tables and their SQL."""

from tessella.plans import chunks_sql, pipelines, retrieval, tables, tables_sql

QUERIES: dict = retrieval.QUERIES | tables.QUERIES | pipelines.QUERIES
ORACLES: dict = retrieval.ORACLES | tables_sql.ORACLES | chunks_sql.CHUNK_ORACLES | pipelines.ORACLES
