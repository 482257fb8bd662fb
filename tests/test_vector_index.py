import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import vector_index
from tessella.operators.vectors import METRICS, knn


@pytest.fixture(scope="module")
def tables(spark):
    """Forty tight clusters, many copies of one vector, nulls, a zero vector; questions near and far."""
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 5, (40, 6))
    x = centre[rng.integers(0, 40, 3000)] + rng.normal(0, 0.05, (3000, 6))
    rows = [(i, v.tolist(), int(i % 4), 1.0) for i, v in enumerate(x.astype(np.float32))]
    rows += [(5000 + i, x[0].astype(np.float32).tolist(), i % 2, 2.0) for i in range(900)] + [(9000, None, 1, 2.0), (9001, [0.0] * 6, 1, 2.0), (9002, x[1].astype(np.float32).tolist(), None, 2.0)]
    asked = [(i, (x[i * 50] + rng.normal(0, 0.02, 6)).tolist(), i % 5) for i in range(30)] + [(100, x[0].tolist(), 1), (101, None, 1), (102, [9.0] * 6, 1), (103, x[5].tolist(), None)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, label int, away double"), spark.createDataFrame(asked, "query_id long, vector array<float>, label int")


def rows(df):
    return sorted((r.query_id, r["rank"], r.key, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", METRICS)
def test_index_finds_what_the_scan_finds(spark, tables, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    monkeypatch.setattr(vector_index, "CHUNK", 7)
    monkeypatch.setattr(vector_index, "FILE_BYTES", 20_000)
    base, asked = tables
    vector_index.build(base, f"{tmp_path}/ix", "id", "embedding", metric)
    index = vector_index.open_index(spark, f"{tmp_path}/ix")
    assert index.blocks.agg(F.sum("n")).first()[0] == 3902 and index.blocks.agg(F.max("n")).first()[0] <= 50
    how = {"l2": [{}, {"match": "label"}], "cosine": [{"condition": {"away": {"$gt": 1.5}}}], "ip": [{}]}[metric]
    for h in how:
        want = knn(asked, base, 6, metric, key="id", vector="embedding", **h)
        assert rows(vector_index.search(index, asked, 6, share=1.0, **h)) == rows(want)
    if metric == "l2":
        seen = {r.query_id: r.n_looked_at for r in vector_index.looked_at(index, asked, 6).collect()}
        assert sum(v for q, v in seen.items() if q < 30) / (30 * 3902) < 0.1  # the others lie far away, or on the copies
        assert rows(vector_index.search(index, asked, 6, share=0.0)) == rows(knn(asked, base, 6, key="id", vector="embedding"))


def test_few_or_no_vectors(spark, tables, tmp_path):
    base, asked = tables
    few = vector_index.build(base.limit(3), f"{tmp_path}/few", "id", "embedding")
    assert rows(vector_index.search(few, asked, 5)) == rows(knn(asked, base.limit(3), 5, key="id", vector="embedding"))
    none = vector_index.build(base.limit(0), f"{tmp_path}/none", "id", "embedding")
    assert vector_index.search(none, asked, 5).count() == 0 and vector_index.search(few, asked.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="metric"):
        vector_index.build(base, f"{tmp_path}/x", "id", "embedding", "l1")
