import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import embedder
from tessella.operators.lexical import words
from tessella.operators.retrieval import answer_prompts
from tessella.operators.vectors import knn

N = 256


@pytest.fixture(scope="module")
def corpus(spark):
    """Three topics with words of their own and some in common; near copies; odd texts."""
    rng = random.Random(4)
    rows = []
    for i in range(240):
        own = [f"t{i % 3}w{j}" for j in range(30)]
        rows.append((i, " ".join(rng.choices(own, k=30) + rng.choices([f"c{j}" for j in range(20)], k=10))))
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 60)] + [(2000, None), (2001, ""), (2002, "zzz unheard?!")]
    return rows, spark.createDataFrame(rows, "key long, content string").repartition(5)


def test_projection_is_near_the_best_one(spark, corpus, tmp_path):
    rows, df = corpus
    fitted = embedder.fit(df, dimensions=8, n=N)
    lists = [r.f for r in df.orderBy("key").select(embedder.features(F.col("content"), N).alias("f")).collect()]
    row, feature, value = embedder._weights(pa.array(lists, pa.list_(pa.int32())), fitted.idf)
    a = np.zeros((len(lists), N))
    a[row, feature] = value
    best = (np.linalg.svd(a, compute_uv=False)[:8] ** 2).sum()
    assert np.allclose(fitted.projection.T @ fitted.projection, np.eye(8), atol=1e-8)
    assert ((a @ fitted.projection) ** 2).sum() > 0.995 * best
    again = embedder.fit(df.repartition(3), dimensions=8, n=N)
    assert np.allclose(again.projection, fitted.projection, atol=1e-6)
    embedder.save(fitted, spark, f"{tmp_path}/e")
    assert np.array_equal(embedder.load(spark, f"{tmp_path}/e").projection, fitted.projection)


def test_near_copies_and_topics_are_near(spark, corpus):
    rows, df = corpus
    embed = embedder.embed_column(spark, embedder.fit(df, dimensions=16, n=N))
    placed = df.select("key", embed(F.col("content")).alias("vector"))
    odd = {r.key: r.vector for r in placed.filter("key >= 2000").collect()}
    assert odd[2000] == odd[2001] == [0.0] * 16 and len(odd[2002]) == 16
    hits = knn(placed.filter("key < 60").select(F.col("key").alias("query_id"), "vector"), placed, 5).collect()
    by = {}
    for r in hits:
        by.setdefault(r.query_id, []).append(r.key)
    assert all(q in k[:2] and q + 1000 in k[:2] for q, k in by.items())
    assert np.mean([x % 1000 % 3 == q % 3 if x < 1060 else 0 for q, k in by.items() for x in k]) > 0.95


def test_it_serves_questions(spark, corpus):
    rows, df = corpus
    embed = embedder.embed_column(spark, embedder.fit(df, dimensions=16, n=N))
    chunks = df.filter("key < 240").select(F.concat(F.lit("f"), "key").alias("file_path"), F.lit(0).alias("chunk_index"), "content").withColumn("embedding", embed(F.col("content")))
    asked = spark.createDataFrame([(0, "what is t0w1 t0w2 t0w3 about then?"), (1, "what is t1w4 t1w5 t1w6 about then?")], "query_id long, question string")
    hits = answer_prompts(asked, chunks, 3, embed=embed)["hits"].collect()
    assert len(hits) == 6 and all(int(h.file_path[1:]) % 3 == h.query_id for h in hits)


def test_few_documents(spark):
    fitted = embedder.fit(spark.createDataFrame([("a b",), ("c",)], "content string"), dimensions=8, n=N)
    assert np.count_nonzero(np.abs(fitted.projection).sum(0) > 1e-6) == 2
    assert not embedder.fit(spark.createDataFrame([], "content string"), dimensions=4, n=N).projection.any()


def test_products_hold_little():
    import tracemalloc

    import numpy as np

    from tessella.operators import embedder

    rng = np.random.default_rng(0)
    matrix, row, feature, value = rng.standard_normal((4096, 80)), np.repeat(np.arange(2000), 100), rng.integers(0, 4096, 200_000), rng.standard_normal(200_000)
    tracemalloc.start()
    got = embedder._multiplied(row, feature, value, matrix, 2000)
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    assert np.allclose(got[7], value[700:800] @ matrix[feature[700:800]])
    assert embedder.PART * 80 * 8 < 100_000  # bytes of a task's share that meet in one group


def test_texts_are_weighted_in_slices_of_words(spark, corpus, monkeypatch):
    import pyarrow.compute as pc

    lists, texts = pa.array([[1], [2, 3], None, [4] * 9, []]), pa.array(["ab", "c", None, "def"])
    assert list(embedder._slices(pc.list_value_length(lists), 3)) == [(0, 3), (3, 4), (4, 5)]
    assert list(embedder._slices(pc.binary_length(texts), 3)) == [(0, 3), (3, 4)]
    _, df = corpus
    whole = embedder.fit(df, dimensions=8, n=N)
    monkeypatch.setattr(embedder, "WORDS", 100)  # two or three texts
    cut = embedder.fit(df, dimensions=8, n=N)
    assert np.array_equal(cut.idf, whole.idf) and np.allclose(cut.projection, whole.projection, atol=1e-6)
    placed = {r.key: r.vector for r in df.select("key", embedder.embed_column(spark, cut)(F.col("content")).alias("vector")).collect()}
    assert len(placed) == 303 and np.allclose(np.linalg.norm([placed[k] for k in placed if k < 2000], axis=1), 1, atol=1e-5) and not any(placed[2000])


def test_words_are_hashed_where_they_are_split(spark, corpus, monkeypatch):
    texts = pa.array(["a b, a", "", "?!", "b"])
    whole = embedder._hashed(texts, N)
    a, b = whole.to_pylist()[0][:2]
    assert whole.to_pylist() == [[a, b, a], [], [], [b]] and embedder._hashed(texts[:0], N).to_pylist() == []
    monkeypatch.setattr(embedder, "WORDS", 0)  # one text at a time
    assert embedder._hashed(texts, N).equals(whole)
    df = corpus[1].withColumn("content", F.concat("content", F.lit(" É 你好 " + " ".join(c * n for c, n in zip("xyzuvw", (3, 4, 7, 8, 31, 32))) + "é" * 40)))
    sparks = F.transform(words(F.col("content")), lambda w: F.pmod(F.xxhash64(w), F.lit(1000)).cast("int"))
    assert all(r.f == r.s for r in df.select(embedder.features(F.col("content"), 1000).alias("f"), sparks.alias("s")).collect())
    placed = df.select(embedder.embed_column(spark, embedder.Embedder(np.ones(N), np.eye(N, 4)))(F.col("content")).alias("v"))
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # no list of words goes to the JVM and back
