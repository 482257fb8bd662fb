import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import lexical, retrieval


def by_hand(docs, questions):
    words = {k: Counter(re.findall(r"[^\W_]+", " ".join(t or "" for j, t in docs if j == k).lower())) for k, _ in docs}
    words = {k: c for k, c in words.items() if c}
    df = Counter(w for c in words.values() for w in c)
    mean, n, out = sum(sum(c.values()) for c in words.values()) / len(words), len(words), defaultdict(dict)
    for q, text in questions:
        for k, c in words.items():
            s = 0
            for w in set(re.findall(r"[^\W_]+", (text or "").lower())) & set(c):
                gain = c[w] * (lexical.K1 + 1) / (c[w] + lexical.K1 * (1 - lexical.B + lexical.B * sum(c.values()) / mean))
                s += math.floor(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * gain * lexical.UNIT + 0.5)
            if s:
                out[q][k] = s
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)]
    some = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(120)], k=n))
    docs = [(i, some(rng.randint(1, 40))) for i in range(600)] + [(600 + i, "w0 w1") for i in range(50)] + [(900, None), (901, ""), (902, "?!"), (5, "w7 more of five")]
    questions = [(i, some(rng.randint(1, 5))) for i in range(40)] + [(50, "W0, w1; w0!"), (51, "unknown"), (52, None), (53, "w0"), (54, "w119 w0")]
    lexical.BLOCK = 16
    d = spark.createDataFrame(docs, "id long, body string")
    return docs, questions, lexical.build(d, f"file://{tmp_path_factory.mktemp('x')}/ix", "id", "body"), spark.createDataFrame(questions, "query_id long, question string")


@pytest.mark.parametrize("k", [1, 5, 700])
def test_search_equals_brute_force(tables, k):
    docs, questions, index, asked = tables
    want = {(q, r, key, s) for q, found in by_hand(docs, questions).items() for r, (s, key) in enumerate(sorted(((s, key) for key, s in found.items()), key=lambda x: (-x[0], x[1]))[:k], 1)}
    assert {(r.query_id, r["rank"], r.key, r.score) for r in lexical.search(index, asked, k).collect()} == want


def test_blocks_are_skipped(tables):
    _, _, index, asked = tables
    read = {r.query_id: (r.n_blocks, r.n_read) for r in lexical.read_share(index, asked, 3).collect()}
    assert read[53][0] > 10 and read[53][1] <= 2  # one frequent word: its best postings are enough
    assert sum(n for _, n in read.values()) < sum(n for n, _ in read.values())


def test_scores_for_reranking(spark, tables):
    docs, questions, index, asked = tables
    pairs = asked.filter("query_id < 10").select("query_id", "question", F.explode(F.array(*map(F.lit, (1, 2, 3, 600, 900))).cast("array<long>")).alias("key"))
    got = {(r.query_id, r.key): r.score for r in lexical.scores(index, pairs).collect()}
    want = by_hand(docs, questions)
    assert len(got) == 50 and all(s == want[q].get(k, 0) for (q, k), s in got.items())
    best = retrieval.rerank(lexical.scores(index, pairs).withColumn("ordinal", F.col("key")), F.col("score"), 2)
    assert best.count() == 20


def test_empty_index(spark, tmp_path, tables):
    none = lexical.build(spark.createDataFrame([], "key long, content string"), f"file://{tmp_path}/none")
    assert lexical.search(none, tables[3]).count() == 0


@pytest.fixture
def segmented(spark, tmp_path, monkeypatch):
    """Documents in four partitions and segments of some 60 postings, with equal texts in many of them."""
    monkeypatch.setattr(lexical, "SEGMENT", 60)
    monkeypatch.setattr(lexical, "WORDS", 40)
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rng = random.Random(7)
    docs = [(f"doc#{i}", "w0 w1 w2" if i % 5 == 0 else " ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.randint(0, 30)))) for i in range(300)]
    questions = [(i, " ".join(rng.choices([f"w{j}" for j in range(40)], k=3))) for i in range(30)] + [(40, "w0 w1 w2")]
    index = lexical.build(spark.createDataFrame(docs, "id string, body string").repartition(4), f"file://{tmp_path}/ix", "id", "body")
    return docs, questions, index, spark.createDataFrame(questions, "query_id long, question string")


def ranked(docs, questions, k):
    return {(q, r, key, s) for q, found in by_hand(docs, questions).items() for r, (s, key) in enumerate(sorted(((s, key) for key, s in found.items()), key=lambda x: (-x[0], x[1]))[:k], 1)}


def test_segments_hold_their_documents(segmented):
    docs, questions, index, asked = segmented
    held = index.documents.collect()
    assert len(held) > 20 and sorted(key for r in held for key in r["keys"]) == sorted(key for key, text in docs if text)
    assert index.blocks.filter("n > 4").count() == 0
    assert {(r.query_id, r["rank"], r.key, r.score) for r in lexical.search(index, asked, 5).collect()} == ranked(docs, questions, 5)


def test_questions_are_searched_in_parts(segmented, monkeypatch):
    docs, questions, index, asked = segmented
    monkeypatch.setattr(lexical, "QUESTIONS", 12)
    assert {(r.query_id, r["rank"], r.key, r.score) for r in lexical.search(index, asked, 3).collect()} == ranked(docs, questions, 3)


def test_scores_over_segments(segmented):
    docs, questions, index, asked = segmented
    pairs = asked.select("query_id", "question", F.explode(F.array(*(F.lit(f"doc#{i}") for i in (0, 1, 2, 5, 299, 999)))).alias("key"))
    scored, want = lexical.scores(index, pairs), by_hand(docs, questions)
    got = {(r.query_id, r.key): r.score for r in scored.collect()}
    assert len(got) == 6 * len(questions) and all(s == want[q].get(k, 0) for (q, k), s in got.items())


def test_words_are_those_of_the_sql(spark):
    """Letters and digits of any age, of documents and questions alike; Java's regex knew none of Unicode 14."""
    import duckdb

    texts = ["A\u0870b c", "x_y-Z9", "\u00c9t\u00e9 \u4e2d\u6587\u00b2", "", "?! ", " a  b ", "\u0130x", None]
    sql = "SELECT regexp_extract_all(lower(coalesce(?, '')), '[\\p{L}\\p{N}]+')"
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", lexical.words(F.col("t")).alias("w")).sort("i").collect()
    want = [duckdb.execute(sql, [t]).fetchone()[0] for t in texts]
    assert [r.w for r in got if texts[r.i] != "\u0130x"] == [w for w, t in zip(want, texts, strict=True) if t != "\u0130x"]


def test_old_and_new_letters_are_found(spark, tmp_path):
    index = lexical.build(spark.createDataFrame([(1, "a\u0870b"), (2, "a b"), (3, None), (4, "...")], "key long, content string"), f"file://{tmp_path}/ix")
    asked = spark.createDataFrame([(1, "A\u0870B"), (2, "b")], "query_id long, question string")
    assert {(r.query_id, r.key) for r in lexical.search(index, asked).collect()} == {(1, 1), (2, 2)} and index.n_docs == 2 and index.mean == 1.5


def test_scores_bring_only_wanted_postings(spark, segmented, monkeypatch):
    """Without broadcast joins too: postings are picked where they lie, for some documents at a time."""
    docs, questions, index, asked = segmented
    monkeypatch.setattr(lexical, "PLACES", 3)
    pairs = asked.filter("query_id < 8").select("query_id", "question", F.explode(F.array(*(F.lit(f"doc#{i}") for i in (0, 1, 2, 5, 150, 299, 999)))).alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.query_id, r.key): r.score for r in lexical.scores(index, pairs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = by_hand(docs, questions)
    assert len(got) == 56 and all(s == want[q].get(k, 0) for (q, k), s in got.items())


def test_words_are_split_some_texts_at_a_time(monkeypatch):
    texts, split, seen = pa.array(["a b", "", "?!", "cc dd-ee", "f" * 30, "g"]), lexical._split, []
    monkeypatch.setattr(lexical, "WORDS", 1)
    monkeypatch.setattr(lexical, "_split", lambda t: seen.append(len(t)) or split(t))
    assert lexical._words.func(texts).to_pylist() == [["a", "b"], [], [], ["cc", "dd", "ee"], ["f" * 30], ["g"]]
    assert seen == [3, 1, 1, 1] and lexical._words.func(texts[:0]).to_pylist() == []
