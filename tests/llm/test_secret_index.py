import re
import time

from pyspark.sql import functions as F

from tessella.llm import secret_scan


def test_posting_lists_are_intersected(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "BLOCK", 7)
    rows = [(i, f"row {i} " + ["my password: abcdefgh", "AKIA" + "B" * 20, "pass word", "-----BEGIN PRIVATE KEY-----", "eyJ no"][i % 5]) for i in range(60)] + [(3, "AKIA"), (None, "token=abcdefg"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    queries = {k: q for k, p, _, _ in secret_scan.RULES if (q := secret_scan.trigram_query(p))}
    every = sorted({t for q in queries.values() for c in q for ts in c for t in ts})
    postings = secret_scan.index(df, "doc_id", "text", every)
    assert postings.select("block").distinct().count() > 3 and postings.groupBy("block", "trigram").count().filter("count > 1").count() == 0
    got = {r._doc: set(r._rules) for r in secret_scan.candidates(postings, queries).collect()}
    numbers = {(r.doc_id, r.text): r._doc for r in df.select("doc_id", "text", secret_scan._number("doc_id", "text")).collect()}
    for row in rows:
        low = (row[1] or "").lower()
        want = {k for k, q in queries.items() if all(any(all(t in low for t in ts) for ts in c) for c in q)}
        assert got.get(numbers[row], set()) == want, row


def test_spans_of_many_matches(spark):
    text = " ".join(f"token=abcdef{i} é" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, " ".join(f"token=abcdef{i}" for i in range(secret_scan.FOLD * 3)))], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == 0] for r in secret_scan.scan(df).collect()}
    assert time.perf_counter() - began < 30
    assert got[1] == [m.span() for m in re.finditer(r"token=[A-Za-z0-9]+", text)] and len(got[2]) == secret_scan.FOLD * 3
    assert df.select(secret_scan.spans("text", 0, "nothing here", 0, 0).alias("s")).filter(F.size("s") > 0).count() == 0
