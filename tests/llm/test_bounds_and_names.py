"""Columns with the names that operators use, and samples that stay bounded."""

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import ngram_join, quality_classifier, quality_rules


def test_quality_rules_keep_columns_of_any_name(spark):
    names = ["_words", "_lines", "_bits", "_sorted", "_same", "_metrics", "_row", "_text"]
    df = spark.createDataFrame([(1, "a b\na b\na b c", *range(8))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    r = quality_rules.judge(df).first()
    assert [r[n] for n in names] == list(range(8)) and r.n_dup_lines == 1 and r.n_words == 7
    assert quality_rules.quality_filter(df).columns == df.columns


def test_classifier_learns_from_one_row_an_id(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SAMPLE", 60)
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda x, y: seen.append((x, y)) or (0.0, []))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words here. "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 7 > 3).cast("int").alias("quality"))
    many = docs.unionByName(spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("some words here. ").alias("text")))
    quality_classifier.learn(docs, labels)
    quality_classifier.learn(many, labels)
    assert len(seen[0][0]) == len(seen[1][0]) <= 60


def test_fit_finds_rules_that_hold():
    rng = np.random.default_rng(2)
    x = rng.random((1500, len(quality_classifier.STATISTICS)))
    y = ((x[:, 1] > 0.6) & (x[:, 3] < 0.5)).astype(float)
    b, rules = quality_classifier.fit(x, y)
    score = b + sum(w * quality_classifier.holds(x, r) for r, w in rules)
    assert ((score > 0) == (y > 0)).mean() > 0.97 and len(rules) < 100
    assert {f for f, *_ in max(rules, key=lambda x: abs(x[1]))[0]} & {1, 3}  # the heaviest rule is on what decides


def test_copies_send_their_signatures_once_a_task(spark):
    text = " ".join(f"w{i}" for i in range(300))
    near = text.replace("w7 ", "x7 ")
    copies = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).coalesce(2)
    df = copies.unionByName(spark.createDataFrame([(1000, near), (1001, "nothing like it at all here"), (1002, None)], "doc_id long, text string"))
    found = ngram_join.shared_segments(df, "text", 8)
    plan = [n for n in str(found._jdf.queryExecution().optimizedPlan().toString()).splitlines() if "MapInArrow" in n]
    assert plan and found.select("node").distinct().count() == 2  # the text and its near copy
    by = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df).collect()}
    assert {by[i] for i in [*range(400), 1000]} == {0} and by[1001] == 1001 and by[1002] == 1002
