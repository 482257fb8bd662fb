"""Rows that share an id, texts of very many lines, and masks that are wrong."""

import time

from pyspark.sql import functions as F

from tessella.llm import chat_format, line_dedup, source_mix


def test_sources_are_met_where_ids_are_null_or_shared(spark, monkeypatch):
    n = 3000
    ids = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id"))
    df = spark.range(n).select(ids.alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit("equal").alias("text"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    for most in (source_mix.BROADCAST_IDS, 0):
        monkeypatch.setattr(source_mix, "BROADCAST_IDS", most)
        out = source_mix.mix(df, weights)
        by = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
        assert abs(by["a"] - 750) < 120 and abs(by["b"] - 2250) < 200
    each = [r["count"] for r in out.repartition(8, "shuffle_key").groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) == 8 and max(each) < 2 * sorted(each)[4] and out.select("shuffle_key").distinct().count() == out.count()
    # Rows with ids of their own draw as they do without the others.
    own = df.filter("doc_id is not null and doc_id <> 7")
    counts = {r.doc_id: r.n for r in source_mix.mix(own, weights, total=3000).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    again = {r.doc_id: r.n for r in source_mix.mix(own.repartition(5), weights, total=3000).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == again


def test_line_dedup_of_very_many_lines(spark):
    text = "\n".join(f"a line of some length, number {i % 150_000}" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id long, text string")
    plan = line_dedup.lines(df, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "xxhash64(text" not in above and "_text" not in above  # the text stays below the explode
    began = time.perf_counter()
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert time.perf_counter() - began < 20
    half = text[: len(text) // 2].split("\n")
    whole = set(text.split("\n"))
    assert got == {1: (200_000, 0), 2: (len(half), sum(x in whole for x in half))}


def test_loss_is_read_under_the_mask(spark):
    turns = [(1, 0, "user", "ask [/INST]"), (1, 1, "assistant", "one </s> \\"), (1, 2, "user", "more"), (1, 3, "assistant", "[OUT] two")]
    log = chat_format.as_log(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    out = chat_format.format_chats(log)
    read = lambda spans: out.select(chat_format.under_mask(F.col("formatted"), F.expr(spans)).alias("x")).first().x
    assert read("loss_spans") == "one </s> \\[OUT] two"
    moved = read("transform(loss_spans, s -> struct(s.start + 1 as start, s.end as end))")
    assert moved != "one </s> \\[OUT] two" and read("slice(loss_spans, 2, 1)") == "[OUT] two"
    assert "loss_spans" in out.select(chat_format.under_mask(F.col("formatted"), F.col("loss_spans")))._jdf.queryExecution().analyzed().toString()
