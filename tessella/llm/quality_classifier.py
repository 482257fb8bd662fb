"""Quality classifier: a sparse rule ensemble.

Boosted shallow trees over text statistics are fitted on a bounded sample of labelled rows; every path from a root is
a rule, a conjunction of thresholds. Lasso logistic regression picks and weighs the rules, and those that stay are
compiled into one Spark column expression, so all documents are scored by built-in functions in a single scan.

Defined results: a null or empty text has zero statistics and is scored like any; rows without a label, or of the
held-out remainder, are never learned from; a document with several labels counts with the largest; without rows of
both classes the score is the smoothed share of label 1; repeated rows are scored alike, and ids play no part in a score;
a text of any length is measured whole; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows to learn from, the ones of the smallest hashes.
SAMPLE = 20_000
TREES, DEPTH, BINS, SEED = 60, 3, 32, 5
PENALTY = 0.002
THRESHOLD = 0.7

# The statistics, as numerator and denominator.
STATISTICS = {
    "words": ("n_words", None),
    "word_chars": ("n_ink", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "marks": ("n_marks", "n_words"),
    "exclaims": ("n_exclaims", "n_words"),
    "capitals": ("n_capitals", "n_ink"),
    "digits": ("n_digits", "n_ink"),
    "distinct": ("n_distinct", "n_words"),
    "repeated_lines": ("n_repeated_lines", "n_lines"),
    "line_words": ("n_words", "n_lines"),
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of STATISTICS, as doubles."""
    names = [c for c in docs.columns if c.lower() not in {"_words", "_lines", "_body", "_s", *STATISTICS}]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.select(*[F.col(f"`{c}`") for c in names], body.alias("_body"), F.regexp_extract_all(body, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("_words"), F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    count = lambda p: F.length("_body") - F.length(F.regexp_replace("_body", p, ""))
    distinct = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: F.xxhash64(x))))
    raw = {
        "n_words": F.size("_words"), "n_ink": F.length(F.array_join("_words", "")), "n_symbols": count(r"[#*$%&|<>]"), "n_marks": count(r"[.,;:?]"), "n_exclaims": count("!"),
        "n_capitals": count("[A-Z]"), "n_digits": count("[0-9]"), "n_distinct": distinct("_words"), "n_lines": F.size("_lines"), "n_repeated_lines": F.size("_lines") - distinct("_lines"),
    }
    # Generate keeps the counts from being computed once for each rule that uses them.
    out = out.select(*[F.col(f"`{c}`") for c in names], F.explode(F.array(F.struct(*[v.cast("double").alias(k) for k, v in raw.items()]))).alias("_s"))
    ratio = lambda a, b: F.col(f"_s.{a}") if b is None else F.coalesce(F.try_divide(F.col(f"_s.{a}"), F.col(f"_s.{b}")), F.lit(0.0))
    out = out.select(*[F.col(f"`{c}`") for c in names], F.struct(*[ratio(*v).alias(k) for k, v in STATISTICS.items()]).alias("_s"))
    return out.select(*[F.col(f"`{c}`") for c in names], "_s.*")


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list, rows: np.ndarray, path: tuple, rules: set) -> list:
    """Grows a regression tree on gradients; adds its paths to rules and returns (rows, value) of the leaves."""
    if path:
        rules.add(path)
    value = -g[rows].sum() / (h[rows].sum() + 1.0)
    if len(path) == DEPTH or len(rows) < 40:
        return [(rows, value)]
    best = (1e-6, None)
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    for f, c in enumerate(cuts):
        at = np.searchsorted(c, x[rows, f], "left")  # value <= cut i for at <= i
        gs, hs = np.bincount(at, g[rows], len(c) + 1).cumsum()[:-1], np.bincount(at, h[rows], len(c) + 1).cumsum()[:-1]
        ns = np.bincount(at, minlength=len(c) + 1).cumsum()[:-1]
        gain = gs**2 / (hs + 1.0) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1.0) - whole
        gain[(ns < 15) | (len(rows) - ns < 15)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), (f, float(c[gain.argmax()])))
    if best[1] is None:
        return [(rows, value)]
    f, cut = best[1]
    left = x[rows, f] <= cut
    return _tree(x, g, h, cuts, rows[left], (*path, (f, True, cut)), rules) + _tree(x, g, h, cuts, rows[~left], (*path, (f, False, cut)), rules)


def holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, cut in rule:
        out &= (x[:, f] <= cut) == below
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """Intercept, and rules with their weights."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return base, []
    rng, rules, z = np.random.default_rng(SEED), set(), np.full(len(y), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, BINS)).astype(np.float32).astype(np.float64)) for f in range(x.shape[1])]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        found: set = set()
        _tree(x, p - y, p * (1 - p), cuts, rows, (), found)
        leaves = [r for r in found if not any(len(q) > len(r) and q[: len(r)] == r for q in found)]
        for r in leaves:
            m = holds(x, r)
            z[m] -= 0.2 * (p - y)[m].sum() / ((p * (1 - p))[m].sum() + 1.0)
        rules |= found
    rules = sorted(rules)
    m = np.array([holds(x, r) for r in rules], np.float32).T
    mean, spread = m.mean(0), np.maximum(m.std(0), 0.05)
    m = (m - mean) / spread
    w, b, v, t = np.zeros(m.shape[1]), base, np.zeros(m.shape[1]), 1.0
    step = 4.0 / max(1.0, float(np.linalg.norm(m[: min(len(m), 4000)], 2) ** 2 / min(len(m), 4000)))
    for _ in range(400):  # proximal gradient with momentum
        e = 1 / (1 + np.exp(-(m @ v + b))) - y
        new = v - step * (m.T @ e) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        b -= 1.0 * e.mean()
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    weight = w / spread
    return float(b - weight @ mean), [(r, float(k)) for r, k in zip(rules, weight, strict=True) if abs(k) > 1e-6]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[float, list]:
    """The model, from at most SAMPLE labelled ids that aren't held out; of rows of one id the least statistics count."""
    some = labels.filter(F.col("quality").isNotNull() & ~held_out(key)).groupBy(key).agg(F.max("quality").alias("quality"))
    some = some.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(SAMPLE)  # so the broadcast is bounded
    told = statistics(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(some.withColumnsRenamed({key: "_key", "quality": "_quality"})), "_key"), "_text")
    rows = told.groupBy("_key").agg(F.min(F.struct(*STATISTICS, "_quality")).alias("s")).select("s.*").collect()
    table = np.array(sorted(tuple(r) for r in rows), np.float64).reshape(-1, len(STATISTICS) + 1)
    return fit(table[:, :-1], (table[:, -1] > 0).astype(float))


def held_out(key: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def score_column(model: tuple[float, list]) -> Column:
    """The model as a column over the statistics."""
    names = list(STATISTICS)
    terms = [f"({w!r}D * cast({' and '.join(f'{names[f]} {"<=" if below else ">"} {cut!r}D' for f, below, cut in rule)} as int))" for rule, w in model[1]]
    z = F.lit(model[0])
    for i in range(0, len(terms), 20):
        z = z + F.expr(" + ".join(terms[i : i + 20]))
    return 1 / (1 + F.exp(-z))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = statistics(docs).select("doc_id", held_out("doc_id").alias("held_out"), F.explode(F.array(score_column(model))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
