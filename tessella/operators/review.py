"""Spaced repetition by SM-2: one review as columns, a history as a fold, due items and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of SM-2.
EASINESS, LEAST_EASINESS, PASS, FIRST, SECOND = 2.5, 1.3, 2, 1, 6


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def step(grade, repetitions, easiness, interval) -> Column:
    """struct<repetitions, easiness, interval> after a review with a grade of 0 to 4.

    Intervals round half to even, and grow by the new easiness. A grade under 2 starts again, at a lower easiness.
    """
    q, n, e, i = _col(grade).cast("double"), _col(repetitions).cast("long"), _col(easiness).cast("double"), _col(interval).cast("long")
    new = F.greatest(F.lit(LEAST_EASINESS), e + (F.lit(0.1) - (F.lit(5.0) - q) * (F.lit(0.08) + (F.lit(5.0) - q) * F.lit(0.02))))
    failed = q < PASS
    grown = F.when(n == 0, FIRST).when(n == 1, SECOND).otherwise(F.bround(i.cast("double") * new, 0).cast("long"))
    return F.struct(F.when(failed, F.lit(0)).otherwise(n + 1).cast("long").alias("repetitions"), new.alias("easiness"), F.when(failed, F.lit(FIRST)).otherwise(grown).cast("long").alias("interval"))


def apply_reviews(items: DataFrame, graded: DataFrame, today: Column, now: Column, order: list[str] | None = None) -> DataFrame:
    """items after the reviews in graded (id, grade); others stay as they are.

    Several reviews of an item follow one another by the columns of order, ties by grade. A null grade is none, and
    grades of unknown items do nothing.
    """
    each = graded.filter("grade is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*(order or []), F.col("grade").alias("_q")))).alias("_g"))
    start = F.struct(F.col("repetitions").cast("long").alias("repetitions"), F.col("easiness").cast("double").alias("easiness"), F.col("interval").cast("long").alias("interval"))
    after = items.join(each, "id", "left").withColumn("_s", F.aggregate("_g", start, lambda s, x: step(x["_q"], s["repetitions"], s["easiness"], s["interval"])))
    done = F.col("_g").isNotNull()
    set_to = {c: F.col(f"_s.{c}") for c in ("repetitions", "easiness", "interval")} | {"due_date": F.date_add(today, F.col("_s.interval").cast("int")), "updated_at": now}
    return after.select(*[F.when(done, set_to[c]).otherwise(F.col(c)).alias(c) if c in set_to else F.col(c) for c in items.columns])


def new_items(items: DataFrame, today: Column, now: Column) -> DataFrame:
    """Items (id, file_path, question, answer) as they start, due today."""
    return items.select("id", "file_path", "question", "answer", F.lit(0).cast("long").alias("repetitions"), F.lit(EASINESS).alias("easiness"), F.lit(FIRST).cast("long").alias("interval"), today.cast("date").alias("due_date"), now.alias("created_at"), now.alias("updated_at"))


def replay(reviews: DataFrame, by: str, order: list[str], grade: str = "grade") -> DataFrame:
    """by, n_reviews, repetitions, easiness, interval after all reviews of an item in order.

    A history is one array, as each step needs the one before; it holds a grade and its order columns only.
    """
    start = F.struct(F.lit(0).cast("long").alias("repetitions"), F.lit(EASINESS).alias("easiness"), F.lit(FIRST).cast("long").alias("interval"))
    grades = reviews.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(grade).alias("_g")))).alias("_r"))
    end = F.aggregate("_r", start, lambda s, x: step(x["_g"], s["repetitions"], s["easiness"], s["interval"]))
    return grades.select(by, F.size("_r").cast("long").alias("n_reviews"), end.alias("_s")).select(by, "n_reviews", "_s.*")


def due(items: DataFrame, today: Column) -> DataFrame:
    """The items due, the longest due first."""
    return items.filter(F.col("due_date") <= today).orderBy("due_date", "id")


def stats(items: DataFrame, today: Column) -> DataFrame:
    return items.agg(F.count("*").alias("total"), F.count_if(F.col("due_date") <= today).alias("due_today"))
