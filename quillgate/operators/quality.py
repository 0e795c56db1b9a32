"""How good a detector is: counts, precision, recall and F1 at every threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.operators.ordered import running


def threshold_curve(scored: DataFrame, group: str, score: str = "score", expected: str = "expected", parts: int | None = None) -> DataFrame:
    """(group, threshold, tp, fp, fn, tn, precision, recall, f1): a row for each distinct score
    of a group, as the threshold from which a row counts as found. Equal scores are counted
    together first, so a threshold is a row however many rows have it; the counts run over
    ranges of (group, score), so a large group is many. Rows without a score are never found;
    a null ``expected`` is not expected; a null group is a group. A rate without rows to count
    is null."""
    hit = F.coalesce(F.col(expected), F.lit(False))
    rows = scored.select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), hit.cast("long").alias("y"), (~hit).cast("long").alias("n"))
    by = rows.groupBy("g", "s").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    whole = by.groupBy(F.col("g").alias("h")).agg(F.sum("y").alias("all_y"), F.sum("n").alias("all_n"))
    down = by.where("s is not null").withColumn("down", -F.col("s"))
    curve = running(down, "g", ["down"], {"tp": F.col("y"), "fp": F.col("n")}, parts=parts)
    c = curve.join(whole, F.col("g").eqNullSafe(F.col("h"))).withColumns({"fn": F.col("all_y") - F.col("tp"), "tn": F.col("all_n") - F.col("fp")})
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    rates = {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)}
    return c.withColumns(rates).select(F.col("g").alias(group), F.col("s").alias("threshold"), "tp", "fp", "fn", "tn", *rates)
