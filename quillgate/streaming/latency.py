"""How long scans take, told by the scan itself: each batch leaves a count, a sum and a sketch
of its times, which are merged without another look at the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillgate.operators.payloads import verdict

#: Size of a sketch: ranks are off by some 1 in 100 at most.
SKETCH_K = 200


@dataclass
class Scans:
    """Of one batch or of several merged: scans, those not safe, nanoseconds in all and the
    most for one, and a quantile sketch."""

    n: int
    blocked: int
    total_ns: int
    most_ns: int
    sketch: bytes | None


def _now() -> Column:
    return F.expr("reflect('java.lang.System', 'nanoTime')").cast("long")


def timed(payloads: DataFrame, json_col: str = "payload") -> tuple[DataFrame, Observation]:
    """The rows with ``verdict`` and ``took_ns``, the time from its evaluation's begin to its
    end, and what is observed of them while an action runs over them, once. The time that
    reading a payload into nodes takes, in batches beforehand, isn't in it."""
    one = F.struct(_now().alias("a"), verdict(F.col(f"`{json_col}`").cast("string")).alias("v"), _now().alias("b"))
    rows = payloads.withColumn("_one", F.transform(F.array(one), lambda x: x)[0])
    rows = rows.withColumns({"verdict": F.col("_one.v"), "took_ns": F.col("_one.b") - F.col("_one.a")}).drop("_one")
    seen = Observation()
    return rows.observe(seen, *measures(F.col("took_ns"), ~F.col("verdict.safe"))), seen


def measures(took: Column, blocked: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if(blocked).alias("blocked"), F.sum(took).alias("total_ns"), F.max(took).alias("most_ns"), F.kll_sketch_agg_bigint(took, F.lit(SKETCH_K)).alias("sketch")]


def scans(seen: Observation) -> Scans:
    """What a finished action has observed."""
    o = seen.get
    return Scans(o["n"], o["blocked"], o["total_ns"] or 0, o["most_ns"] or 0, bytes(o["sketch"]) if o["sketch"] is not None else None)


def merged(spark: SparkSession, parts: list[Scans]) -> Scans:
    """Several batches as one."""
    sketches = [p.sketch for p in parts if p.n and p.sketch]
    whole = None
    if sketches:
        whole = bytes(spark.createDataFrame([(bytearray(s),) for s in sketches], "s binary").agg(F.expr("reduce(collect_list(s), cast(null as binary), (a, x) -> case when a is null then x else kll_sketch_merge_bigint(a, x) end)").alias("s")).first().s)
    return Scans(sum(p.n for p in parts), sum(p.blocked for p in parts), sum(p.total_ns for p in parts), max((p.most_ns for p in parts), default=0), whole)


def quantiles(spark: SparkSession, of: Scans, ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> dict[float, int]:
    """Nanoseconds by rank; none without scans."""
    if not of.n or of.sketch is None:
        return {}
    row = spark.createDataFrame([(bytearray(of.sketch),)], "s binary").select(*(F.kll_sketch_get_quantile_bigint("s", F.lit(float(r))).alias(f"q{i}") for i, r in enumerate(ranks))).first()
    return dict(zip(ranks, row))
