"""Ordered work over tables in which one key may hold most rows.

Rows are dealt by ranges of (key, order), so a hot key is many ranges. What one range must know
of those before it is a row for each range: the last row, or the totals of its last key. Windows
run within a range, and those few rows are carried over its border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate.sources.files import shared_folder

_PART = "_range"


def own_columns(rows: DataFrame, *wanted: str) -> list[str]:
    """Names for own columns, with underscores added until no column of ``rows`` has them."""
    taken, out = {c.lower() for c in rows.columns}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def _number(value: Column, kind: str) -> Column:
    """A place in the order as a number: seconds of a time."""
    return (value.cast("timestamp") if kind.startswith(("timestamp", "date")) else value).cast("double")


def _ranges(rows: DataFrame, order: list[Column], part: str, parts: int | None) -> DataFrame:
    """``rows`` with the number of their range, written, as ranges are drawn from a sample."""
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "ranges")
    dealt = rows.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column], latest: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with running totals within a key by ``order``, this row's included: sums (0 for
    nulls) and ``latest``, the largest value so far (null where all are). Of rows alike in key
    and order the order is open. A null key is a key of its own; an empty table gives no rows.
    """
    part, k, told, before = own_columns(rows, _PART, "_key", "_told", "_before")
    latest = latest or {}
    own = rows.withColumns({**{c: F.coalesce(v, F.lit(0)) for c, v in sums.items()}, **latest})
    by = [F.col(f"`{c}`") for c in (key, *order)]
    r = _ranges(own, by, part, parts)
    names = [*sums, *latest]
    totals = r.groupBy(part, F.col(f"`{key}`").alias(k)).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in latest))
    # a row for each range: its last key with the totals there
    last = totals.groupBy(part).agg(F.max(F.struct(k, F.struct(*names).alias(told))).alias("m")).select(part, f"m.{k}", f"m.{told}.*")
    upto = W.partitionBy(k).orderBy(part).rowsBetween(W.unboundedPreceding, 0)
    then = F.lead(part).over(W.orderBy(part))
    carried = last.withColumns({**{c: F.sum(c).over(upto) for c in sums}, **{c: F.max(c).over(upto) for c in latest}}).withColumn(before, then)
    carried = carried.where(F.col(before).isNotNull()).select(F.col(before).alias(f"{part}b"), F.col(k).alias(f"{k}b"), F.struct(*names).alias(told))
    inside = W.partitionBy(part, key).orderBy(*by[1:]).rowsBetween(W.unboundedPreceding, 0)
    r = r.withColumns({**{c: F.sum(c).over(inside) for c in sums}, **{c: F.max(c).over(inside) for c in latest}})
    # as many rows as there are ranges
    r = r.join(F.broadcast(carried), (F.col(part) == F.col(f"{part}b")) & by[0].eqNullSafe(F.col(f"{k}b")), "left")
    add = {c: F.col(c) + F.coalesce(F.col(told)[c], F.lit(0)) for c in sums} | {c: F.greatest(F.col(c), F.col(told)[c]) for c in latest}
    return r.select(*(F.col(f"`{c}`") for c in rows.columns if c not in names), *(v.alias(c) for c, v in add.items()))


def runs(rows: DataFrame, key: str, order: str, value: str, gap: float | None = None, parts: int | None = None) -> DataFrame:
    """(key, value, first, last, n): rows of a key that follow each other by ``order`` with the
    same value, each run one row. With ``gap``, a step of ``order`` above it (seconds of a
    timestamp) ends a run too. Null keys and values are values of their own; of rows alike in
    key and order the one with the smaller value stands first; rows without an order are
    passed over. A run may be as long as the table: it is summed in parts.
    """
    r = rows.where(F.col(f"`{order}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), F.col(f"`{order}`").alias("o"), F.col(f"`{value}`").alias("v"))
    r = _ranges(r, [F.col("k"), F.col("o"), F.col("v")], "p", parts)
    # the last row of each range stands before the first of the next
    ends = r.groupBy("p").agg(F.max(F.struct("k", "o", "v")).alias("e"), F.count(F.lit(1)).alias("n"))
    ends = ends.select(F.lead("p").over(W.orderBy("p")).alias("q"), "e").where("q is not null")
    here = W.partitionBy("p").orderBy("k", "o", "v")
    r = r.join(F.broadcast(ends), F.col("p") == F.col("q"), "left")
    before = F.coalesce(F.lag(F.struct("k", "o", "v")).over(here), F.col("e"))
    r = r.select("p", "k", "o", "v", before.alias("b"))
    kind = rows.schema[order].dataType.simpleString()
    step = _number(F.col("o"), kind) - _number(F.col("b.o"), kind) > gap if gap is not None else F.lit(False)
    new = F.col("b").isNull() | ~F.col("b.k").eqNullSafe(F.col("k")) | ~F.col("b.v").eqNullSafe(F.col("v")) | F.coalesce(step, F.lit(False))
    r = r.withColumn("new", new.cast("long"))
    r = r.withColumn("run", F.sum("new").over(here.rowsBetween(W.unboundedPreceding, 0)))
    counts = r.groupBy("p").agg(F.max("run").alias("runs"))
    sofar = counts.select(F.col("p").alias("q"), F.coalesce(F.sum("runs").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("more"))
    # both small tables have a row for each range
    r = r.join(F.broadcast(sofar), F.col("p") == F.col("q")).withColumn("run", F.col("run") + F.col("more"))
    out = r.groupBy("run").agg(F.first("k").alias("k"), F.first("v").alias("v"), F.min("o").alias("first"), F.max("o").alias("last"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("k").alias(key), F.col("v").alias(value), "first", "last", "n")


def longest_runs(found: DataFrame, key: str) -> DataFrame:
    """The longest of each key's :func:`runs`, the earliest of equal ones."""
    value = next(c for c in found.columns if c not in (key, "first", "last", "n"))
    early = -_number(F.col("first"), found.schema["first"].dataType.simpleString())
    best = F.max(F.struct("n", early.alias("e"), F.struct(value, "first", "last").alias("r"))).alias("b")
    return found.groupBy(key).agg(best).select(key, f"b.r.{value}", "b.r.first", "b.r.last", "b.n")
