"""Change detection, cached values and activity logs, over tables and over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgate.functions import patterns as P
from quillgate.operators.ordered import own_columns

THRESHOLD = 0.02


def average_hash(values: Column) -> Column:
    """One bit per value: whether it is above the mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"), lambda s: F.try_divide(s, F.size(values)))
    return F.transform(values, lambda x: (x.cast("double") > mean).cast("int"))


def hamming(a: Column, b: Column) -> Column:
    """Share of bits that differ."""
    return F.try_divide(F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x).cast("double"), F.size(a))


def changed(rows: DataFrame, key: str, order: str, bits: str, threshold: float = THRESHOLD) -> DataFrame:
    """Adds changed: true for the first of a key, else whether the bits differ from those
    just before by more than the threshold."""
    own = own_columns(rows, "_before")[0]
    before = F.lag(bits).over(W.partitionBy(key).orderBy(order))
    return rows.withColumn(own, before).withColumn("changed", F.col(own).isNull() | (hamming(F.col(bits), F.col(own)) > threshold)).drop(own)


def last_known(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds cached: the last value that isn't null, this row's included."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("cached", F.last(value, ignorenulls=True).over(w))


def running_counters(rows: DataFrame, key: str, order: str, counts: list[str]) -> DataFrame:
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({f"total_{c}": F.sum(c).over(w) for c in counts})


def activity_view(log: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """(key, ts, label, tone, props) of the last ``limit`` entries of a key; sensitive props
    are marked. ``log``: (key, ts, seq, event, props map<string,string>)."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq")))
    last = log.withColumn("_n", n).where(F.col("_n") <= limit)
    dim = log.sparkSession.createDataFrame(P.ACTIVITY_EVENTS, "event string, label string, tone string")
    told = last.join(F.broadcast(dim), "event", "left")  # a fixed list of 21 rows
    props = F.transform_values("props", lambda k, v: F.when(k.isin(P.ACTIVITY_KEYS), "[redacted]").otherwise(v))
    return told.select(key, "ts", "seq", F.coalesce("label", "event", F.lit("Event")).alias("label"), F.coalesce("tone", F.lit("neutral")).alias("tone"), props.alias("props"))


def changed_stream(rows: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, ts, changed) of a stream (key, ts, bits array<int>): each key's state is the
    bits seen last. Rows of one batch are taken in order of ts."""
    kind = rows.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = list(state.get[0]) if state.exists else None
        own = pd.concat(batches).sort_values("ts")
        out = []
        for bits in own["bits"]:
            bits = [int(x) for x in bits]
            out.append(before is None or sum(x != y for x, y in zip(bits, before)) / max(1, len(bits)) > threshold)
            before = bits
        state.update((before,))
        yield pd.DataFrame({key: [k[0]] * len(own), "ts": own["ts"], "changed": out})

    return rows.select(key, "ts", "bits").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, changed boolean", "bits array<int>", "append", GroupStateTimeout.NoTimeout)
