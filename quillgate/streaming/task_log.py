"""The log of tasks as a stream: entries are redacted, repeated ones dropped, and each task
keeps its last ones.

Entries that come later than ``late`` behind the newest are dropped, so what must be known of
ids ends with the watermark. A task's state is an array of its last ``keep`` entries by time;
a new entry takes the place of the oldest. A task's list goes when ``idle`` has passed since
it was last written, or stays where ``idle`` is None.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillgate.operators.session import redact_log

KEEP, LATE = 50, "1 hour"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TOLD = "us long, seq long, event string, entry string"
_STATE = "entries array<struct<us:bigint,seq:bigint,event:string,entry:string>>"


class LastEntries(StatefulProcessor):
    """Keeps the last entries of a task and passes on those that are new."""

    def __init__(self, key: str, keep: int, idle_ms: int | None):
        self.key, self.keep, self.idle_ms = key, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE, self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        # one value: a list would cost a step for each of its entries
        held, told = [tuple(e) for e in self.last.get()[0]] if self.last.exists() else [], Row(self.key, "us", "seq", "event", "entry")
        for r in rows:
            yield told(*r)
            held.append(tuple(r[1:]))
            if len(held) >= 20 * self.keep:  # few are held, however many a batch has
                held = self._last(held)
        self.last.update((self._last(held),))

    def _last(self, held: list[tuple]) -> list[tuple]:
        return sorted(held, key=lambda e: (e[0], e[1]))[-self.keep :]

    def close(self) -> None:
        pass


def kept_log(log: DataFrame, key: str, keep: int = KEEP, late: str = LATE, idle_ms: int | None = None) -> DataFrame:
    """(key, ts, seq, event, entry) of every entry that is appended: a stream (key, ts, seq,
    event, props as JSON text). ``entry`` is the redacted props. Of entries with one ``seq``
    the first that comes is taken; entries without a time, a key or a ``seq`` are dropped."""
    whole = log.where(f"ts is not null and seq is not null and `{key}` is not null").withWatermark("ts", late)
    once = whole.dropDuplicatesWithinWatermark(["seq"]).select(F.col(f"`{key}`").alias(key), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("seq").cast("long").alias("seq"), "event", redact_log(F.col("props")).alias("entry"))
    kind = log.schema[key].dataType.simpleString()
    told = once.groupBy(key).transformWithState(LastEntries(key, keep, idle_ms), f"`{key}` {kind}, {_TOLD}", "append", "None" if idle_ms is None else "ProcessingTime")
    return told.select(F.col(f"`{key}`"), F.timestamp_micros("us").alias("ts"), "seq", "event", "entry")


def append_log(log: DataFrame, key: str, path: str, checkpoint: str, keep: int = KEEP, late: str = LATE, idle_ms: int | None = None, **trigger: object) -> StreamingQuery:
    """Starts the log: new entries are appended to ``path``, once each."""
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKS}
    if idle_ms is not None:  # else batches without rows would follow each other to no end
        conf["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {k: log.sparkSession.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        log.sparkSession.conf.set(k, v)
    try:  # a stream takes the settings of its start
        writer = kept_log(log, key, keep, late, idle_ms).writeStream.format("parquet").outputMode("append")
        return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            log.sparkSession.conf.unset(k) if v is None else log.sparkSession.conf.set(k, v)


def last_entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, ts, seq, event, entry): what the tasks' states hold, each entry a row."""
    state = spark.read.format("statestore").option("path", checkpoint).option("operatorId", 0).option("stateVarName", "last").load()
    # a value that expires has its time beside it
    expires = "ttlExpirationMs" in state.schema["value"].dataType.names
    rows = state.select("key.*", F.explode("value.value.entries" if expires else "value.entries").alias("_e"))
    return rows.select(F.col(f"`{rows.columns[0]}`"), F.timestamp_micros("_e.us").alias("ts"), "_e.seq", "_e.event", "_e.entry")
