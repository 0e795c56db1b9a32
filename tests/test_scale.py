"""What must not grow with the tables: tasks that read all, calls and timers for each row."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillgate.functions import text
from quillgate.operators import payloads
from quillgate.plans import streams
from quillgate.sources import html
from quillgate.sources.html import page_elements
from quillgate.streaming.attempts import Attempts
from quillgate.streaming.task_log import LastEntries


def test_parts_are_written_by_many_tasks_and_read_as_a_batch_each(spark, tmp_path):
    rows, seen = spark.range(0, 900, 1, 6).withColumn("p", F.col("id") % 3), []
    stream = streams._inbox(spark, f"{tmp_path}/in", rows.schema)

    def advance():
        sink = stream.writeStream.foreachBatch(lambda b, n: seen.append((n, b.count(), b.select("p").distinct().count())))
        sink.option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()

    streams._in_parts((rows.where(F.col("p") == k) for k in range(3)), f"{tmp_path}/in", advance)
    assert seen == [(0, 300, 1), (1, 300, 1), (2, 300, 1)]
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 3 * 6


class Held:
    """A state of a key, and how often it was written."""

    def __init__(self):
        self.value, self.writes, self.timers = None, 0, []

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def appendList(self, more):
        self.value = (self.value or []) + more

    def put(self, rows):
        self.value = list(rows)

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.value


def test_a_batch_of_tries_sets_one_timer():
    a, at = Attempts("k", 3, 1000), Held()
    a.handle, a.held, a.open, a.done, at.value = Held(), Held(), Held(), (-1, set()), 0
    assert list(a.handleInputRows(("x",), iter([{"ms": m, "seq": m, "next": "done"} for m in (50, 20, 9000, 30)]), at)) == []
    assert a.handle.timers == [20]
    at.value = 100
    assert [(r["seq"], r["next"]) for r in a.handleExpiredTimer(("x",), at, None)] == [(20, "done"), (30, "done"), (50, "done")]
    # what isn't due yet has the next timer
    assert a.handle.timers == [20, 9000] and a.held.value == [(9000, 9000, "done")]


def test_the_log_of_a_task_is_written_once_a_batch():
    log = LastEntries("k", 3, None)
    log.last = Held()
    for first in (0, 500):
        rows = [("x", us, us, "e", "{}") for us in range(first, first + 400)]
        assert [tuple(r) for r in log.handleInputRows(("x",), iter(rows), None)] == rows
    assert log.last.writes == 2
    assert [e[0] for e in log.last.value[0]] == [897, 898, 899]


def test_few_payloads_are_python_objects_at_once(monkeypatch):
    monkeypatch.setattr(payloads, "SOME", 3)
    texts = [None if i % 5 == 0 else '{"a":[%d,"x"],"a":{}}' % i if i % 2 else f"plain {i}" for i in range(20)]
    got = payloads.payload_nodes.func(pa.array(texts, pa.string())).to_pylist()
    names = ("path", "key", "kind", "s", "level")
    assert got == [[dict(zip(names, n)) for n in payloads.nodes_of(t)] for t in texts]
    assert payloads.payload_nodes.func(pa.array([], pa.string())).to_pylist() == []


def test_elements_leave_in_small_batches(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"<a href='/{i}'>{i}</a>" * (i % 3)) for i in range(10)], "page_id long, html string").coalesce(1)
    whole = sorted(page_elements(pages).collect())
    monkeypatch.setattr(html, "SOME", 3)
    assert sorted(page_elements(pages).collect()) == whole and len(whole) == 9


def test_texts_without_a_match_are_not_cut(spark):
    t = spark.createDataFrame([(1, "a1b22"), (2, "none"), (3, "")], "id int, t string")
    got = {r.id: [tuple(x) for x in r.s] for r in t.select("id", text.spans(F.col("t"), "[0-9]+").alias("s")).collect()}
    assert got == {1: [("1", 1), ("22", 3)], 2: [], 3: []}
