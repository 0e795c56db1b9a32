import datetime
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgate.functions.dates import clock, epoch_ms, iso_utc
from quillgate.operators import settings
from quillgate.sources.files import Folder
from quillgate.sources.snapshots import SNAPSHOT, snapshot_stream, snapshots
from quillgate.streaming import counters, task_log
from quillgate.streaming.snapshots import projection, snapshot_documents, snapshot_sink

T0 = datetime.datetime(2024, 1, 1)
LOG = "task string, ts timestamp, seq long, event string, props string, more int"


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def in_files(spark, batches, kinds, path):
    for b in batches:
        spark.createDataFrame(b, kinds).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(path)


def test_the_log_keeps_the_last_entries(spark, tmp_path):
    e = lambda task, m, seq, **p: (task, at(m), seq, "x", json.dumps(p), 0)
    batches = [
        [e("a", m, m, value=m, kind="k") for m in range(0, 120, 2)] + [e("b", 5, 1000, text="t")],
        # once more, in another order; new ones; one without a task, one without a time, one without a number
        [e("a", m, m, value=m) for m in range(118, 60, -2)] + [e("a", m, m, content="c") for m in range(121, 181, 2)] + [(None, at(150), 2000, "x", "{}", 0), ("a", None, 2001, "x", "{}", 0), ("b", at(150), None, "x", "{}", 0)],
        # late by more than an hour, and late by less
        [e("a", 1, 3000), e("b", 6, 3001), e("b", 175, 3002, password="p")] + [e("a", 170, 3003)],
    ]
    root = str(tmp_path)
    task_log.append_log(in_files(spark, batches, LOG, f"{root}/in"), "task", f"{root}/log", f"{root}/state", keep=40).awaitTermination()
    appended = spark.read.parquet(f"{root}/log").collect()
    want = {("a", s) for s in [*range(0, 120, 2), *range(121, 181, 2), 3003]} | {("b", 1000), ("b", 3002)}
    assert len(appended) == len(want) and {(r.task, r.seq) for r in appended} == want
    held = task_log.last_entries(spark, f"{root}/state").collect()
    last = sorted(((170 if s == 3003 else s, s) for t, s in want if t == "a"))[-40:]
    assert sorted(r.seq for r in held if r.task == "a") == sorted(s for _, s in last)
    assert {(r.seq, r.entry) for r in held if r.task == "b"} == {(1000, '{"text":"[REDACTED]"}'), (3002, '{"password":"[REDACTED]"}')}
    # begun again: what was done isn't done twice, and the state goes on
    spark.createDataFrame([e("a", 200, 4000)], LOG).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    task_log.append_log(stream, "task", f"{root}/log", f"{root}/state", keep=40).awaitTermination()
    assert spark.read.parquet(f"{root}/log").count() == len(want) + 1
    again = task_log.last_entries(spark, f"{root}/state").where("task = 'a'").collect()
    assert len(again) == 40 and max(r.seq for r in again) == 4000


def test_idle_lists_expire(spark, tmp_path):
    root = str(tmp_path)
    e = lambda task, m, seq: (task, at(m), seq, "x", "{}", 0)
    stream = in_files(spark, [[e("a", 1, 1), e("b", 1, 2)], [e("b", 2, 3)]], LOG, f"{root}/in")
    # nothing is idle for a millisecond or less, so the second batch finds no list of the first
    task_log.append_log(stream, "task", f"{root}/log", f"{root}/state", idle_ms=1).awaitTermination()
    assert spark.read.parquet(f"{root}/log").count() == 3
    state = f"{root}/state"
    assert [r.seq for r in task_log.last_entries(spark, state).where("task = 'b'").collect()] in ([3], [])


COUNTED = "k string, ts timestamp, n int, r string"


def test_counters_over_late_and_repeated_events(spark, tmp_path):
    rows = [("a", at(1), 1, None), ("a", at(5), 2, "x"), ("a", at(9), None, None), ("a", at(31), 4, "y"), (None, at(2), 5, "z"), ("b", None, 9, "never"), ("b", at(75), 6, None)]
    # a batch is held against the watermark of the batch before it
    more, late, end = [("b", at(76), 1, None)], [("a", at(3), 100, "late"), ("b", at(80), 7, "w")], [("end", at(1000), 0, None)]
    sums = {"n": F.col("n")}
    told = {}
    for name, make in (("w", lambda d, late: counters.window_counters(d, "k", sums, "10 minutes", F.col("r"), late)), ("s", lambda d, late: counters.session_counters(d, "k", sums, "20 minutes", F.col("r"), late))):
        root = f"{tmp_path}/{name}"
        stream = in_files(spark, [rows, more, late, end], COUNTED, f"{root}/in")
        kept = make(stream, "15 minutes")
        counters.counters_sink(kept, f"{root}/out", f"{root}/state").awaitTermination()
        told[name] = sorted(map(str, spark.read.schema(kept.schema).parquet(f"{root}/out").where("k is null or k <> 'end'").collect()))
        batch = make(spark.createDataFrame([*rows, *more, late[1]], COUNTED), None)
        assert told[name] == sorted(map(str, batch.collect()))
        assert make(spark.createDataFrame([], COUNTED), None).count() == 0
    assert len(told["w"]) == 5 and len(told["s"]) == 4


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = lambda *x: spark.createDataFrame(list(x), settings.SETTINGS)
    assert settings.version(spark, root) == 0 and settings.stored(spark, root).count() == 0
    assert settings.merge(spark, root, rows(("a", "x", "1"), (None, "x", "2"), ("b", "y", "3")), 0) == 1
    assert settings.merge(spark, root, rows(("a", "x", None), (None, "x", "5"), ("c", "z", "6")), 1) == 2
    want = {("a", "x", None), (None, "x", "5"), ("b", "y", "3"), ("c", "z", "6")}
    assert {tuple(r) for r in settings.stored(spark, root).collect()} == want
    with pytest.raises(settings.Conflict):
        settings.merge(spark, root, rows(("a", "x", "lost")), 1)
    assert {tuple(r) for r in settings.stored(spark, root).collect()} == want
    assert {tuple(r) for r in settings.stored(spark, root, 1).collect()} == {("a", "x", "1"), (None, "x", "2"), ("b", "y", "3")}
    assert settings.merge(spark, root, rows(), 2) == 3 and {tuple(r) for r in settings.stored(spark, root).collect()} == want


def test_a_writer_that_is_overtaken_leaves_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", "x", "1")], settings.SETTINGS)
    seen = settings.version
    other = []

    def overtaken(*a):
        v = seen(*a)
        if not other:
            other.append(1)
            settings.merge(spark, root, rows.withColumn("value", F.lit("first")), v)
        return v

    monkeypatch.setattr(settings, "version", overtaken)
    with pytest.raises(settings.Conflict):
        settings.merge(spark, root, rows, 0)
    monkeypatch.undo()
    assert [tuple(r) for r in settings.stored(spark, root).collect()] == [("a", "x", "first")]
    assert len(Folder(spark, f"{root}/tables").names()) == 1


def test_the_last_of_several_changes(spark):
    c = spark.createDataFrame([("a", "x", "1", 1), ("a", "x", None, 2), ("a", None, "9", 3), (None, "x", "4", 1), (None, "x", "5", 0)], settings.SETTINGS + ", t int")
    assert {tuple(r) for r in settings.latest(c, [F.col("t")]).collect()} == {("a", "x", None), (None, "x", "4")}


def test_snapshots_are_told_three_ways(spark, tmp_path):
    box = {"x": 1.0, "y": 2.0, "width": 400.0, "height": 252.0}
    lines = [
        {"snapshot_id": 1, "url": "u", "title": "t", "fields": [{"tag": "input"}], "mediaCandidates": [
            {"tag": "img", "alt": "", "title": "PAN card", "fileName": "pan-card.png", "visible": True, "bbox": box}, {"tag": "img", "alt": "beach", "visible": True, "bbox": box | {"width": 800.0, "height": 800.0}},
            {"tag": "canvas", "ocrText": "Salary slip", "visible": False, "bbox": box}, {"tag": "canvas", "ocrText": "Salary slip", "visible": True}, {"tag": "svg", "visible": True, "bbox": box}]},
        {"snapshot_id": 2}, {"snapshot_id": None, "mediaCandidates": [{"tag": "object", "mimeType": "application/pdf", "visible": True, "bbox": box, "unknown": 1}]}, {"snapshot_id": 3, "mediaCandidates": []},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    (tmp_path / "in/b.json").write_text(json.dumps(lines[0]) + "\n")
    root = str(tmp_path / "out")
    snapshot_sink(snapshot_stream(spark, str(tmp_path / "in"), 1), root, str(tmp_path / "log")).awaitTermination()
    got = {k: sorted(map(tuple, projection(spark, root, k).collect()), key=str) for k in ("region", "blocked", "document")}
    assert [(r[0], r[1], r[3], r[4], r[6]) for r in got["region"]] == [(1, 0, "pan", "document_detector", "redact")] * 2 + [(1, 4, "generic_identity", "document_detector", "confirm")] * 2 + [(None, 0, "document", "document_detector", "redact")]
    assert got["blocked"] == [(1, 0, "PAN card", "pan")] * 2 + [(1, 4, "svg", "generic_identity")] * 2 + [(None, 0, "object", "document")]
    assert [(r[2], r[3], r[5]) for r in got["document"]] == [("img", "pan", ["alt_text", "file_name", "aspect_ratio"])] * 2 + [("svg", "generic_identity", ["aspect_ratio"])] * 2 + [("object", "document", ["mime_type", "aspect_ratio"])]
    assert snapshot_documents(spark.createDataFrame([], SNAPSHOT)).count() == 0 and snapshots(spark, str(tmp_path / "in")).count() == 6


def test_times(spark):
    d = spark.createDataFrame([(datetime.datetime(2024, 1, 31, 21, 5, 7, 120999),), (datetime.datetime(1969, 12, 31, 0, 0, 0),), (None,)], "t timestamp")
    got = [tuple(r) for r in d.select(clock(F.col("t")), iso_utc(F.col("t")), epoch_ms(F.col("t"))).collect()]
    assert got == [("09:05 PM", "2024-01-31T21:05:07.120Z", 1706735107120), ("12:00 AM", "1969-12-31T00:00:00.000Z", -86_400_000), ("--:--", None, None)]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert d.select(clock(F.col("t")), iso_utc(F.col("t"))).first()[1] == "2024-01-31T21:05:07.120Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_all_have_sql():
    names = {"gated_egress_stream", "snapshot_documents_stream", "task_log_last", "event_windows_stream", "event_sessions_stream", "settings_versions", "event_runs", "longest_event_runs", "running_status", "detector_curve", "payload_gate_turns", "leak_scan_documents"}
    assert names <= set(entry.queries()) and names <= set(entry.oracle_sql())
