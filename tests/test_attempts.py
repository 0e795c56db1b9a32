import datetime
import random

from pyspark.sql import functions as F

from quillgate.functions.decisions import retry_class
from quillgate.operators import rules
from quillgate.streaming import latency
from quillgate.streaming.attempts import attempt_stream, attempts_sink

T0 = datetime.datetime(2024, 1, 1)
KINDS = "action string, ts timestamp, seq long, ok boolean, succeeded boolean, v string"


def plain(rows, most=3, wait=1000):
    out = []
    for key in {r[0] for r in rows}:
        current = None
        for _, ts, seq, ok, done, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            ms = (ts - T0) // datetime.timedelta(milliseconds=1)
            if current and ms > current[0] + wait * current[2]:
                out.append((key, current[1], current[2], "expired"))
                current = None
            n = current[2] + 1 if current else 1
            after = "done" if ok else "stop" if done else "confirm" if v == "browser:upload_file" else "stop" if n >= most else "retry"
            out.append((key, seq, n, after))
            current = (ms, seq, n) if after == "retry" else None
        if current:
            out.append((key, current[1], current[2], "expired"))
    return sorted(out, key=str)


def run(spark, batches, root, **more):
    for b in batches:
        spark.createDataFrame(b, KINDS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    none = F.lit(None).cast("string")
    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in").withColumn("retry", retry_class(F.col("v"), none, none, none))
    told = attempt_stream(stream, "action", **more)
    attempts_sink(told, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{root}/out").where("action is null or action <> 'end'")


def test_attempts_by_the_times_of_tries(spark, tmp_path):
    r = random.Random(11)
    rows, ms = [], 0
    for i in range(400):
        ms += r.choice([1, 300, 900, 1000, 1001, 1900, 2100, 3500])
        rows.append((r.choice(["hot", "hot", "hot", "b", None]), T0 + datetime.timedelta(milliseconds=ms), i, r.choice([True, False, False, None]), r.choice([False, False, False, None, True]), r.choice(["mouse:click"] * 4 + ["browser:upload_file", None])))
    dealt = [sorted(rows[a : a + 140], key=lambda _: r.random()) for a in (0, 140, 280)]
    # neighbours of the borders change places: late, but not by more than a minute
    for a, b in zip(dealt, dealt[1:]):
        a[:5], b[:5] = b[:5], a[:5]
    gone = [(None, None, 900, True, False, "x"), ("b", T0, None, True, False, "x")]
    end = [("end", T0 + datetime.timedelta(days=1), 9999, True, False, "x")]
    got = run(spark, [dealt[0] + gone, dealt[1], dealt[2], end], str(tmp_path), late="30 minutes")
    assert sorted(((x.action, x.seq, x.attempt, x.next) for x in got.collect()), key=str) == plain(rows)
    assert got.where("next = 'expired'").count() > 5


def test_rules_as_a_table(spark):
    r = random.Random(12)
    letters = "abcé "
    rows = [(f"r{i}", [None if r.random() < 0.05 else "".join(r.choice(letters) for _ in range(r.randrange(0, 4))) for _ in range(r.randrange(0, 6))]) for i in range(60)]
    rows += [("none", None), (None, ["a"]), ("CASE", ["ABC"]), ("r0", ["zz"])]
    texts = [(i, "".join(r.choice("abcéABC z") for _ in range(r.randrange(0, 40)))) for i in range(200)] + [(None, "abc"), (7, "abc"), (7, "abc"), (1000, None), (1001, ""), (1002, "x" * 300_000 + "abc")]
    t = spark.createDataFrame(texts, "id long, t string").selectExpr("*", "1 as rule", "2 as _id", "3 as word")
    got = rules.rule_hits(t, spark.createDataFrame(rows, "rule string, words array<string>"), "id", "t")
    want = []
    for i, x in texts:
        low = (x or "").lower()
        for name in {n for n, _ in rows if n}:
            hits = [(k, w.lower()) for n, ws in rows if n == name for k, w in enumerate(ws or ()) if w and w.lower() in low]
            if hits:
                want.append((i, name, low.find(min(hits)[1])))
    assert sorted(((x.id, x.rule, x["at"]) for x in got.collect()), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "rule string, words array<string>")
    assert rules.rule_hits(t, empty, "id", "t").count() == 0 and rules.rule_hits(t.limit(0), spark.createDataFrame(rows, "rule string, words array<string>"), "id", "t").count() == 0


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_RULES", 2)
    r = spark.createDataFrame([(str(i), ["a"]) for i in range(3)], "rule string, words array<string>")
    try:
        rules.rule_hits(spark.createDataFrame([(1, "a")], "id long, t string"), r, "id", "t")
    except ValueError as e:
        assert "too many" in str(e)
    else:
        raise AssertionError("not refused")


def test_times_are_merged_from_sketches(spark):
    r = random.Random(13)
    took = [int(r.lognormvariate(12, 1.5)) for _ in range(20_000)]
    parts = []
    for k in range(4):
        row = spark.createDataFrame([(x, x % 7 == 0) for x in took[k::4]], "t long, b boolean").agg(*latency.measures(F.col("t"), F.col("b"))).first()
        parts.append(latency.Scans(row.n, row.blocked, row.total_ns, row.most_ns, bytes(row.sketch)))
    whole = latency.merged(spark, [*parts, latency.Scans(0, 0, 0, 0, None)])
    assert (whole.n, whole.blocked, whole.total_ns, whole.most_ns) == (len(took), sum(x % 7 == 0 for x in took), sum(took), max(took))
    took.sort()
    for rank, value in latency.quantiles(spark, whole, (0.1, 0.5, 0.9, 0.99)).items():
        low, high = (took[min(len(took) - 1, max(0, int((rank + e) * len(took))))] for e in (-0.03, 0.03))
        assert low <= value <= high
    assert latency.quantiles(spark, latency.merged(spark, [])) == {}


def test_scans_are_timed_in_one_pass(spark):
    p = spark.createDataFrame([(i, '{"t":"a@b.co"}' if i % 3 == 0 else "quiet") for i in range(60)], "payload_id long, payload string")
    rows, seen = latency.timed(p)
    got = rows.select("payload_id", "verdict.safe", "took_ns").collect()
    s = latency.scans(seen)
    assert s.n == 60 and s.blocked == 20 and s.total_ns >= s.most_ns > 0 and all(r.took_ns > 0 for r in got)
    assert {r.payload_id for r in got if not r.safe} == set(range(0, 60, 3))
