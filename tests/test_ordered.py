import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillgate.operators.ordered import longest_runs, running, runs
from quillgate.operators.quality import threshold_curve

T0 = datetime.datetime(2024, 1, 1)


def plain_runs(rows, gap):
    out, before = [], None
    for k, o, v in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] is not None, r[2] or 0)):
        if before and before[0] == k and before[2] == v and (gap is None or (o - before[1]).total_seconds() <= gap):
            out[-1][3] = o
            out[-1][4] += 1
        else:
            out.append([k, v, o, o, 1])
        before = (k, o, v)
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("gap", [None, 90])
def test_runs_over_borders(spark, gap):
    r = random.Random(5)
    # one key has nearly all rows, and one run of it most of those
    rows = [("hot", T0 + datetime.timedelta(seconds=10 * i), 1 if 200 < i < 2500 else r.randrange(2)) for i in range(3000)]
    rows += [(r.choice(["a", "b", None, ""]), T0 + datetime.timedelta(seconds=r.randrange(5000)), r.choice([0, 1, None])) for _ in range(400)]
    rows += [("a", None, 1), ("one", T0, 7), ("one", T0, 7)]
    d = spark.createDataFrame(rows, "p string, o timestamp, v int").selectExpr("*", "1 as n", "2 as run", "3 as first")
    for parts in (1, 7, 40):
        got = runs(d, "p", "o", "v", gap, parts)
        assert sorted(map(tuple, got.collect()), key=str) == plain_runs(rows, gap)
    best = {x.p: (x.v, x["first"], x.n) for x in longest_runs(got, "p").collect()}
    want = {}
    for k, v, first, last, n in plain_runs(rows, gap):
        if k not in want or (n, -first.timestamp()) > (want[k][2], -want[k][1].timestamp()):
            want[k] = (v, first, n)
    assert best == want
    assert runs(d.limit(0), "p", "o", "v", gap).count() == 0


def test_running_totals_over_borders(spark):
    r = random.Random(6)
    rows = [("hot" if i % 4 else r.choice(["a", None, "z"]), r.randrange(10**6), i, r.choice([None, 1, 5]), r.choice([None, r.random()])) for i in range(2000)]
    d = spark.createDataFrame(rows, "k string, o long, i int, x int, y double").selectExpr("*", "9 as total", "1 as _range", "2 as _key", "3 as _told", "4 as _before")
    want, seen = {}, {}
    for k, o, i, x, y in sorted(rows, key=lambda t: (t[1], t[2])):
        total, top = seen.get(k, (0, None))
        seen[k] = want[i] = (total + (x or 0), top if y is None else y if top is None else max(top, y))
    for parts in (1, 9, 60):
        got = running(d, "k", ["o", "i"], {"total": F.col("x")}, {"top": F.col("y")}, parts)
        assert got.columns == ["k", "o", "i", "x", "y", "_range", "_key", "_told", "_before", "total", "top"]
        assert {x.i: (x.total, x.top) for x in got.collect()} == want
    assert running(d.limit(0), "k", ["o"], {"total": F.col("x")}).count() == 0


def test_a_hot_key_is_many_ranges(spark):
    d = spark.range(50_000).selectExpr("'hot' as k", "id as o", "1 as x")
    got = running(d, "k", ["o"], {"t": F.col("x")}, parts=20)
    assert got.where("t <> o + 1").count() == 0
    sizes = [x["count"] for x in got.groupBy(F.floor(F.col("o") / 2500).alias("b")).count().collect()]
    assert len(sizes) == 20


def test_the_curve_is_that_of_every_threshold(spark):
    r = random.Random(7)
    rows = [(r.choice(["a", "a", "a", None]), r.choice([None, 0.5, 0.5, round(r.random(), 2)]), r.choice([True, False, None])) for _ in range(1500)] + [("none found", None, True), ("one", 0.3, False)]
    d = spark.createDataFrame(rows, "g string, score double, expected boolean").selectExpr("*", "1 as tp", "2 as s")
    got = {(x.g, x.threshold): x for x in threshold_curve(d, "g", parts=5).collect()}
    assert set(got) == {(g, s) for g, s, _ in rows if s is not None}
    for (g, s), x in got.items():
        own = [(t is not None and t >= s, bool(y)) for h, t, y in rows if h == g]
        tp, fp, fn, tn = (sum(f == a and y == b for f, y in own) for a, b in ((True, True), (True, False), (False, True), (False, False)))
        assert (x.tp, x.fp, x.fn, x.tn) == (tp, fp, fn, tn)
        rate = lambda a, b: a / b if b else None
        for told, want in ((x.precision, rate(tp, tp + fp)), (x.recall, rate(tp, tp + fn)), (x.f1, rate(2 * tp, 2 * tp + fp + fn))):
            assert told == want if want is None else abs(told - want) < 1e-12
    assert threshold_curve(d.limit(0), "g").count() == 0
