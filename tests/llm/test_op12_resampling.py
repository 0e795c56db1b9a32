import hashlib
import math
import random
import re
import zlib

import pytest

from quillgate.llm import resampling
from quillgate.llm.resampling import importance_weights, resample

SCHEMA = "doc_id long, text string"


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(rows, target, width=1, buckets=10_000, share=10, least=20, seed="2024"):
    feats = lambda w: [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for f in feats(plain_words(x)):
            s[bucket(f)] += 1
    for x in target:
        for f in feats(plain_words(x)):
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in rows:
        w = plain_words(x)
        f = feats(w)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: share * len(able) // 100]
    return sorted(((r[0], r[1], r[2], r[3], next((k for k, d in enumerate(drawn, 1) if d is r), None)) for r in out), key=str)


def table():
    r = random.Random(8)
    some = [f"w{i}" for i in range(60)] + ["Über", "naïve", "x1", "É"]
    rows = [(i, " ".join(r.choice(some) for _ in range(r.choice([5, 19, 20, 21, 60])))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "... --- !!!"), (1003, "W1,w2;W3\x00w4"), (1004, "big " * 50_000 + "w1"), (1004, "w5 " * 30), (1005, "hot " * 25), (None, "w7 w8 " * 20)]
    # ties: rows of one id, and copies of one text
    return rows + [(2000, "w1 w2 w3 " * 9)] * 5


TARGET = ["w1 w2 W3 w1", None, "", "über naïve w9", "other words"]


@pytest.mark.parametrize("width,share,block", [(1, 10, 1 << 22), (1, 35, 300), (2, 10, 2000)])
def test_rows(spark, monkeypatch, width, share, block):
    monkeypatch.setattr(resampling.block_features, "__defaults__", (width, block))
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as weight", "2 as id", "3 as block", "4 as `a.b`", "5 as k")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string").selectExpr("*", "1 as feature", "2 as n")
    got = resample(importance_weights(docs, target, width=width), share=share).collect()
    assert sorted(((r.id, r.n_features, r.weight, r.score, r.rank) for r in got), key=str) == plain(rows, TARGET, width, share=share)


def test_every_share(spark):
    rows = [(i, " ".join(f"a{(i * k) % 7}" for k in range(25))) for i in range(50)]
    w = importance_weights(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a1 a2",)], "text string"), buckets=50).cache()
    for share in (0, 1, 2, 50, 99, 100):
        got = sorted(r.rank for r in resample(w, share).collect() if r.rank)
        assert got == list(range(1, share * 50 // 100 + 1))
    assert resample(w, 10, least_words=10**6).where("rank is not null").count() == 0


def test_many_copies_of_a_row_without_an_id(spark):
    rows = [(None, "same " * 30)] * 3000 + [(i, "w " * 30) for i in range(300)]
    w = importance_weights(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("w",)], "text string"))
    got = resample(w, 50)
    assert sorted(r.rank for r in got.where("rank is not null").collect()) == list(range(1, 1651)) and got.count() == 3300


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert resample(importance_weights(none, docs)).count() == 0
    assert [r.weight for r in importance_weights(docs, none).collect()] == [(math.floor(1000 * math.log(10_002 / (2 * 10_000.0))))]
    assert [tuple(r)[:3] for r in resample(importance_weights(spark.createDataFrame([(1, None)], SCHEMA), none)).collect()] == [(1, 0, 0)]
