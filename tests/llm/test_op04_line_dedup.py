import random

import pytest
from pyspark.sql import functions as F

from quillgate.llm.line_dedup import dedup_lines, half_keys, text_digest, variant_keys

SCHEMA = "doc_id long, text string"


def within_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, digests):
    """``digests``: what tells the texts of one id apart, in their order."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, digests[r[1] or ""]))
    out, before = {}, []
    for i, t in order:
        keep, n, gone = [], 0, 0
        for x in ([] if t is None else t.split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                n += 1
                drop = any(within_one(x, y) for y in before)
                before.append(x)
                gone += drop
                if drop:
                    continue
            keep.append(x)
        out[i] = (None if t is None else "\n".join(keep), n, gone)
    return out


def digests_of(docs):
    return {x.t: x.d for x in docs.select(F.coalesce("text", F.lit("")).alias("t"), text_digest(F.col("text")).alias("d")).collect()}


@pytest.mark.parametrize("keys", [variant_keys, lambda x: variant_keys(x) & 7], ids=["hashes", "hashes that clash"])
def test_matches_brute_force(spark, keys):
    r = random.Random(8)
    base = ["".join(r.choices("abé ", k=r.randrange(0, 12))) for _ in range(60)] + ["x" * 5000, "x" * 2500 + "y" + "x" * 2500, "aa", "a", "b", ""]

    def edited(x):
        for _ in range(r.randrange(0, 3)):
            i = r.randrange(len(x) + 1)
            x = r.choice([x[:i] + r.choice("abé日") + x[i:], x[:i] + x[i + 1 :], x[:i] + "z" + x[i + 1 :]])
        return x

    rows = [(i * 3, "\n".join(edited(r.choice(base)) for _ in range(r.randrange(0, 8)))) for i in range(90)] + [(1000, None), (1001, ""), (None, "aa\nab\nqqqq"), (1002, "\n\n \n")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 as h1", "2 as line", "3 as n")
    got = {x.doc_id: (x.text, x.n_lines, x.n_dropped) for x in dedup_lines(docs, keys=keys).collect()}
    assert got == brute(rows, digests_of(docs))


def test_repeated_rows_are_cleaned_alike(spark):
    rows = [(1, "one line\nother"), (1, "one line\nother"), (1, "one linX"), (2, "one line\nnew words"), (None, "one line"), (None, "fresh")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(x.doc_id), x.text, x.n_dropped) for x in dedup_lines(docs).collect())
    d = digests_of(docs)
    first = d["one line\nother"] < d["one linX"]
    long = ("1", "one line\nother" if first else "other", 0 if first else 1)
    assert got == sorted([long, long, ("1", "" if first else "one linX", int(first)), ("2", "new words", 1), ("None", "", 1), ("None", "fresh", 0)])


def test_a_very_long_line(spark):
    a = "".join(random.Random(4).choices("abcdef ", k=400_000))
    rows = [(1, a), (2, a[:200_000] + "!" + a[200_000:]), (3, a[:-1]), (4, a[::-1]), (5, a + "12")]
    got = {x.doc_id: x.n_dropped for x in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}


def test_keys_meet_for_every_edit():
    r = random.Random(1)
    for _ in range(300):
        a = "".join(r.choices("ab", k=r.randrange(1, 9)))
        b = "".join(r.choices("ab", k=r.randrange(1, 9)))
        if a != b and within_one(a, b):
            assert set(half_keys(a)) & set(half_keys(b))
            ka, kb = variant_keys(a).tolist(), variant_keys(b).tolist()
            same = any(x == y for x, y in zip(ka[:-1], kb[:-1])) if len(a) == len(b) else False
            assert same or kb[-1] in ka[:-1] or ka[-1] in kb[:-1]


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
