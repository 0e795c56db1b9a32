import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillgate.llm.exact_dedup import DedupStream, drop_exact_copies, exact_dedup, located, sha256

SCHEMA = "doc_id long, text string"


def rows(seed=1):
    r = random.Random(seed)
    texts = ["", "a", "A", "a ", "é", "é", "long " * 100_000, *(f"t{k}" for k in range(20))]
    own = [(i, r.choice(texts)) for i in range(150)] + [(500 + i, "hot") for i in range(100)]
    return own + [(900, None), (None, None), (None, "null ids only"), (None, "null ids only"), (7, "t1"), (7, "t1"), (600, "hot"), (600, "hot")]


def brute(own):
    groups = {}
    for i, t in own:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        kept = 0
        for i in ids:
            on = i == keep and not kept
            kept += on
            out.append((i, keep, len(ids), on, sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [sha256, lambda t: F.substring(sha256(t), 1, 1)], ids=["sha256", "digests that clash"])
def test_matches_brute_force(spark, digest):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(6).selectExpr("*", "1 as id", "2 as digest", "3 as file", "4 as row", "5 as seq")
    got = exact_dedup(docs, digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows())


def test_kept_rows_have_all_columns(spark):
    docs = spark.createDataFrame(rows(2), SCHEMA).selectExpr("*", "'x' as _keep", "7 as kept", "'y' as _own", "1 as _sha", "2 as _n", "3 as file", "4 as gone_row", "5 as sketch_w")
    got = drop_exact_copies(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, ((x.doc_id, x.text or "") for x in got.collect()))) == sorted(str((i, t)) for i, t in {(x[0], t or "") for x in brute(rows(2)) if x[3] for _, t in rows(2) if hashlib.sha256((t or "").encode()).hexdigest() == x[4]})


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drop_exact_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def stored(spark, root, rows):
    path = f"file://{root}"
    spark.createDataFrame(rows, "id long, text string").repartition(3).write.mode("append").parquet(path)
    return located(spark.read.parquet(path))


def test_state_outlives_the_stream(spark, tmp_path):
    first = DedupStream(spark)
    first.add(stored(spark, tmp_path / "a", [(1, "x"), (2, "y"), (3, "x")]))
    first.advance()
    again = DedupStream(spark, first.root)
    again.add(stored(spark, tmp_path / "b", [(9, "x"), (4, "z")]))
    again.advance()
    again.advance()
    want = {hashlib.sha256(t.encode()).hexdigest(): r for t, r in (("x", (9, 3)), ("y", (2, 1)), ("z", (4, 1)))}
    assert {x.digest: (x.id, x.rows) for x in again.state().collect()} == want


def test_contents_of_hits_are_read_back_by_their_locators(spark, tmp_path):
    short = lambda t: F.substring(sha256(t), 1, 1)
    texts = [f"t{k % 40}" for k in range(90)]
    stream = DedupStream(spark)
    for part, at in ((0, "a"), (1, "b")):
        stream.add(stored(spark, tmp_path / at, [(k, t) for k, t in enumerate(texts) if k % 2 == part]), short)
        stream.advance()
    contents = stream.contents("id", "text")
    assert sorted((x.id, x.text) for x in contents.collect()) == list(enumerate(texts))
    by = {}
    for t in texts:
        by.setdefault(hashlib.sha256(t.encode()).hexdigest()[0], []).append(t)
    hits = stream.hits(contents).collect()
    assert sorted((x.digest, x.text) for x in hits) == sorted((d, t) for d, own in by.items() if len(own) > 1 for t in own)
    state = {x.digest: (x.file, x.row) for x in stream.state().collect()}
    assert all(x.stays == ((x.file, x.row) == state[x.digest]) for x in hits)
    assert sorted(x.digest for x in stream.clashes(contents).collect()) == sorted(d for d, own in by.items() if len(set(own)) > 1)


def test_rows_that_a_plan_repeats(spark, tmp_path):
    docs = spark.read.parquet(f"file://{tmp_path / 'c'}") if (tmp_path / "c").exists() else stored(spark, tmp_path / "c", [(1, "x"), (2, "y"), (3, "x")]).select(F.col("id").alias("doc_id"), "text")
    twice = docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    assert sorted((x.doc_id, x.text) for x in drop_exact_copies(twice).collect()) == [(2, "y"), (3, "x")]
    assert sorted((x.doc_id, x.keep_id, x.group_size, x.kept) for x in exact_dedup(twice).collect()) == [(1, 3, 4, False), (1, 3, 4, False), (2, 2, 2, False), (2, 2, 2, True), (3, 3, 4, False), (3, 3, 4, True)]
