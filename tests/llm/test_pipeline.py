"""The pipeline's stages on the smallest tables, each against a plain version of itself."""

import pytest

import corpus_pipeline as P
from tests.llm.test_op01_ngram_join import brute
from tests.llm.test_op10_mixing import brute_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"file://{root}/{k}")
        out.append(spark.read.parquet(f"file://{root}/{k}"))
    return [[r.asDict() for r in d.collect()] for d in out], [d.columns for d in out]


def test_stages(steps):
    (docs, clean, once, apart, mixed, packed), columns = steps
    assert all(c == columns[0] for c in columns[:5])
    # toxicity lets some go and nothing else changes
    assert 0 < len(docs) - len(clean) < len(docs) // 3 and {r["doc_id"] for r in clean} <= {r["doc_id"] for r in docs}
    last = {}
    for r in clean:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in once) == sorted(last.values())
    groups = brute([(r["doc_id"], r["text"]) for r in once])
    assert sorted(r["doc_id"] for r in apart) == sorted(i for i, _, c, _ in groups if i == c)
    size, words = {}, {r["doc_id"]: len(r["text"].split()) for r in apart}
    for r in apart:
        size[r["source"]] = size.get(r["source"], 0) + words[r["doc_id"]]
    times, taken = {}, {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + words[r["doc_id"]]
    assert set(times) <= set(words) and max(times.values()) <= 2
    for s, target in brute_targets(size).items():
        longest = max(words[r["doc_id"]] for r in apart if r["source"] == s)
        assert abs(taken.get(s, 0) - target) <= longest + 64
    first = {}
    for r in packed:
        first[r["doc_id"]] = first.get(r["doc_id"], 0) + (r["piece"] == 0)
    assert first == times


CLASHING = ["row_key", "row_component", "row_maybe", "row_of", "row_times", "row_copy", "gone_file", "file", "row", "sketch_w", "maybe"]


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('labels')}"
    rows = [(1000 + k, 1, int(k % 8 == 1)) for k in range(160)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def stages_of(spark, rows, sf_dir):
    """The rows that each stage keeps, all of them with columns that clash."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.selectExpr("*", *(f"doc_id as {c}" for c in CLASHING))
    out = []
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert all(r[c] == r["doc_id"] for r in docs.collect() for c in CLASHING)
        out.append([(r.doc_id, r.text) for r in docs.collect()])
    return out, P.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_edge_rows(spark, labels_dir):
    row = lambda i, t, s="a": (i, t, None, s, None)
    near = [f"v{k}" for k in range(60)]
    good = [row(1000 + k, f"some quiet words {k} and others {k * k} of no harm " + " ".join(f"{k}x{j}" for j in range(20))) for k in range(160) if k % 8 != 1]
    bad = [row(1000 + k, f"you idiot {k} go " + " ".join(f"{k}y{j}" for j in range(20))) for k in range(160) if k % 8 == 1]
    edge = [
        row(100, None), row(101, ""), row(102, " "), row(5000, "long " * 60_000), row(None, "no id at all, one"), row(None, "another without id"), row(103, "source unknown here", None),
        row(50, "text A one two three four five"), row(30, "text A one two three four five"), row(50, "text B is not at all like it"),
        row(60, " ".join(near)), row(61, " ".join(near[:-1])), row(61, "shares the id of a copy only"), row(62, " ".join(near)), row(62, " ".join(near)),
    ]
    (clean, once, apart, mixed), packed = stages_of(spark, good + bad + edge, labels_dir)
    ids = lambda rows: sorted((i for i, _ in rows), key=lambda i: (i is None, i or 0))
    assert set(ids(clean)) == {r[0] for r in good + edge} and len(clean) == len(good + edge)
    texts = [t or "" for _, t in once]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in good + edge})
    assert all(i == max((r[0] for r in good + edge if (r[1] or "") == (t or "") and r[0] is not None), default=None) for i, t in once)
    # 61 without the last word is near 62, which stays for nothing: the smallest id does
    gone = sorted(set(once) - set(apart), key=str)
    assert gone == [(62, " ".join(near))] and (61, "shares the id of a copy only") in apart and (50, "text B is not at all like it") in apart
    assert set(mixed) <= set(apart) and not {t for _, t in mixed} & {None, "", " "}
    assert sorted({str(r.doc_id) for r in packed}) == sorted({str(i) for i, _ in mixed})


def test_empty_table(spark, labels_dir):
    out, packed = stages_of(spark, [], labels_dir)
    assert out == [[], [], [], []] and packed == []
