import random

from quillgate.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes, share=1.5, most=2):
    """Water-filling by rounds: cap, reshare the excess by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in target]
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= most * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        if len(target) == len(order):
            return target


def test_targets_and_taken(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(1, 400)), r.choice(["a", "a", "a", "b", "c", "é", "d", None, ""])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "a"), (None, "x y z", "a"), (5002, "q " * 20_000, "b"), (5003, "w w", "c"), (5003, "w w", "c"), (5004, None, "only empty")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for shard_docs in (50, 10_000):
        got = mix_sources(docs.selectExpr("*", "1 as size", "2 as id", "3 as shard"), shard_docs=shard_docs).collect()
        assert len(got) == len(rows)
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len((t or "").split())
        want, taken, src = brute_targets(sizes), {}, {i: s for i, _, s in rows}
        for x in got:
            s = src[x.doc_id]
            assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 * max(1, want[s])
            assert 0 <= x.taken <= 2 * x.size
            taken[s] = taken.get(s, 0) + x.taken
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 64, (s, taken[s], want[s])
        again = mix_sources(docs.repartition(7), shard_docs=shard_docs).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


def test_most_documents_are_taken_whole(spark):
    rows = [(i, "w " * 300, f"s{i % 3}") for i in range(600)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(x.taken % x.size != 0 for x in got) <= 6


def test_empty_tables(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [x.taken for x in mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)).collect()] == [0, 0]


def test_many_rows_without_an_id_are_many_places(spark):
    """40,000 of them, a third of these copies of one text, over shards of 5,000."""
    texts = ["w " * 20 if i % 3 == 0 else " ".join(["v"] * (1 + i % 50)) + f" {i}" for i in range(40_000)]
    docs = spark.createDataFrame([(None, t, "s") for t in texts] + [(1, "x y z", "t")], SCHEMA)
    got = mix_sources(docs).collect()
    assert len(got) == len(texts) + 1
    size = sum(len(t.split()) for t in texts)
    want = brute_targets({"s": size, "t": 3})
    assert abs(sum(r.taken for r in got if r.source_size == size) - want["s"]) <= 0.02 * want["s"] + 64
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_places_of_rows_without_an_id(spark, monkeypatch):
    """The shards themselves, as the plan deals them out."""
    from quillgate.llm import mixing

    seen = {}
    real = mixing.sainte_lague
    monkeypatch.setattr(mixing, "sainte_lague", lambda parts, *a: seen.setdefault(len(seen), parts) is None or real(parts, *a))
    docs = spark.createDataFrame([(None, "same text", "s")] * 4000 + [(None, f"text {i}", "s") for i in range(2000)], SCHEMA)
    mix_sources(docs, shard_docs=1000).collect()
    sizes = [r.shard_size for r in seen[1].collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * sum(sizes) / 6
