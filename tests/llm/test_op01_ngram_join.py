import random
import re

import numpy as np
import pytest

from quillgate.llm import ngram_join
from quillgate.llm.ngram_join import ngram_jaccard_join

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    sets = []
    for i, t in rows:
        w = W.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    own = list(range(len(rows)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                own[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), None if i is None else least[root(k)], links[k]) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, n, words=400):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    passage = r.choices(vocabulary, k=30)
    out, i = [], 0
    while len(out) < n:
        base = r.choices(vocabulary, k=r.choice([1, 3, 5, 12, 60, 150]))
        if r.random() < 0.4:
            base += passage
        for _ in range(r.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(r.randrange(0, 1 + len(own) // 15)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            out.append((i, " ".join(own) if r.random() < 0.8 else "\n ".join(own).upper()))
            i += 7
    return out


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a\x0bB "), (6, "a b c"), (9, "x " * 30000), (8, "x " * 7), (None, "a b"), (10, "a b"), (10, "a b"), (11, "é\xa0b Ä c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # many chunks and buckets
        for k, v in (("CHUNK", 900), ("FLUSH", 500), ("BUCKET", 300)):
            monkeypatch.setattr(ngram_join, k, v)
    rows = corpus(seed, 250) + EDGE
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_jaccard_join(docs.selectExpr("*", "1 as rep", "2 as h1", "'x' as n"))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [80, 100])
def test_other_bounds_and_sizes_next_to_bands(spark, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 60)
    base = [f"v{k}" for k in range(90)]
    rows = [(n, " ".join(base[: n + 4])) for n in range(1, 80)] + [(200 + n, " ".join(base[:n])) for n in (9, 24, 25)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    links = {(a, b) for a, x in rows for b, y in rows if a != b and 100 * (min(s := len(x.split()) - 4, t := len(y.split()) - 4)) >= percent * max(s, t)}
    assert {r.doc_id: r.n_links for r in got} == {a: sum(x == a for x, _ in links) for a, _ in rows}


def test_ids_that_repeat_with_other_texts(spark):
    rows = corpus(9, 60)
    rows = [(i % 5, t) for i, t in rows]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_many_near_copies_of_one_text(spark):
    r = random.Random(5)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        own[r.randrange(120)] = f"u{i}"
        rows.append((i, " ".join(own)))
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)


def test_search_of_a_block_against_all_pairs():
    r = np.random.default_rng(3)
    for count, size, span, percent in ((60, 40, 60, 80), (200, 12, 30, 60), (120, 90, 95, 80), (40, 1, 3, 100)):
        base = r.choice(10 * span, span, replace=False)
        own = [np.unique(np.concatenate((r.choice(base, min(size, span), replace=False), r.integers(0, 10 * span, r.integers(0, 6))))).astype(np.uint64) for _ in range(count)]
        own.sort(key=len)
        block = ngram_join.Block(own, percent)
        for q in range(count):
            both = [len(np.intersect1d(own[q], own[d])) for d in range(q)]
            assert sorted(block.search(q).tolist()) == [d for d in range(q) if 100 * both[d] >= percent * (len(own[q]) + len(own[d]) - both[d])]
