import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillgate.llm._learn import fold, labelled_sample
from quillgate.llm.toxicity import FEATURES, IDENTITIES, L1, PAIRED, changes, counterfactuals, drop_toxic, feature_sets, fit, score_toxicity, train

SCHEMA = "doc_id long, text string"


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(vocabulary, k=r.randrange(10, 200))
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(["idiot", "Moron,", "TRASH", "vequ" + r.choice(["ta", "ro", "mi", "la"])])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_filter(spark):
    rows, labels = corpus(1, 1500)
    extra = [(9001, None), (9002, ""), (None, "idiot"), (9003, "good " * 60_000 + "idiot idiot"), (9004, "vequzz here")]
    docs = spark.createDataFrame(rows + extra, SCHEMA).selectExpr("*", "'x' as toxic", "1 as score")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int").where(fold(F.col("doc_id"), 5) != 0)
    model = train(docs, known)
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [(got[i] >= 0.5, bool(y)) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.97
    assert got[None] > 0.5 and got[9003] > 0.5 and got[9004] > 0.5 and got[9001] == got[9002] < 0.5
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_counterfactuals_take_the_weight_off_a_group():
    r = random.Random(2)
    texts, labels = [], []
    for i in range(400):
        bad = i % 2
        # the group is named in most toxic sentences, and in few others
        group = "muslim" if r.random() < (0.9 if bad else 0.05) else "people"
        texts.append(f"the {group} on street {r.randrange(50)} " + r.choice(["idiot", "x", "x"] if bad else ["hello", "x", "x"]))
        labels.append(bad)
    (plain, swapped), (_, old), (_, men) = sorted(counterfactuals(["A Muslim here. None there. Men are old and Old!"]), key=lambda x: (x[0].strip(), x[1][0]))
    assert plain == "A Muslim here." and "A jewish here." in swapped and len(swapped) == len(IDENTITIES) - 1
    assert {" Men are gay and gay!"} <= set(old) | set(men) and {" gay are old and Old!"} <= set(old) | set(men)
    named, other = ([f"the {g} on street {k} hello" for k in range(20)] for g in ("muslim", "christian"))

    def gap(paired):
        model = fit(texts, np.array(labels), paired=paired)
        a, b = (np.log(p / (1 - p)) for p in (model.score(named), model.score(other)))
        return np.abs(a - b).mean()

    assert gap(0.0) > 1 and gap(5.0) < gap(0.0) / 3


def test_fit_is_that_of_plain_gradient_steps():
    r = random.Random(4)
    words = [f"w{k}" for k in range(12)] + ["idiot", "muslim", "women"]
    texts = [" ".join(r.choices(words, k=6)) + "." for _ in range(150)]
    labels = np.array([int("idiot" in t or r.random() < 0.1) for t in texts])
    model = fit(texts, labels, share=0.3, settled=1e-9)
    sets, swaps = feature_sets(texts), sum(map(changes, texts), Counter())
    used = np.flatnonzero(np.bincount(np.concatenate(sets), minlength=FEATURES) >= 3)
    X = np.array([np.isin(used, s) for s in sets], float)
    D, n = np.zeros((len(swaps), len(used))), np.array(list(swaps.values()), float)
    for row, k in zip(D, swaps):
        for f in np.frombuffer(k, "<i4"):
            row[used == (-1 - f if f < 0 else f)] += -1 if f < 0 else 1
    assert sum(swaps.values()) == sum(len(b) for _, b in counterfactuals(texts))
    weigh = np.where(labels == 1, 0.3 / labels.mean(), 0.7 / (1 - labels.mean())) / len(texts)

    def loss(w, s):
        z = X @ w + s
        return (weigh * (np.logaddexp(0, z) - labels * z)).sum() + PAIRED * (n * (D @ w) ** 2).sum() / n.sum() + L1 * np.abs(w).sum()

    w, s, step = np.zeros(len(used)), 0.0, 0.1
    for _ in range(120_000):
        z = X @ w + s
        e = weigh * (1 / (1 + np.exp(-z)) - labels)
        g = X.T @ e + 2 * PAIRED * D.T @ (n * (D @ w)) / n.sum()
        w, s = w - step * g, s - step * e.sum()
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
    own = np.array([model.weights.get(f, 0.0) for f in used.tolist()])
    assert loss(own, model.shift) < loss(w, s) * 1.001 and set(model.weights) <= set(used.tolist())
    assert np.abs(model.score(texts) - 1 / (1 + np.exp(-(X @ w + s)))).max() < 0.02


def test_repeated_labels_and_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (None, "x"), (3, "c")], SCHEMA)
    labels = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1), (None, 1), (3, None), (3, 2), (9, 1)], "doc_id long, toxic int")
    assert sorted((r.label, r.text) for r in labelled_sample(docs, labels, "toxic", 10).collect()) == [(0, ""), (1, ""), (1, "")]
    assert labelled_sample(docs, labels, "toxic", 1).count() <= 2


def test_no_labels_and_no_rows(spark):
    docs, labels = spark.createDataFrame([(1, "a")], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score_toxicity(docs, train(docs, labels)).collect()] == [0.5]
    assert score_toxicity(docs.limit(0), train(docs, labels)).count() == 0
