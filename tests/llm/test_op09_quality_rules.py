import math
import random
import re
from collections import Counter

import pytest

from quillgate.llm.quality_rules import CLEAN, GOOD, KINDS, PRIOR, ROUNDS, default_rules, posteriors, quality_rules, start_rates

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def stats(text):
    t = text or ""
    w = W.findall(t)
    lines = [x for x in t.split("\n") if W.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), base


def corpus():
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(2, 9)))
    good = [(i, " ".join(word() for _ in range(r.randrange(60, 400))).replace(" a", "\na")) for i in range(160)]
    bad = [(1000 + i, " ".join(word() + r.choice(["%%%", "&&&", "###"]) for _ in range(150))) for i in range(15)]
    bad += [(2000 + i, (" ".join(word().upper() for _ in range(40)) + "\n") * 4) for i in range(15)]
    bad += [(3000 + i, " ".join(word() + "!! " for _ in range(100)).upper()) for i in range(10)]
    edge = [(5000, None), (5001, ""), (5002, " \n\t\n"), (5003, "one"), (5004, "a b c d e f g h\x0b" * 2), (5005, "x " * 40_000), (None, "n " * 30), (5006, "a b é\x85c " * 25), (1, good[1][1]), (1, good[1][1])]
    head = [(5100 + n, " ".join(["p"] * 3 + [str(k) for k in range(30)] + ["p"] * n + [str(k) for k in range(12)])) for n in range(4)]
    return good, bad, edge + head


def test_statistics_and_verdict(spark):
    good, bad, edge = corpus()
    rows = good + bad + edge
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as n_words", "2 as votes", "3 as w")
    got = quality_rules(docs)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = got.collect()
    assert sorted((str(x.doc_id), *x[1:7]) for x in got) == sorted((str(i), *stats(t)) for i, t in rows)
    by = {x.doc_id: x for x in got}
    assert all(not (x.base_failed and x.kept) for x in got)
    assert all(by[i].kept for i, _ in good)
    assert not any(by[i].kept for i, _ in bad)


def plain_em(patterns, rules, clean, kinds, rounds=ROUNDS):
    """EM in plain Python over {votes: count}."""
    b0 = start_rates(rules, clean) + start_rates(rules, kinds)
    n_class, n_rule, n = len(b0), len(b0[0]), sum(patterns.values())
    pi, b = [GOOD / len(clean)] * len(clean) + [(1 - GOOD) / len(kinds)] * len(kinds), b0

    def classes(v):
        logs = [math.log(pi[c]) + sum(math.log(b[c][j] if v[j] == 0 else 1 - b[c][j]) for j in range(n_rule) if v[j] is not None) for c in range(n_class)]
        over = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(over) for x in over]

    for _ in range(rounds):
        g = {v: [k * x for x in classes(v)] for v, k in patterns.items()}
        share = lambda c, j: (sum(w[c] for v, w in g.items() if v[j] == 0) + PRIOR * b0[c][j]) / (sum(w[c] for v, w in g.items() if v[j] is not None) + PRIOR)
        pi, b = [(sum(w[c] for w in g.values()) + 1) / (n + n_class) for c in range(n_class)], [[share(c, j) for j in range(n_rule)] for c in range(n_class)]
    return {v: sum(classes(v)[: len(clean)]) for v in patterns}


def votes_of(n, chars, symbols, lines, dup_lines, repeats, distinct, upper, letters, marks, bare):
    high = lambda x, bad, good: None if x is None else 0 if x > bad else 1 if x <= good else None
    low = lambda x, bad, good: None if x is None else 0 if x < bad else 1 if x > good else None
    share = lambda a, b: a / b if b else None
    mean, dup = share(chars, n), share(dup_lines, lines)
    return (
        high(share(symbols, n), 0.1, 0.05), low(share(letters, chars), 0.9, 0.95), high(share(bare, n), 0.05, 0.02), high(share(marks, n), 0.1, 0.05), high(share(upper, chars), 0.2, 0.1),
        high(share(repeats, n), 0.1, 0.02), 0 if dup is not None and dup > 0.1 else 1 if lines > 1 and dup <= 0.02 else None,
        None if mean is None else 0 if mean < 4 or mean > 6.5 else 1 if 4.5 <= mean <= 6 else None, low(n, 50, 99), low(share(distinct, n), 0.4, 0.5),
    )


def test_posteriors_are_those_of_plain_em(spark):
    good, bad, edge = corpus()
    # short clean texts, against which one rule votes
    docs = [t or "" for _, t in good + bad + edge] + [" ".join(t.split()[:35]) for _, t in good[:12]]
    patterns, failed = Counter(), {}
    for t in docs:
        n, chars, symbols, dup, repeats, base = stats(t)
        words = W.findall(t)
        letter = lambda x: x.isalpha()
        v = votes_of(
            n, chars, symbols, len([x for x in t.split("\n") if W.search(x)]), dup, repeats, len(set(words)), sum(x.isupper() for x in t), sum(map(letter, t)),
            t.count("!") + t.count("?"), sum(not any(letter(c) or c.isnumeric() for c in x) for x in words),
        )
        patterns[v] += 1
        failed[t] = (v, base)
    told = plain_em(patterns, list(default_rules()), CLEAN, KINDS)
    got = quality_rules(spark.createDataFrame(list(enumerate(docs)), SCHEMA)).collect()
    for r in got:
        v, base = failed[docs[r.doc_id]]
        assert abs(r.posterior - told[v]) < 1e-6 and r.kept == (not base and told[v] >= 0.5) and r.n_bad_votes == v.count(0)
    # EM decides: texts that fail a rule are kept
    assert sum(r.kept and r.n_bad_votes > 0 for r in got) > 3


def test_a_vote_of_a_noisy_rule_is_outvoted(spark):
    r = random.Random(3)
    rows = []
    for i in range(2000):
        bad = i % 10 == 0
        rows.append((i, bad, [int(r.random() > (0.9 if bad else p)) for p in (0.02, 0.02, 0.3)] + [None if r.random() < 0.5 else int(r.random() > (0.9 if bad else 0.02))]))
    votes = spark.createDataFrame(rows, "i int, bad boolean, votes array<int>")
    told = {tuple(x.votes): x.posterior for x in posteriors(votes, "votes", list("abcd")).collect()}
    assert told == pytest.approx(plain_em(Counter(tuple(v) for _, _, v in rows), list("abcd"), {"good": ()}, {"bad": tuple("abcd")}), abs=1e-6)
    assert told[1, 1, 0, 1] > 0.5 > told[0, 0, 1, 1]
    right = sum((told[tuple(v)] < 0.5) == bad for _, bad, v in rows)
    assert right > 0.98 * len(rows) > sum((0 in v) == bad for _, bad, v in rows) + 300


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
