"""Toxicity: a linear classifier regularised by counterfactuals.

Features are the words of a text and their beginnings of four to six bytes, present or not,
hashed to a table. A logistic model is fitted on a bounded sample of labelled texts with an
L1 penalty, so most features get no weight, and with a counterfactual penalty: in all
sentences of the sample that name identity groups every such term is swapped for every other
one, and the squared change of the score is added to the loss. A mention of a group then
can't carry a verdict, however the labels are skewed.

Sampled texts are learned from whole. The executors turn them into features and swaps into
the few features that they change; the driver gets these numbers, not the texts.

A word is a run of ASCII letters and digits and of bytes beyond ASCII, lower-cased.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm._learn import fold, labelled_sample
from quillgate.llm._words import batches, hash_spans, spans

#: Labelled rows of each label; hashed features; sampled texts that have a feature at least.
SAMPLE, FEATURES, LEAST_TEXTS = 3000, 1 << 20, 3
PREFIXES = (4, 5, 6)
#: Weights of the penalties; the fit has settled when its loss falls by less than this part in ten rounds.
L1, PAIRED, SETTLED, ROUNDS = 2e-4, 1.0, 1e-4, 5000
IDENTITIES = (
    "women", "men", "gay", "straight", "lesbian", "trans", "black", "white", "asian", "latino", "jewish", "muslim",
    "christian", "hindu", "buddhist", "atheist", "immigrants", "refugees", "foreigners", "natives", "old", "young", "deaf", "blind", "disabled",
)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and beginning, repeats included."""
    raw = [t.lower().encode() for t in texts]
    b = np.frombuffer(b"\n".join(raw), np.uint8)
    at = np.concatenate(([0], np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))))
    s, e = spans(b, ~_WORD[b])
    text = np.searchsorted(at, s, side="right") - 1
    out, own = [hash_spans(b, s, e)], [text]
    for n in PREFIXES:
        long = e - s > n
        out.append(hash_spans(b, s[long], s[long] + n) ^ np.uint64(0x5851F42D4C957F2D))
        own.append(text[long])
    return np.concatenate(own), (np.concatenate(out) >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)


def feature_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct features of each text."""
    out = []
    for at in range(0, len(texts), 100):
        row, f = features(texts[at : at + 100])
        pair = np.unique(row * FEATURES + f)
        cut = np.searchsorted(pair // FEATURES, np.arange(1, len(texts[at : at + 100])))
        out += np.split((pair % FEATURES).astype(np.int32), cut)
    return out


@dataclass
class ToxicityModel:
    weights: dict[int, float]
    shift: float

    def table(self) -> np.ndarray:
        w = np.zeros(FEATURES, np.float32)
        if self.weights:
            w[np.fromiter(self.weights, np.int64)] = np.fromiter(self.weights.values(), np.float32)
        return w

    def score(self, texts: list[str], table: np.ndarray | None = None) -> np.ndarray:
        table = self.table() if table is None else table
        row, f = features(texts)
        own = table[f] != 0
        pair = np.unique(row[own] * FEATURES + f[own])
        z = np.bincount(pair // FEATURES, table[pair % FEATURES].astype(np.float64), len(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_NAMED = re.compile(r"\b(" + "|".join(IDENTITIES) + r")\b", re.IGNORECASE)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def counterfactuals(texts: list[str]) -> Iterator[tuple[str, list[str]]]:
    """For each group named in each sentence: the sentence, and it with the term swapped for
    every other one."""
    for t in texts:
        for m in _SENTENCE.finditer(t):
            for term in sorted({x.lower() for x in _NAMED.findall(m[0])}):
                own = re.compile(rf"\b{term}\b", re.IGNORECASE)
                yield m[0], [own.sub(other, m[0]) for other in IDENTITIES if other != term]


def changes(text: str) -> Counter:
    """How often swaps in a text change which features: bytes of those that come, and of
    those that go as -1 - feature. Swaps that change none are left out."""
    found: Counter = Counter()
    for plain, swapped in counterfactuals([text]):
        before, *after = feature_sets([plain, *swapped])
        for f in after:
            come, go = np.setdiff1d(f, before, assume_unique=True), np.setdiff1d(before, f, assume_unique=True)
            found[np.concatenate((come, -1 - go)).astype("<i4").tobytes()] += 1
    return found


def _rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values and where each set that has some begins."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([np.empty(0, np.int32), *sets]), (np.cumsum(n) - n)


class Sparse:
    """A matrix of 1 (or ``sign``) with fast products from both sides."""

    def __init__(self, sets: list[np.ndarray], width: int, signs: list[np.ndarray] | None = None):
        self.n, self.width = len(sets), width
        self.col, at = _rows(sets)
        self.sign = None if signs is None else np.concatenate([np.empty(0), *signs])
        self.full = np.flatnonzero(np.fromiter(map(len, sets), np.int64, len(sets)))
        self.at = at[self.full]
        order = np.argsort(self.col, kind="stable").astype(np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.fromiter(map(len, sets), np.int64, len(sets)))[order]
        self.sign_by_col = None if signs is None else self.sign[order]
        self.used, self.at_col = np.unique(self.col[order], return_index=True)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.full):
            v = w[self.col]
            out[self.full] = np.add.reduceat(v if self.sign is None else v * self.sign, self.at)
        return out

    def back(self, e: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        if len(self.used):
            v = e[self.row]
            out[self.used] = np.add.reduceat(v if self.sign_by_col is None else v * self.sign_by_col, self.at_col)
        return out


class Loss:
    """Logistic loss, weighed as if ``share`` of the texts were toxic, + paired * mean
    squared score change of the swaps; its value and gradient at weights and shift."""

    def __init__(self, texts: Sparse, y: np.ndarray, share: float, swaps: Sparse, counts: np.ndarray, paired: float):
        self.texts, self.y, self.swaps = texts, y, swaps
        self.weigh = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
        self.pair = paired * counts / max(1.0, counts.sum())

    def __call__(self, w: np.ndarray, s: float, gradient: bool = True) -> tuple:
        z = self.texts.dot(w) + s
        change = self.swaps.dot(w)
        value = float((self.weigh * (np.logaddexp(0, z) - self.y * z)).sum() + (self.pair * change**2).sum())
        if not gradient:
            return (value,)
        e = self.weigh * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.y)
        return value, self.texts.back(e) + self.swaps.back(2 * self.pair * change), float(e.sum())


def fit_sets(sets: list[np.ndarray], labels: np.ndarray, swaps: Counter, share: float = 0.5, l1: float = L1, paired: float = PAIRED, rounds: int = ROUNDS, settled: float = SETTLED) -> ToxicityModel:
    """Accelerated proximal gradient, begun again where it overshoots, on Loss + l1 * |w|,
    until it has settled; a fit that ends before says so."""
    y = np.asarray(labels, float)
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, start)
    # a feature of one or two texts teaches nothing
    seen = np.bincount(np.concatenate(sets), minlength=FEATURES)
    wanted = seen >= LEAST_TEXTS
    used = np.flatnonzero(wanted)
    place = (np.cumsum(wanted) - 1).astype(np.int32)
    d = [np.frombuffer(k, "<i4") for k in swaps]
    f = [np.where(x < 0, -1 - x, x) for x in d]
    keep = [wanted[x] for x in f]
    loss = Loss(
        Sparse([place[s[wanted[s]]] for s in sets], len(used)), y, share,
        Sparse([place[x[k]] for x, k in zip(f, keep)], len(used), [np.where(x[k] < 0, -1.0, 1.0) for x, k in zip(d, keep)]), np.array(list(swaps.values()), float), paired,
    )
    w, s = np.zeros(len(used)), start
    z_w, z_s, t, step, before = w, s, 1.0, 4.0, []
    for n in range(rounds):
        value, gw, gs = loss(z_w, z_s)
        while True:  # a step that the quadratic bound allows
            new = z_w - step * gw
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            new_s = z_s - step * gs
            dw, ds = new - z_w, new_s - z_s
            now = loss(new, new_s, gradient=False)[0]
            if now <= value + gw @ dw + gs * ds + (dw @ dw + ds * ds) / (2 * step) + 1e-12:
                break
            step /= 2
        if dw @ (new - w) + ds * (new_s - s) < 0:  # on past the valley's floor
            t = 1.0
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z_w, z_s = new + (t - 1) / t_new * (new - w), new_s + (t - 1) / t_new * (new_s - s)
        w, s, t = new, new_s, t_new
        before.append(now + l1 * float(np.abs(w).sum()))
        if n >= 10 and before[-11] - before[-1] < settled * before[-1]:
            break
        step *= 1.1
    else:
        warnings.warn(f"the fit hasn't settled in {rounds} rounds", stacklevel=2)
    own = np.flatnonzero(w)
    return ToxicityModel(dict(zip(used[own].tolist(), w[own].tolist())), s)


def fit(texts: list[str], labels: np.ndarray, share: float = 0.5, l1: float = L1, paired: float = PAIRED, rounds: int = ROUNDS, settled: float = SETTLED) -> ToxicityModel:
    """:func:`fit_sets` of texts."""
    return fit_sets(feature_sets(texts), labels, sum(map(changes, texts), Counter()), share, l1, paired, rounds, settled)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> ToxicityModel:
    """Fits on at most ``sample`` whole rows of each label. Nulls and other labels than 0 and
    1 are left out, repeated labels and ids as in :func:`labelled_sample`; without rows of
    both labels the score is the same for all texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column("text").to_pylist()
            swaps = [changes(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), b.column("spot"), pa.array([f.tobytes() for f in feature_sets(texts)], pa.binary()), pa.array([list(c) for c in swaps], pa.list_(pa.binary())), pa.array([list(c.values()) for c in swaps], pa.list_(pa.int64()))],
                names=["label", "spot", "features", "swaps", "counts"],
            )

    labels = labels.withColumn(label_col, F.col(label_col).cast("int"))
    share = labels.where(F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0]
    rows = labelled_sample(docs, labels, label_col, sample, id_col, text_col)
    # 2 * sample rows at most
    got = rows.mapInArrow(run, "label int, spot string, features binary, swaps array<binary>, counts array<long>").toArrow().sort_by([("spot", "ascending"), ("label", "ascending")])
    swaps: Counter = Counter()
    for own, n in zip(got.column("swaps").to_pylist(), got.column("counts").to_pylist()):
        swaps.update(dict(zip(own, n)))
    sets = [np.frombuffer(x.as_buffer(), np.int32) if len(x.as_py()) else np.empty(0, np.int32) for x in got.column("features")]
    return fit_sets(sets, got.column("label").to_numpy(), swaps, 0.5 if share is None else min(max(share, 0.01), 0.99))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and score (0 to 1, higher: toxic likelier) of the
    whole text. Null and empty texts have the score of no words; null ids and repeated rows
    stay; an empty table gives no rows; other columns are not looked at."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for b in it:
            for first, texts in batches(b.column("_t").cast(pa.binary()).to_pylist()):
                score = model.score([t.decode() for t in texts], table)
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(first, len(texts)), pa.array(score)], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns,
    whatever their names. Null and empty texts have the score of no words; null ids and
    repeated rows are rows of their own; an empty table gives no rows."""
    columns, schema = docs.columns, docs.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for b in it:
            for first, texts in batches(b.column(columns.index(text_col)).cast(pa.binary()).to_pylist()):
                good = model.score([t.decode() for t in texts], table) < threshold
                yield b.slice(first, len(texts)).filter(pa.array(good))

    return docs.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
