r"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines within one edit (insertion, deletion or substitution of a character) either share
a variant with one character deleted at the same place, or one is such a variant of the
other. So a line emits all its deletion variants as hashed keys with the place, and itself;
equal keys are joined, the edit distance is verified on the texts, and of close lines the
earliest stays. A key's lines are reduced to the earliest, never paired with each other:

* lines with the same variant and place are one substitution apart, all of them;
* a line that is itself a variant of others is one edit apart from each of them.

Only lines that can have a close line emit variants: one edit leaves one of a line's
halves, cut by the longer line's length, as it was, so a line alone with both its halves is
left out, exactly. Variants are never stored: they travel once, as packed arrays of key,
place and the line's number in the order. A pair that isn't close after all is a clash of
keys; what it may hide is searched again with the variants themselves as keys.

The edit bound is one character; equal lines are within no edit. Order is by document id (null last), then the digest of the text, then line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm._packed import packed, spread
from quillgate.llm._sketch import marked, sketch
from quillgate.llm._store import drop, materialise
from quillgate.llm._words import mix64

_WORD = b" \t\n\x0b\x0c\r"
_KEY = np.random.default_rng(11).integers(1, 2**64, 4, dtype=np.uint64) | np.uint64(1)


def _hash(*parts: str | int) -> int:
    h = xxhash.xxh3_64()
    for p in parts:
        h.update(p.encode() if isinstance(p, str) else b"\x00%d\x00" % p)
    return h.intdigest() - 2**63


def half_keys(line: str) -> list[int]:
    """What a line shares with every line within one edit: one of its halves, for either
    length of the longer line."""
    n, out = len(line), []
    for longer in (n, n + 1):
        a = longer // 2
        out += [_hash(longer, 0, line[:a]), _hash(longer, 1, line[n - (longer - a) :])]
    return out


def variant_keys(line: str) -> np.ndarray:
    """Hashes of the line without its character i, for all i, and of the line itself last.

    Polynomials over the characters, so all variants take time in proportion to the line."""
    c = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
    n, base = len(c), _KEY[0]
    power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base), dtype=np.uint64)))
    term = (c + _KEY[1]) * (c * _KEY[2] + _KEY[3])
    with np.errstate(over="ignore"):
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term * power[:n], dtype=np.uint64)))
        moved = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term[1:] * power[: n - 1], dtype=np.uint64))) if n > 1 else np.zeros(1, np.uint64)
        # without i: the terms before it, and those behind it one place to the left
        without = before[:n] + (moved[-1] - moved)
        whole = before[n:]
        x = np.concatenate((without + np.uint64(n - 1) * _KEY[3], whole + np.uint64(n) * _KEY[3]))
    x ^= x >> np.uint64(29)
    return (x * _KEY[2]).view(np.int64)


#: Postings of a packed row, and of a partition that joins them.
FLUSH, BUCKET = 1_000_000, 1_000_000
_LINE = "_id {id}, dh long, line int, h1 long, h2 long, halves array<long>"


def _hashed(text: str) -> tuple[int, int]:
    v = np.frombuffer(xxhash.xxh3_128_digest(text.encode()), ">i8")
    return int(v[0]), int(v[1])


def text_digest(text: Column) -> Column:
    """Tells the texts of rows with one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest of the text, line number from 0, digest of the line, half keys) of every
    line that has a word."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, line, h, halves = [], [], [], []
            for i, t in enumerate(b.column("_t").to_pylist()):
                for k, x in enumerate((t or "").split("\n")):
                    if x.encode().strip(_WORD):
                        at.append(i)
                        line.append(k)
                        h.append(_hashed(x))
                        halves.append(half_keys(x))
                if len(at) >= 50_000 or i + 1 == b.num_rows:
                    hh, own = np.array(h, np.int64).reshape(-1, 2), pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column("_id").take(own), b.column("dh").take(own), pa.array(line, pa.int32()), pa.array(hh[:, 0]), pa.array(hh[:, 1]), pa.array(halves, pa.list_(pa.int64()))],
                        names=["_id", "dh", "line", "h1", "h2", "halves"],
                    )
                    at, line, h, halves = [], [], [], []

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), text_digest(F.col(text_col)).alias("dh")).mapInArrow(run, _LINE.format(id=kind))


def _candidates(distinct: DataFrame) -> DataFrame:
    """(h1, h2, first, ord) of the lines that share a half with another; ``ord`` has their order."""
    keyed = distinct.select("h1", "h2", F.explode("halves").alias("half"))
    ends = [f(c) for c in ("h1", "h2") for f in (F.min, F.max)]
    both = keyed.groupBy("half").agg(*(x.alias(f"e{k}") for k, x in enumerate(ends))).where("e0 != e1 or e2 != e3").select("half")
    own = keyed.join(both, "half", "left_semi").select("h1", "h2").distinct()
    held = materialise(distinct.join(own, ["h1", "h2"]).select("h1", "h2", "first"), "line-candidates")
    ordered = materialise(held.orderBy("first").withColumn("ord", F.monotonically_increasing_id()), "line-order")
    drop(held)
    return ordered


def _joined_to(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, how: str = "inner") -> tuple[DataFrame, DataFrame]:
    """Rows (id, text, digest) that ``table`` (_w, _dh, ...) has, joined to it; and those that
    it surely hasn't. Only the former are shuffled."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), text_digest(F.col(text_col)).alias("dh"))
    key = lambda i, h: F.xxhash64(F.col(i), F.col(h))
    d = marked(d, key("_id", "dh"), sketch(table, key("_w", "_dh")), "maybe")
    on = F.col("_id").eqNullSafe(F.col("_w")) & (F.col("dh") == F.col("_dh"))
    return d.where("maybe").drop("maybe").join(table, on, how), d.where("not maybe").drop("maybe")


def _line_texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their wanted lines to (ord, text of the line)."""
    for b in it:
        for t, wanted in zip(b.column("_t").to_pylist(), b.column("wanted").to_pylist()):
            lines = (t or "").split("\n")
            yield pa.RecordBatch.from_arrays([pa.array([w["ord"] for w in wanted], pa.int64()), pa.array([lines[w["line"]] for w in wanted], pa.string())], names=["ord", "text"])


def _keyed(texts: list[str], keys: Callable[[str], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, places) of each line; the place of the line itself is -1."""
    for x in texts:
        k = keys(x)
        yield k, np.concatenate((np.arange(len(k) - 1), [-1])).astype(np.int32)


def _postings(buckets: int, keys: Callable[[str], np.ndarray]) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            k, p, o = (np.concatenate(x) for x in zip(*held))
            return packed(spread(mix64(k.view(np.uint64)), buckets), k, p, o)

        for b in it:
            for o, (k, p) in zip(b.column("ord").to_pylist(), _keyed(b.column("text").to_pylist(), keys)):
                held.append((k, p, np.full(len(k), o, np.int64)))
                size += len(k)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(later, earlier): for each line its earliest partner among these postings."""
    got = list(it)
    k, p, o = (np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for b in got for x in b.column(c).to_pylist())]) for c, kind in (("a", np.int64), ("b", np.int32), ("c", np.int64)))
    if not len(k):
        return
    order = np.lexsort((o, p, k))
    k, p, o = k[order], p[order], o[order]
    # a substitution: the same variant and place; the earliest line of each
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])))
    least = o[np.flatnonzero(new)][np.cumsum(new) - 1]
    swap = (p >= 0) & (least != o)
    later, earlier = [o[swap]], [least[swap]]
    # an insertion: a line that is a variant of others, both ways round
    one, other = p < 0, p >= 0
    lo, hi = np.searchsorted(k[one], k[other], "left"), np.searchsorted(k[one], k[other], "right")
    n = hi - lo  # 0 or 1, but for clashes
    y = np.repeat(o[other], n)
    x = o[one][np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    later.append(np.maximum(x, y))
    earlier.append(np.minimum(x, y))
    a, b = np.concatenate(later), np.concatenate(earlier)
    a, b = a[a != b], b[a != b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.empty(0, bool)
    yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], names=["later", "earlier"])


def within_one(a: str, b: str) -> bool:
    """Whether two different lines are one edit apart; in time of their length."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        close = [within_one(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("later"), pa.array(close, pa.bool_())], names=["ord", "close"])


def _close_lines(texts: DataFrame, keys: Callable[[str], np.ndarray]) -> DataFrame:
    """(ord) of the lines of ``texts`` (ord, text) that an earlier one is within one edit of."""
    total = texts.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    buckets = int(total) // BUCKET + 1
    dealt = texts.mapInArrow(_postings(buckets, keys), "to int, a binary, b binary, c binary").repartitionById(buckets, "to")
    pairs = dealt.mapInArrow(_meet, "later long, earlier long").distinct()
    of = lambda n, t: texts.select(F.col("ord").alias(n), F.col("text").alias(t))
    told = pairs.join(of("later", "x"), "later").join(of("earlier", "y"), "earlier")
    told = told.select("later", "x", "y").mapInArrow(_verified, "ord long, close boolean")
    verdict = materialise(told.groupBy("ord").agg(F.bool_or("close").alias("close"), F.bool_or(~F.col("close")).alias("clash")), "line-verdicts")
    close = verdict.where("close").select("ord")
    clash = verdict.where("clash and not close").select("ord")
    return close if clash.isEmpty() else close.union(_apart(texts, clash, keys))


def _apart(texts: DataFrame, clash: DataFrame, keys: Callable[[str], np.ndarray]) -> DataFrame:
    """The close ones of the lines ``clash``, found by the variants behind the keys they share."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for o, (k, p) in zip(b.column("ord").to_pylist(), _keyed(b.column("text").to_pylist(), keys)):
                for s in range(0, len(k), FLUSH):
                    own = k[s : s + FLUSH]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(p[s : s + FLUSH]), pa.array(np.full(len(own), o, np.int64))], names=["key", "place", "ord"])

    postings = texts.mapInArrow(run, "key long, place int, ord long")
    shared = postings.join(clash, "ord", "left_semi").select("key").distinct()
    near = postings.join(shared, "key", "left_semi").join(texts, "ord")
    variant = F.when(F.col("place") < 0, F.col("text")).otherwise(F.concat(F.expr("left(text, place)"), F.expr("substring(text, place + 2)")))
    near = materialise(near.select("ord", "place", variant.alias("v")), "line-variants")
    same = near.where("place >= 0").groupBy("v", "place").agg(F.min("ord").alias("a"))
    selves = near.where("place < 0").groupBy("v").agg(F.min("ord").alias("b"))
    longer = near.where("place >= 0").groupBy("v").agg(F.min("ord").alias("c"))
    mine = near.join(clash, "ord", "left_semi").join(same, ["v", "place"], "left").join(selves, "v", "left").join(longer, "v", "left")
    return mine.where("(place >= 0 and least(a, b) < ord) or (place < 0 and c < ord)").select("ord").distinct()


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: Callable[[str], np.ndarray] = variant_keys) -> DataFrame:
    """(_w, _dh, gone): id and text digest of every document that loses lines, and these.
    ``keys`` hashes a line's variants; whatever it is, only close lines go."""
    lines = materialise(document_lines(docs, id_col, text_col), "line-hashes")
    spot = F.struct(F.col("_id").isNull().alias("late"), F.col("_id"), F.col("dh"), F.col("line"))
    distinct = materialise(lines.groupBy("h1", "h2").agg(F.min(spot).alias("first"), F.first("halves").alias("halves")), "line-distinct")
    candidates = _candidates(distinct)
    wanted = candidates.groupBy(F.col("first._id").alias("_w"), F.col("first.dh").alias("_dh")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "ord")).alias("wanted"))
    found, _ = _joined_to(docs, materialise(wanted, "line-wanted"), id_col, text_col)
    texts = materialise(found.select("_t", "wanted").mapInArrow(_line_texts, "ord long, text string").dropDuplicates(["ord"]), "line-texts")
    close = candidates.join(_close_lines(texts, keys), "ord").select("h1", "h2", F.lit(True).alias("close"))
    verdict = distinct.select("h1", "h2", "first").join(close, ["h1", "h2"], "left")
    own = lines.select("_id", "dh", "line", "h1", "h2").join(verdict, ["h1", "h2"])
    same = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("dh") == F.col("first.dh")) & (F.col("line") == F.col("first.line"))
    gone = own.where(F.coalesce("close", F.lit(False)) | ~same).groupBy(F.col("_id").alias("_w"), F.col("dh").alias("_dh")).agg(F.collect_set("line").alias("gone"))
    told = materialise(gone, "line-gone")
    drop(lines, distinct, candidates, texts)
    return told


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: Callable[[str], np.ndarray] = variant_keys) -> DataFrame:
    """One row per row of ``docs``: id, text (without the dropped lines), n_lines, n_dropped.

    A line with a word is dropped if an earlier line of any document is equal or within one
    edit of it; lines without a word stay. Null texts stay null, empty ones empty. Rows with
    the same id and text are cleaned alike: a line is not earlier than its repeat. Rows with
    one id and other texts, null ids among them, are ordered by the digests of their texts.
    An empty table gives no rows; other columns are not looked at.
    """
    told = line_verdicts(docs, id_col, text_col, keys)
    some, none = _joined_to(docs, told, id_col, text_col, "left")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, n = [], []
            for t, gone in zip(b.column("_t").to_pylist(), b.column("gone").to_pylist()):
                lines = [] if t is None else t.split("\n")
                n.append(sum(bool(x.encode().strip(_WORD)) for x in lines))
                if gone:
                    out = set(gone)
                    t = "\n".join(x for k, x in enumerate(lines) if k not in out)
                texts.append(t)
            dropped = [len(g or ()) for g in b.column("gone").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=[id_col, text_col, "n_lines", "n_dropped"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = some.select("_id", "_t", "gone").union(none.select("_id", "_t", F.lit(None).cast("array<int>")))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, n_lines long, n_dropped long")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return told.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
