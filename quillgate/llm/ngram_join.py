"""N-gram Jaccard join: T-occurrence search with DivideSkip.

A document's set is its distinct word shingles as 64-bit hashes. Two sets link when
``100 * |A & B| >= percent * |A | B|``, so with p = percent they share at least
T = ceil(p (|A| + |B|) / (100 + p)) shingles. The search itself is the T-occurrence
problem: the inverted lists of a query's shingles are divided, the short ones merged by a
heap (each document's count must reach T less the number of long lists), the long ones
probed by binary search for the documents that are left.

What surrounds it makes it run distributed, without losing a link:

1. Texts with equal sets form a class; its rows are counted, never paired.
2. Each class emits the smallest of its shingles in a fixed order, about a third of them.
   Linked classes share a known number of these (the prefix bound for that overlap), so a
   class with fewer shared ones can't have a link and goes no further. One common line
   doesn't keep a document in.
3. Of the shared ones, the rarest suffice to bring linked classes together; each list
   ties its classes to its smallest class, and components of these ties are the blocks.
4. In each block DivideSkip finds the links. A block of many shingles is cut into bands of
   set sizes, and these into chunks; linked sets are in one band or in two that adjoin, so a
   chunk is searched against those of three bands only, each pair of chunks by a task.
5. Every task returns for each class the number of linked rows and the class its own
   links lead to: rows as many as classes, however many links there are.

Postings travel as packed arrays, not as rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from math import log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm._packed import packed, spread
from quillgate.llm._sketch import marked, sketch
from quillgate.llm._store import materialise
from quillgate.llm._words import batches, mix64, shingle_sets
from quillgate.llm.components import connected_components

WIDTH, PERCENT = 5, 80
#: Shingles of a block that one task searches at once; postings of a packed row or partition.
CHUNK, FLUSH, BUCKET = 200_000, 1_000_000, 400_000
#: How much a probe costs against a merge step, in DivideSkip's choice of the long lists.
MU = 0.002
_N_MASK = 0xFFFFFF


def need(a: np.ndarray, b: np.ndarray | int, percent: int) -> np.ndarray:
    """The overlap that links sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def least_size(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest size of a set that can link with one of size n; also its least overlap."""
    return -(-percent * n // 100)


def prefix_overlap(n: np.ndarray) -> np.ndarray:
    """How many prefix shingles two linked sets share at least, the smaller of size n."""
    return n // 10 + 1


def _digest(s: np.ndarray) -> tuple[int, int]:
    v = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8")
    return int(v[0]), int(v[1])


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _u64(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in col.to_pylist())])


def set_profiles(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, th, n, h1, h2): hash of each row's text, size and 128-bit digest of its set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for first, texts in batches(_texts(batch, "_t")):
                sets = shingle_sets(texts, width)
                h = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, len(texts)) for c in ("_id", "th")), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])],
                    names=["_id", "th", "n", "h1", "h2"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("th")).mapInArrow(run, f"_id {kind}, th long, n long, h1 long, h2 long")


def _postings(docs: DataFrame, text_col: str, width: int, percent: int, buckets: int) -> DataFrame:
    """Step 2: each row's prefix as (shingle, class key), packed by range of the shingle."""

    def flush(toks: list, keys: list) -> pa.RecordBatch:
        t, k = np.concatenate(toks), np.concatenate(keys)
        order = np.lexsort((k, t))
        t, k = t[order], k[order]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
        return packed(spread(t[new], buckets), t[new], k[new])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks, keys, held = [], [], 0
        for batch in it:
            for _, texts in batches(_texts(batch, "_t")):
                for s in shingle_sets(texts, width):
                    if n := len(s):
                        p = min(n, n - int(least_size(n, percent)) + int(prefix_overlap(n)))
                        toks.append(s[:p])
                        keys.append(np.full(p, class_key(_digest(s)[0], n), np.uint64))
                        held += p
                if held >= FLUSH:
                    yield flush(toks, keys)
                    toks, keys, held = [], [], 0
        if held:
            yield flush(toks, keys)

    return docs.select(F.col(text_col).alias("_t")).mapInArrow(run, "to int, a binary, b binary")


def class_key(h1: int, n: int) -> int:
    """What routes a class: 40 bits of its digest and its size; a clash only adds candidates."""
    return (h1 & (2**64 - 1) & ~_N_MASK) | min(n, _N_MASK)


def _key_column():
    """The same as a Spark expression over h1 and n; as a signed long."""
    return F.expr(f"(h1 & {~_N_MASK}L) | least(n, {_N_MASK}L)")


def _shared(buckets: int, percent: int):
    """Step 2, reduced: the shingles of two classes or more, packed by class."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(it)
        t = np.concatenate([np.empty(0, np.uint64), *(_u64(b.column("a")) for b in got)])
        k = np.concatenate([np.empty(0, np.uint64), *(_u64(b.column("b")) for b in got)])
        if not len(t):
            return
        order = np.lexsort((k, t))
        t, k = t[order], k[order]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
        t, k = t[new], k[new]
        _, inverse, df = np.unique(t, return_inverse=True, return_counts=True)
        df = df[inverse].astype(np.uint64)
        two = df > 1
        yield packed(spread(mix64(k[two]), buckets), k[two], t[two], df[two])

    return run


def _routes(buckets: int, percent: int):
    """Step 3: of each class that can link, the rarest shared shingles; packed by shingle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(it)
        k, t, df = (np.concatenate([np.empty(0, np.uint64), *(_u64(b.column(c)) for b in got)]) for c in "abc")
        if not len(k):
            return
        order = np.lexsort((t, df, k))
        k, t = k[order], t[order]
        key, at, count = np.unique(k, return_index=True, return_counts=True)
        least = prefix_overlap(least_size((key & np.uint64(_N_MASK)).astype(np.int64), percent))
        keep = np.where(count >= least, count - least + 1, 0)
        own = np.arange(len(k)) - np.repeat(at, count) < np.repeat(keep, count)
        yield packed(spread(t[own], buckets), t[own], k[own])

    return run


def _ties(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, reduced: (class, smallest class of a list), each pair once."""
    got = list(it)
    t, k = (np.concatenate([np.empty(0, np.uint64), *(_u64(b.column(c)) for b in got)]) for c in "ab")
    if not len(t):
        return
    order = np.lexsort((k, t))
    t, k = t[order], k[order]
    first = np.concatenate(([True], t[1:] != t[:-1]))
    least = k[np.flatnonzero(first)][np.cumsum(first) - 1]
    pairs = np.unique(np.stack((k, least), 1)[k != least], axis=0).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


class Block:
    """Sets in memory, with the inverted lists of their shingles. Sets are ordered by size."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.n = np.array([len(s) for s in sets], np.int64)
        count = len(sets)
        tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        doc = np.repeat(np.arange(count), self.n)
        self.count, self.lists = count, len(tokens)
        self.flat = np.sort(inverse.astype(np.int64) * count + doc)  # list by list, documents ascending
        self.of = np.split(inverse.astype(np.int64), np.cumsum(self.n)[:-1])

    def search(self, q: int) -> np.ndarray:
        """The sets before q (no larger ones) that link with it."""
        n, flat, D = int(self.n[q]), self.flat, self.count
        lo, hi = int(np.searchsorted(self.n, least_size(n, self.percent))), q
        if lo >= hi:
            return np.empty(0, np.int64)
        lists = self.of[q]
        left, right = np.searchsorted(flat, lists * D + lo), np.searchsorted(flat, lists * D + hi)
        own = right > left
        lists, left, right = lists[own], left[own], right[own]
        T = int(need(n, int(self.n[lo]), self.percent))
        if len(lists) < T:
            return np.empty(0, np.int64)
        size = right - left
        order = np.argsort(size, kind="stable")
        lists, left, right, size = lists[order], left[order], right[order], size[order]
        long = min(T - 1, int(T / (MU * log2(int(size[-1]) + 1) + 1)))
        short = len(lists) - long
        found, cnt = self._merge(left[:short], right[:short], lists[:short], T - long)
        enough = need(n, self.n[found], self.percent)
        stay = cnt >= enough - long
        found, cnt, enough = found[stay], cnt[stay], enough[stay]
        done = []
        for at in range(short, len(lists), 32):
            if not len(found):
                break
            own = lists[at : at + 32]
            key = (own[:, None] * D + found[None, :]).ravel()
            place = np.minimum(np.searchsorted(flat, key), len(flat) - 1)
            cnt = cnt + (flat[place] == key).reshape(len(own), -1).sum(0)
            done.append(found[cnt >= enough])
            stay = (cnt < enough) & (cnt + (len(lists) - at - len(own)) >= enough)
            found, cnt, enough = found[stay], cnt[stay], enough[stay]
        done.append(found[cnt >= enough])
        return np.concatenate(done)

    def _merge(self, left: np.ndarray, right: np.ndarray, lists: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents in ``least`` or more of the short lists, ascending, and in how many each.

        A heap holds the next posting of every list. A document at its top too few times is
        given up, and with it all before the ``least``-th posting of the heap: the lists are
        moved past these by binary search.
        """
        runs = [(self.flat[a:b] - k * self.count).tolist() for a, b, k in zip(left, right, lists)]
        width = len(runs)
        heap = [r[0] * width + i for i, r in enumerate(runs)]
        heapq.heapify(heap)
        at, found, cnt = [0] * width, [], []
        while len(heap) >= least:
            top = heap[0] // width
            stop, out = (top + 1) * width, []
            while heap and heap[0] < stop:
                out.append(heapq.heappop(heap) % width)
            if len(out) >= least:
                found.append(top)
                cnt.append(len(out))
                to = top + 1
            else:
                while len(out) < least - 1:
                    out.append(heapq.heappop(heap) % width)
                to = heap[0] // width
            for i in out:
                r = runs[i]
                at[i] = p = bisect_left(r, to, at[i])
                if p < len(r):
                    heapq.heappush(heap, r[p] * width + i)
        return np.array(found, np.int64), np.array(cnt, np.int64)


def _searched(percent: int):
    """Step 4: rows (unit, cross, side, node, rows, set), by unit, to (node, root, links)."""

    def unit(rows: list[tuple], cross: bool) -> tuple[list[int], list[int], list[int]]:
        seen: dict[int, tuple] = {}
        for r in rows:
            seen.setdefault(r[1], r)
        rows = sorted(seen.values(), key=lambda r: (len(r[3]), r[1]))
        side, node, weight = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2))
        block = Block([np.frombuffer(r[3], np.uint64) for r in rows], percent)
        parent, links = list(range(len(rows))), np.zeros(len(rows), np.int64)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for q in range(len(rows)):
            found = block.search(q)
            if cross:
                found = found[side[found] != side[q]]
            if len(found):
                links[q] += weight[found].sum()
                links[found] += weight[q]
                for f in found.tolist():
                    a, b = root(q), root(f)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        own = np.flatnonzero(links)
        return node[own].tolist(), [int(node[root(x)]) for x in own.tolist()], links[own].tolist()

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in it:
            yield from zip(*(b.column(c).to_pylist() for c in ("unit", "cross", "side", "node", "rows", "set")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, cross), own in groupby(rows(it), key=lambda r: r[:2]):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in unit([r[2:] for r in own], cross)], names=["node", "root", "links"])

    return run


def _sets(width: int):
    """Adds its set to each candidate row whose text still has the wanted digest."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            h1, h2 = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
            for first, texts in batches(_texts(batch, "_t")):
                sets = shingle_sets(texts, width)
                own = [i for i, s in enumerate(sets) if _digest(s) == (h1[first + i], h2[first + i])]
                rows = batch.take(pa.array([first + i for i in own], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("comp", "band", "parts", "below", "above", "node", "rows")), pa.array([sets[i].tobytes() for i in own], pa.binary())],
                    names=["comp", "band", "parts", "below", "above", "node", "rows", "set"],
                )

    return run


def _banded(candidates: DataFrame, percent: int) -> DataFrame:
    """Adds band, and how many chunks it and its neighbours have: 0 where the whole block is
    searched at once."""
    # a little wider than the sizes of linked sets can differ, so rounding never skips a band
    band = F.floor(F.ln(F.col("n")) / F.lit(log(100 / percent * (1 + 1e-9)))).cast("int") if percent < 100 else F.col("n").cast("int")
    c = candidates.withColumn("band", band)
    large = c.groupBy("comp").agg(F.sum("n").alias("all")).where(F.col("all") > CHUNK).select("comp")
    bands = materialise(c.join(large, "comp", "left_semi").groupBy("comp", "band").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("parts")), "ngram-bands")
    for name, by in (("parts", 0), ("below", -1), ("above", 1)):
        near = bands.select(F.col("comp").alias("bc"), (F.col("band") - by).alias("bb"), F.col("parts").alias(name))
        c = c.join(near, (F.col("comp") == F.col("bc")) & (F.col("band") == F.col("bb")), "left").drop("bc", "bb").fillna(0, [name])
    return c


def _units(with_sets: DataFrame, few: int) -> DataFrame:
    """A row for each unit that a set takes part in."""
    chunk = F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).cast("int")
    numbers = lambda n, band: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), lambda k: F.struct((F.col("band") + band).alias("band"), k.alias("chunk")))).otherwise(F.array().cast("array<struct<band:int,chunk:int>>"))
    u = with_sets.withColumn("own", F.struct("band", chunk.alias("chunk")))
    u = u.withColumn("other", F.explode(F.when(F.col("parts") > 0, F.concat(numbers("below", -1), numbers("parts", 0), numbers("above", 1))).otherwise(F.array("own"))))
    name = F.when(F.col("parts") > 0, F.concat_ws("/", F.col("comp").cast("string"), *(f("own", "other")[x].cast("string") for f in (F.least, F.greatest) for x in ("band", "chunk"))))
    alone = F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(few)).cast("string"))
    return u.select(F.coalesce(name, alone).alias("unit"), (F.col("own") != F.col("other")).alias("cross"), F.xxhash64("own").alias("side"), "node", "rows", "set")


def _links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(node, root, links) from every block that has links; a node is a class's number."""
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = int(total) * 3 // 10 // BUCKET + 1
    shared = _postings(docs, text_col, width, percent, buckets).repartitionById(buckets, "to").mapInArrow(_shared(buckets, percent), "to int, a binary, b binary, c binary")
    fewer = buckets // 4 + 1
    routes = shared.repartitionById(buckets, "to").mapInArrow(_routes(fewer, percent), "to int, a binary, b binary")
    ties = routes.repartitionById(fewer, "to").mapInArrow(_ties, "u long, v long")
    blocks = connected_components(ties)
    candidates = materialise(classes.join(blocks.select(F.col("node").alias("key"), F.col("component").alias("comp")), "key"), "ngram-candidates")
    few = int(candidates.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // CHUNK + 1
    wanted = materialise(_banded(candidates, percent).select(F.col("rep").alias("_w"), F.col("rep_th").alias("_h"), "h1", "h2", "comp", "node", "rows", "band", "parts", "below", "above"), "ngram-wanted")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("th"))
    # only texts that represent a candidate are shuffled
    texts = marked(texts, F.xxhash64("_id", "th"), sketch(wanted, F.xxhash64("_w", "_h")), "maybe").where("maybe")
    found = texts.join(wanted, (F.col("_id") == F.col("_w")) & (F.col("th") == F.col("_h"))).select("_t", "h1", "h2", "comp", "band", "parts", "below", "above", "node", "rows")
    with_sets = found.mapInArrow(_sets(width), "comp long, band int, parts int, below int, above int, node long, rows long, set binary")
    units = _units(with_sets, few).repartition(few * 4, "unit").sortWithinPartitions("unit", "cross")
    return units.mapInArrow(_searched(percent), "node long, root long, links long")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, n_links.

    ``component_id`` is the smallest id reachable by links, itself included; ``n_links``
    counts the other rows that link with this one (texts with equal sets among them). Null
    and empty texts and texts without words have an empty set and no link; so do rows with
    a null id, which keep a null component. Rows that repeat an id or a text count as rows
    of their own. An empty table gives no rows; other columns are not looked at.
    """
    profile = materialise(set_profiles(docs, id_col, text_col, width), "ngram-profile")
    classes = profile.where("n > 0 and _id is not null").groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.min_by("th", "_id").alias("rep_th"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    classes = materialise(classes.withColumn("key", _key_column()).withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    found = materialise(_links(docs, classes, id_col, text_col, width, percent), "ngram-links")
    linked = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    least = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    of = linked.join(least, "component").select("node", "least")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = classes.select("h1", "h2", "node", "rep", "rows").join(of, "node", "left").join(links, "node", "left")
    own = (F.col("n_shingles") > 0) & F.col("_id").isNotNull()
    return (
        profile.withColumnRenamed("n", "n_shingles")
        .join(by_class, ["h1", "h2"], "left")
        .select(
            F.col("_id").alias(id_col),
            "n_shingles",
            F.when(own, F.coalesce("least", "rep", "_id")).otherwise(F.col("_id")).alias("component_id"),
            F.when(own, F.coalesce("rows", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        )
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
