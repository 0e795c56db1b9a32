"""Importance resampling towards a target's distribution, over a dictionary of features.

Features are runs of words. Texts are taken in blocks of bounded size; a block has a list of
its distinct features, and its documents' counts refer to them by number. The blocks' lists are
summed to one dictionary with a row for each distinct string, with its counts in the corpus
and in the target; only there is a string hashed to its bucket. The buckets' counts give
gains, which go back over the dictionary to the blocks' lists and from these to the documents'
counts. So a feature moves once a block, not once a document, and no row is larger than a
block.

The draw is by weight and Gumbel noise from the id. The least score that is drawn is found
with two counts over bounded ranges of scores; only documents from there on are sorted.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm._store import drop, materialise, shuffle_partitions

BUCKETS, WIDTH, SHARE, LEAST_WORDS, SEED = 10_000, 1, 10, 20, "2024"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Text of a block: its distinct features and its documents' counts are in memory together.
BLOCK_BYTES = 32 << 20
#: Scores counted together at first.
_COARSE = 512


def _features(words: list[bytes], width: int) -> list[bytes]:
    return words if width == 1 else [b" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]


def _pack(x: np.ndarray) -> bytes:
    """32-bit numbers, their bytes by place, compressed."""
    return zstandard.compress(x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T).view("<i4").ravel()


class _Block:
    """Documents of a block as they come, with the block's distinct features."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.n_words, self.n_features, self.distinct, self.of, self.counts, self.size = [], [], [], [], [], [], 0

    def add(self, id: pa.Array, text: bytes, width: int) -> None:
        words = _WORD.findall(text.lower())
        own = np.fromiter(map(self.number.__getitem__, _features(words, width)), np.int32)
        k, n = np.unique(own, return_counts=True)
        self.ids.append(id)
        self.n_words.append(len(words))
        self.n_features.append(len(own))
        self.distinct.append(len(k))
        self.of.append(k)
        self.counts.append(n)
        self.size += len(text)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        of, counts = np.concatenate(self.of), np.concatenate(self.counts)
        times = np.bincount(of, counts, len(self.number)).astype(np.int64)
        ids, told = pa.concat_arrays(self.ids), [self.n_words, self.n_features]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, *(pa.array(t, pa.int64()) for t in told))]
        packed = [_pack(np.array(self.distinct)), _pack(np.diff(of, prepend=0)), _pack(counts)]
        columns = [*lists, *(pa.array([x], pa.binary()) for x in packed), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([True]), *columns], names=_COLUMNS)
        features = list(self.number)
        for at in range(0, len(features), 50_000):
            part = features[at : at + 50_000]
            n = len(part)
            columns = [*(pa.nulls(n, c.type) for c in columns[:6]), pa.array(part, pa.binary()), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(times[at : at + n])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.zeros(n, bool)), *columns], names=_COLUMNS)


_COLUMNS = ["block", "is_docs", "ids", "n_words", "n_features", "distinct", "of", "counts", "feature", "k", "times"]


def block_features(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Two kinds of rows for each block of texts, which ends where it has ``block_bytes`` or
    more. One row has all its documents: ids, n_words, n_features and, packed, how many
    distinct features each has, their numbers and their counts. The others are the block's
    features, each with its number ``k`` and the ``times`` it stands in the block. Words are
    runs of digits, a-z and characters beyond ASCII, after A-Z is lower-cased."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = TaskContext.get().partitionId() << 32, _Block()
        for b in it:
            ids = b.column("_id")
            for i, text in enumerate(b.column("_t").cast(pa.binary())):
                block.add(ids.slice(i, 1), text.as_py() or b"", width)
                if block.size >= block_bytes:
                    yield from block.rows(at)
                    at, block = at + 1, _Block()
        if block.ids:
            yield from block.rows(at)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t")).mapInArrow(
        run, f"block long, is_docs boolean, ids array<{kind}>, n_words array<long>, n_features array<long>, distinct binary, of binary, counts binary, feature binary, k int, times long"
    )


def _gain(s: Column, t: Column, all_s: int, all_t: int, buckets: int) -> Column:
    up, down = (t + 1).cast("double") * float(all_s + buckets), (s + 1).cast("double") * float(all_t + buckets)
    return F.floor(F.lit(1000.0) * F.ln(up / down)).cast("long")


def _weights(id_kind: str):
    def run(docs: pa.Table, gains: pa.Table) -> pa.Table:
        k, g = gains.column("k").to_numpy(), gains.column("gain").to_numpy()
        gain = np.zeros(int(k.max(initial=-1)) + 1, np.int64)
        gain[k] = g
        out = []
        for row in docs.to_batches():
            for i in range(row.num_rows):
                ids, n_words, n_features = (row.column(c)[i].values for c in ("ids", "n_words", "n_features"))
                distinct, of, counts = (_unpack(row.column(c)[i].as_py()) for c in ("distinct", "of", "counts"))
                upto = np.concatenate(([0], np.cumsum(gain[np.cumsum(of)] * counts)))
                ends = np.cumsum(distinct)
                n = n_features.to_numpy()
                weight = (upto[ends] - upto[ends - distinct]) // np.maximum(n, 1)
                out.append(pa.table([ids, n_words, n_features, pa.array(weight)], names=["id", "n_words", "n_features", "weight"]))
        return pa.concat_tables(out)

    return run, f"id {id_kind}, n_words long, n_features long, weight long"


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight) of every row of ``docs``: the floored mean of the
    gains of its features, 0 without any. A gain is floor(1000 ln((t+1)(S+buckets) /
    ((s+1)(T+buckets)))) of a bucket's counts in the corpus (s of S) and the target (t of T).

    Null and empty texts have no features, in ``docs`` and ``target``; null ids and repeated
    rows stay rows of their own and count as often as they stand there; an empty ``docs``
    gives no rows, an empty ``target`` counts nothing; other columns are not looked at.
    """
    blocks = materialise(block_features(docs, id_col, text_col, width), "resample-blocks")
    own = blocks.where("not is_docs")
    aimed = block_features(target.select(F.lit(0).alias("_n"), F.col(f"`{target_text}`").alias("_x")), "_n", "_x", width).where("not is_docs")
    zero = F.lit(0).cast("long")
    both = own.select("feature", F.col("times").alias("s"), zero.alias("t")).unionByName(aimed.select("feature", zero.alias("s"), F.col("times").alias("t")))
    words = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    # hashed once, here
    dictionary = materialise(words.select("feature", (F.crc32("feature") % buckets).cast("int").alias("bucket"), "s", "t"), "resample-dictionary")
    by_bucket = dictionary.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_s, all_t = (x or 0 for x in by_bucket.agg(F.sum("s"), F.sum("t")).first())
    gains = by_bucket.select(F.col("bucket").alias("b"), _gain(F.col("s"), F.col("t"), all_s, all_t, buckets).cast("int").alias("gain"))
    # ``buckets`` rows at most
    told = dictionary.where("s > 0").join(F.broadcast(gains), F.col("bucket") == F.col("b")).select(F.col("feature").alias("f"), "gain")
    back = own.select("block", "feature", "k").join(told, F.col("feature") == F.col("f")).select("block", "k", "gain")
    run, schema = _weights(docs.schema[id_col].dataType.simpleString())
    pairs = blocks.where("is_docs").select(F.col("block").alias("own"), "ids", "n_words", "n_features", "distinct", "of", "counts").groupBy("own").cogroup(back.groupBy("block"))
    out = materialise(pairs.applyInArrow(run, schema), "resample-weights")
    drop(blocks, dictionary)
    return out


def _draw(score: DataFrame, n: int) -> int | None:
    """The largest score such that ``n`` rows or more have it or more; None for n = 0. Both
    lists on the driver are bounded: a gain is within 1000 ln(2**63) and the noise within
    1000 ln(2**33) of 0, so there are some 300 coarse scores."""
    left = n
    if not left:
        return None
    for coarse in (True, False):
        by = F.floor(F.col("score") / _COARSE) if coarse else F.col("score")
        rows = (score if coarse else score.where(F.floor(F.col("score") / _COARSE) == at)).groupBy(by.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(rows.collect(), reverse=True):
            at = r.v
            if r.n >= left:
                break
            left -= r.n
    return at


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` from 1 on, by ranges of ``order`` that are sorted on their own;
    the ranges before give what to add. ``order`` tells all rows apart."""
    names = rows.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in it:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at + 1, at + n + 1))], names=[*names, "part", "place"])
            at += n

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = materialise(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, f"{kinds}, part int, place long"), "resample-ranked")
    # a row for each range
    from_ = placed.groupBy("part").agg(F.max("place").alias("n")).collect()
    before, upto = {}, 0
    for r in sorted(from_):
        before[r.part] = upto
        upto += r.n
    add = F.create_map(*(F.lit(x) for k, v in before.items() for x in (k, v)))[F.col("part")] if before else F.lit(0)
    return placed.select(*names, (F.col("place") + add).cast("long").alias("rank"))


def resample(weights: DataFrame, share: float = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of :func:`importance_weights`. Of
    the N rows with ``least_words`` words, floor(share N / 100) are drawn: those with the
    highest scores, ties to the smaller id, a null id last. ``rank`` counts them from 1; it is
    null for all others. A null id's noise is that of the word null; rows alike in all
    columns are told apart by their place."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = weights.withColumn("score", F.col("weight") + noise).withColumn("spot", F.monotonically_increasing_id())
    enough = scored.where(F.col("n_words") >= least_words)
    n = int(share * enough.count() // 100)
    cut = _draw(enough, n)
    high = (F.col("n_words") >= least_words) & (F.col("score") >= cut) if cut is not None else F.lit(False)
    columns = ["id", "n_features", "weight", "score"]
    rest = scored.where(~high).select(*columns, F.lit(None).cast("long").alias("rank"))
    first = _ranked(scored.where(high).select(*columns, "spot"), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("spot")])
    return rest.unionByName(first.select(*columns, F.when(F.col("rank") <= n, F.col("rank")).alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the tenth that is drawn towards the benchmark's words."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(importance_weights(docs, target)).withColumnRenamed("id", "doc_id")


def _words_sql(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, {_words_sql("text")} AS words FROM documents),
b AS (SELECT {_words_sql("text")} AS words FROM benchmark),
c AS (SELECT w, count(*) FILTER (is_doc) AS s, count(*) FILTER (NOT is_doc) AS t FROM (
  SELECT unnest(words) AS w, true AS is_doc FROM d UNION ALL SELECT unnest(words), false FROM b) GROUP BY w),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
h AS (SELECT w, s, t, list_reduce(list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
    lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1]), 4294967295) AS inv FROM (SELECT *, hex(encode(w)) AS x FROM c), crc),
k AS (SELECT *, xor(inv, 4294967295) % {BUCKETS} AS bucket FROM h),
n AS (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM k),
g AS (SELECT bucket, CAST(floor(1000 * ln(((sum(t) + 1)::DOUBLE * (any_value(all_s) + {BUCKETS})) / ((sum(s) + 1)::DOUBLE * (any_value(all_t) + {BUCKETS})))) AS BIGINT) AS gain FROM k, n GROUP BY bucket),
e AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, unnest(CASE WHEN len(words) = 0 THEN [NULL] ELSE words END) AS w FROM d),
m AS (SELECT doc_id, any_value(n_features) AS n_features, CAST(coalesce(floor(sum(gain) / nullif(any_value(n_features), 0)::DOUBLE), 0) AS BIGINT) AS weight
  FROM e LEFT JOIN k ON e.w = k.w LEFT JOIN g ON k.bucket = g.bucket GROUP BY doc_id),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM m),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= {LEAST_WORDS})
SELECT z.doc_id, n_features, weight, score, r.rank FROM z LEFT JOIN r ON z.doc_id = r.doc_id AND r.rank <= {SHARE} * r.n // 100
"""
