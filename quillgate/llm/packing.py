"""Packing by swap-based local search, with best fit for its moves.

Documents become token ids; only those longer than a sequence are cut. Pieces are dealt at
random over shards of bounded size; a shard is packed in memory. Its pieces first stand as
they come, which leaves a fifth of the room or so. Then the emptiest underfull bin is worked
on: its pieces are moved to the fullest bins with room for them, or exchanged with pieces
of other underfull bins, one for one, two for one or one for two, whatever raises the sum of
squared fills most, until the bin is empty or nothing raises it; then the next, until as few
bins are left as the tokens allow or a pass over all underfull bins empties none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm._store import materialise, unused
from quillgate.llm._tokens import EOS, TokenIds
from quillgate.llm._words import batches

LENGTH, SHARD = 4096, 10_000
_tokens: dict[str | None, TokenIds] = {}


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None, eos: int = EOS) -> DataFrame:
    """(id, piece, start, length, ids) of every row: its ids and then ``eos``, cut into
    pieces of ``length`` only where longer; ``ids`` are little-endian unsigned 32-bit. A null
    or empty text is ``eos`` alone; null ids and repeated rows stay rows of their own, an
    empty table gives no rows, and other columns are not looked at."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = TokenIds(path)
        end = np.array([eos], "<u4").tobytes()
        for b in it:
            for first, texts in batches(b.column("_t").cast(pa.binary()).to_pylist()):
                row, piece, start, size, ids = [], [], [], [], []
                for i, own in enumerate(_tokens[path].encode([t.decode() for t in texts])):
                    own += end
                    for k, at in enumerate(range(0, len(own) // 4, length)):
                        part = own[4 * at : 4 * (at + length)]
                        row.append(first + i)
                        piece.append(k)
                        start.append(at)
                        size.append(len(part) // 4)
                        ids.append(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())],
                    names=[id_col, "piece", "start", "length", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


class Bins:
    """Bins of one shard: ``bins``, or the pieces as they come, each in the last bin while it
    has room; :meth:`improve` then empties bins."""

    def __init__(self, lengths: list[int], most: int, bins: list[list[int]] | None = None):
        self.most, self.size = most, np.array(lengths, np.int64)
        self.least = -(-int(self.size.sum()) // most)
        if bins is None:
            bins, room = [], 0
            for k, n in enumerate(lengths):
                if n > room:
                    bins.append([])
                    room = most
                bins[-1].append(k)
                room -= n
        self.bins = bins
        self.of = np.zeros(len(lengths), np.int64)  # the bin of each piece
        for b, own in enumerate(bins):
            self.of[own] = b
        self.gap = most - np.bincount(self.of, self.size, len(self.bins)).astype(np.int64)
        self.count = self.start = len(self.bins)
        self.pairs, self.pairs_of = None, [None] * len(self.bins)  # sums of two pieces, of all underfull bins and of each
        # underfull bins by their gap, and a bit for each gap that a bin has
        self.room: dict[int, set[int]] = {}
        self.gaps = 0
        for b in range(len(self.bins)):
            self._open(b)

    def _open(self, b: int) -> None:
        if 0 < (g := int(self.gap[b])) < self.most:
            self.room.setdefault(g, set()).add(b)
            self.gaps |= 1 << g

    def _shut(self, b: int) -> None:
        g = int(self.gap[b])
        if b in (own := self.room.get(g, set())):
            own.remove(b)
            if not own:
                self.gaps &= ~(1 << g)

    def improve(self) -> None:
        """Empties underfull bins, the emptiest first, by moves and exchanges that raise the
        sum of squared fills, until no bin can go or a pass over all of them empties none."""
        emptied = True
        while emptied and self.count > self.least:
            emptied, tried = False, np.zeros(len(self.bins), bool)
            while self.count > self.least:
                todo = np.flatnonzero((self.gap > 0) & (self.gap < self.most) & ~tried)
                if not len(todo):
                    break
                a = int(todo[np.argmax(self.gap[todo])])
                tried[a] = True
                self._shut(a)
                while self.bins[a] and self._step(a):  # ends, as squared fill rises with each step
                    pass
                if self.bins[a]:
                    self._open(a)
                else:
                    self.count, emptied = self.count - 1, True

    def _step(self, a: int) -> bool:
        """The best step by which bin a gets emptier: moves first, then exchanges of one or
        two of a for one, then of one for two."""
        moved = False
        for k in sorted(self.bins[a], key=lambda k: (-self.size[k], k)):
            n = int(self.size[k])
            if fit := self.gaps >> n:
                b = min(self.room[n + (fit & -fit).bit_length() - 1])
                if self.gap[a] > self.gap[b] - n:
                    self._exchange(a, b, [k], [])
                    moved = True
        if moved or not self.bins[a]:
            return moved
        live = np.flatnonzero((self.gap > 0) & (self.gap < self.most) & (np.arange(len(self.bins)) != a))
        best = self._one_back(a, live) or self._two_back(a)
        if best:
            self._exchange(a, *best)
        return best is not None

    def _choices(self, own: list[int], pairs: bool) -> tuple[np.ndarray, list[list[int]]]:
        """Sums of one piece of ``own``, or two; a sum once."""
        got = {}
        if pairs:
            by_size = {}
            for k in own:
                by_size.setdefault(int(self.size[k]), []).append(k)
            kept = [k for same in by_size.values() for k in same[:2]]
            for i, k in enumerate(kept):
                for m in kept[:i]:
                    got.setdefault(int(self.size[k] + self.size[m]), [k, m])
        else:
            for k in own:
                got.setdefault(int(self.size[k]), [k])
        return np.fromiter(got, np.int64, len(got)), list(got.values())

    def _gain(self, a: int, d: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Of squared fill where a bin with ``gap`` gets d more of bin a; 0 where it can't."""
        return np.where((d > 0) & (d <= gap), d * (int(self.gap[a]) - gap + d), 0)

    def _one_back(self, a: int, live: np.ndarray) -> tuple | None:
        ones, twos = self._choices(self.bins[a], False), self._choices(self.bins[a], True)
        give, which = np.concatenate((ones[0], twos[0])), ones[1] + twos[1]
        open_bin = np.zeros(len(self.bins), bool)
        open_bin[live] = True
        item = np.flatnonzero(open_bin[self.of])
        if not len(item):
            return None
        gap, size = self.gap[self.of[item]], self.size[item]
        best, what = 0, None
        for n, own in zip(give.tolist(), which):
            gain = self._gain(a, n - size, gap)
            i = int(gain.argmax())
            if gain[i] > best:
                best, what = gain[i], (int(self.of[item[i]]), own, [int(item[i])])
        return what

    def _two_back(self, a: int) -> tuple | None:
        if self.pairs is None:
            live = np.flatnonzero((self.gap > 0) & (self.gap < self.most))
            for b in live.tolist():
                if self.pairs_of[b] is None:
                    self.pairs_of[b] = self._choices(self.bins[b], True)
            sums = [self.pairs_of[b][0] for b in live.tolist()]
            n = np.fromiter(map(len, sums), np.int64, len(sums))
            self.pairs = np.concatenate([np.empty(0, np.int64), *sums]), np.repeat(live, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        sums, of, place = self.pairs
        if not len(sums):
            return None
        gap, best, what = np.where(of == a, 0, self.gap[of]), 0, None
        for n, own in zip(*self._choices(self.bins[a], False)):
            gain = self._gain(a, int(n) - sums, gap)
            i = int(gain.argmax())
            if gain[i] > best:
                b = int(of[i])
                best, what = gain[i], (b, own, self.pairs_of[b][1][place[i]])
        return what

    def _exchange(self, a: int, b: int, give: list[int], back: list[int]) -> None:
        self._shut(b)
        self.pairs = self.pairs_of[a] = self.pairs_of[b] = None
        self.bins[a] = [k for k in self.bins[a] if k not in give] + back
        self.bins[b] = [k for k in self.bins[b] if k not in back] + give
        self.of[give], self.of[back] = b, a
        d = int(self.size[give].sum() - self.size[back].sum())
        self.gap[a] += d
        self.gap[b] -= d
        self._open(b)


def pack(lengths: list[int], most: int = LENGTH) -> list[list[int]]:
    """Bins of the indices of ``lengths``; none is above ``most``."""
    return searched(lengths, most)[0]


def searched(lengths: list[int], most: int = LENGTH) -> tuple[list[list[int]], int]:
    """The same, and the number of bins before the search."""
    full = [[k] for k, n in enumerate(lengths) if n == most]
    rest = [k for k, n in enumerate(lengths) if n < most]
    b = Bins([lengths[k] for k in rest], most)
    b.improve()
    return full + [[rest[k] for k in bin] for bin in b.bins if bin], len(full) + b.start


def pack_pieces(pieces: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id, offset, shard_start and shard_bins to rows with a ``length`` (1 to
    ``length`` tokens); the latter two are the sequences of the row's shard before the search
    and after it. All rows stay, null ids and repeated rows as well; other columns are passed
    on, whatever their names; an empty table gives no rows."""
    names = pieces.columns
    uid, part = unused([*names, "sequence_id", "offset", "shard_start", "shard_bins"], "_uid", "_shard")
    held = materialise(pieces.withColumn(uid, F.monotonically_increasing_id()), "pack-pieces")
    shards = held.count() // shard + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(it)
        if not got:
            return
        t = pa.Table.from_batches(got)
        own = t.column(part).to_numpy()
        for s in np.unique(own).tolist():
            rows = t.filter(pa.array(own == s)).sort_by(uid)
            n = rows.column("length").to_pylist()
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            bins, start = searched(n, length)
            for k, bin in enumerate(bins):
                at = 0
                for i in bin:
                    seq[i], off[i] = (s << 32) + k, at
                    at += n[i]
            out = rows.select(names).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
            out = out.append_column("shard_start", pa.array(np.full(len(n), start))).append_column("shard_bins", pa.array(np.full(len(n), len(bins))))
            yield from out.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = held.withColumn(part, F.pmod(F.xxhash64(uid), F.lit(shards)).cast("long")).repartition(shards, part)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long, shard_start long, shard_bins long")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_tokens): the ids of each sequence, from rows with sequence_id,
    offset and ids."""
    own = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return own.select("sequence_id", ids.alias("ids")).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset, shard_start, shard_bins) of
    every piece of ``docs``; nulls and repeated rows as in :func:`token_pieces`."""
    pieces = token_pieces(docs, id_col, text_col, length, path)
    return pack_pieces(pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), length)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
