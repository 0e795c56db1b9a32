"""Byte-level BPE by a vocabulary of ranks, and back.

A text is split by a pattern; each match is merged on its own. Its bytes are a linked list of
symbols. Every pair of neighbours that is a token waits at its left symbol's position, in the
bucket of the token's rank. A bitmap of several levels has a bit for each rank that holds
positions and, above, a bit for each word of bits that isn't zero, so that the least rank is
found by taking the first set bit on each level. A merge changes the pairs to its left and
right; their old entries stay and are skipped when they come up. So a match of n bytes takes
some 2 n entries, however long it is, and no pass over its other symbols.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillgate.llm._words import batches

#: Matches that are kept with their ids, each of so many characters at most; matches taken at once.
CACHED, SHORT, AT_ONCE = 1_200_000, 32, 1 << 16
_models: dict[tuple[str | None, str | None], "ByteBPE"] = {}
_decoders: dict[str | None, "Decoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """The file's tokens and ranks: a base64 token and a number a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, f))}


def two_bytes(ranks: dict[bytes, int]) -> list[int | None]:
    """The rank of every two bytes that are a token, by 256 * first + second."""
    return [ranks.get(bytes((x, y))) for x in range(256) for y in range(256)]


class RankQueue:
    """A bitmap of the ranks that hold positions: words of about as many bits as there are
    words, and above them one word with a bit for each that isn't zero. All is zero and
    empty between merges. The merge works on the parts itself, as calls would cost as much
    as the work in them."""

    def __init__(self, ranks: int):
        self.log = ((max(ranks, 2) - 1).bit_length() + 1) // 2
        self.bits = [1 << i for i in range(1 << self.log)]
        self.words = [0] * (1 << self.log)
        #: Positions of each rank that has any: a number, or a heap where there are more.
        self.held: dict[int, int | list[int]] = {}


class Known(dict):
    """The ids of matches, as 32-bit integers, merged where they aren't there yet. Of short
    ones the newest stay."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        super().__init__()
        self.merge = merge

    def __missing__(self, match: str) -> bytes:
        ids = array("i", self.merge(match.encode())).tobytes()
        if len(match) <= SHORT:
            if len(self) >= CACHED:
                for old in list(islice(self, CACHED // 4)):
                    del self[old]
            self[match] = ids
        return ids


def later_characters() -> dict[int, str]:
    """Letters and numbers of a newer Unicode than the one the tiktoken library splits by,
    each with an unassigned character in its place."""
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    doubtful = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    bytewise = {bytes([i]): i for i in range(256)}
    split = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks=bytewise, special_tokens={})
    return dict.fromkeys(map(ord, set(doubtful) - set(split.decode(split.encode_ordinary(doubtful)))), "\uffff")


class ByteBPE:
    """``encode(text)`` by a file of ranks and a pattern."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        self.ranks = read_ranks(path or default_path())
        self.pattern = regex.compile(pattern or default_pattern())
        self.later = later_characters()
        self.queue = RankQueue(max(self.ranks.values(), default=0) + 1)
        self.pairs = two_bytes(self.ranks)
        self.known = Known(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one match."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        log, bits, words, held, pairs, top = self.queue.log, self.queue.bits, self.queue.words, self.queue.held, self.pairs, 0
        low, rank_of = len(bits) - 1, ranks.get
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [pairs[x << 8 | y] for x, y in zip(piece, piece[1:])]
        for i, rank in enumerate(waits):
            if rank is None:
                continue
            if rank in held:
                own = held[rank]
                if type(own) is list:
                    own.append(i)  # the largest so far
                else:
                    held[rank] = [own, i]
            else:
                held[rank] = i
                word = rank >> log
                words[word] |= bits[rank & low]
                top |= bits[word]
        waits.append(None)
        while top:
            # the first set bit, on both levels
            word = (top & -top).bit_length() - 1
            waiting = words[word]
            bit = (waiting & -waiting).bit_length() - 1
            rank = word << log | bit
            own = held[rank]
            several = type(own) is list
            i = heappop(own) if several else own
            if not (several and own):
                del held[rank]
                words[word] = waiting = waiting ^ bits[bit]
                if not waiting:
                    top ^= bits[word]
            if waits[i] != rank:  # stale: another merge has taken one of the two
                continue
            gone = end[i]
            stop = end[i] = end[gone]
            waits[gone] = new = None
            if stop < n:
                left[stop] = i
                new = rank_of(piece[i : end[stop]])
            waits[i], before = new, left[i]
            while True:  # the pair to the right, then the one to the left
                if new is not None:
                    if new in held:
                        own = held[new]
                        if type(own) is list:
                            heappush(own, i)
                        else:
                            held[new] = [own, i] if own < i else [i, own]
                    else:
                        held[new] = i
                        word = new >> log
                        words[word] |= bits[new & low]
                        top |= bits[word]
                if before < 0:
                    break
                i, before = before, -1
                new = waits[i] = rank_of(piece[i:stop])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _matches(self, text: str) -> Iterator[list[str]]:
        """All matches in order, so many at once that a long text's need no room together."""
        if text.isascii() or self.later.keys().isdisjoint(map(ord, set(text))):
            if len(text) <= AT_ONCE:
                yield self.pattern.findall(text)
                return
            found = (m[0] for m in self.pattern.finditer(text))
        else:
            found = (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.later)))
        while own := list(islice(found, AT_ONCE)):
            yield own

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return np.frombuffer(b"".join(b"".join(map(self.known.__getitem__, own)) for own in self._matches(text)), np.int32)


class Decoder:
    """``decode(ids)`` of a column of lists by a file of ranks."""

    def __init__(self, path: str | None = None):
        tokens = {r: t for t, r in read_ranks(path or default_path()).items()}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], pa.large_binary())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; null for null."""
        at = ids.offsets.to_numpy().astype(np.int64)
        tokens = self.tokens.take(ids.values.slice(at[0], at[-1] - at[0]))
        if tokens.null_count:
            raise ValueError("an id isn't in the vocabulary")
        # the tokens stand one behind the other, so a list's are a slice of their bytes
        ends = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
        data = tokens.buffers()[2] if len(tokens) else pa.py_buffer(b"")
        whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[at - at[0]].tobytes()), data])
        return pc.if_else(ids.is_valid(), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def _model(path: str | None, pattern: str | None) -> ByteBPE:
    if (path, pattern) not in _models:
        _models[path, pattern] = ByteBPE(path, pattern)
    return _models[path, pattern]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids) of every row: the ids of its whole text, array<int>. A null or empty text has
    none; null ids and repeated rows stay rows of their own, an empty table gives no rows, and
    other columns are not looked at. ``path`` must be readable on every executor."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, pattern)
        for b in it:
            for first, texts in batches(b.column("_t").cast(pa.binary()).to_pylist()):
                ids = [model.encode(t.decode()) for t in texts]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The rows of ``encoded`` with ``decoded`` in the place of their ids: the bytes that the
    ids stand for; no ids give no bytes, null stays null. An id that isn't in the vocabulary
    ends the job. ``path`` as in :func:`encode_texts`."""
    at = encoded.columns.index(ids_col)
    fields = [f for f in encoded.schema.fields if f.name != ids_col]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _decoders:
            _decoders[path] = Decoder(path)
        model = _decoders[path]
        for b in it:
            rest = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, model.decode(b.column(at))], names=[*(f.name for f in fields), "decoded"])

    return encoded.mapInArrow(run, StructType([*fields, StructField("decoded", BinaryType())]))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the bytes decoded from them, as digests."""
    encoded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids")
    return decode_ids(told).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
