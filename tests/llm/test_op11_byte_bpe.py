import hashlib
import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgate.llm.byte_bpe import ByteBPE, Decoder, decode_ids, default_pattern, encode_texts, op11_byte_bpe, read_ranks

MODEL, DECODER = ByteBPE(), Decoder()
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=MODEL.ranks, special_tokens={})


def plain_merge(piece, ranks):
    """The pair of least rank, the leftmost of equal ones, is merged until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        least = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if least is None:
            return [ranks[p] for p in parts]
        parts[least[1] : least[1] + 2] = [parts[least[1]] + parts[least[1] + 1]]


@given(st.text(alphabet=st.one_of(st.sampled_from("ab eé\n\t '1²中\x1c\x85\xa0​😀"), st.characters(exclude_categories=["Cs"])), max_size=80))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_library(library, text):
    ids = MODEL.encode(text).tolist()
    assert ids == library.encode_ordinary(text) and DECODER.decode(pa.array([ids], pa.list_(pa.int32())))[0].as_py().decode() == text


def test_long_matches(library):
    r = random.Random(1)
    for text in ("a" * 60_000, "ab" * 20_000, " " * 5000 + "x", "\n" * 3000, "é" * 5000, "=" * 40_000, "".join(r.choice("abcde") for _ in range(60_000)), "".join(map(chr, list(MODEL.later)[:300]))):
        began = time.perf_counter()
        assert MODEL.encode(text).tolist() == library.encode_ordinary(text)
        assert time.perf_counter() - began < 20


def test_merges_are_in_the_order_of_ranks():
    """Vocabularies in which a merge makes a pair of a lower rank, or equal ranks overlap."""
    r = random.Random(2)
    letters = [bytes([i]) for i in range(97, 101)]
    for _ in range(300):
        tokens = list(letters)
        for _ in range(12):
            tokens.append(r.choice(tokens) + r.choice(tokens))
        tokens = list(dict.fromkeys(tokens))
        r.shuffle(tokens)
        m = ByteBPE.__new__(ByteBPE)
        from quillgate.llm.byte_bpe import RankQueue, two_bytes

        m.ranks = {t: i * 7 for i, t in enumerate(tokens)}
        m.queue, m.pairs = RankQueue(7 * len(tokens) + 1), two_bytes(m.ranks)
        for _ in range(20):
            piece = b"".join(r.choice(letters) for _ in range(r.randrange(1, 30)))
            want = [m.ranks[piece]] if piece in m.ranks else plain_merge(piece, m.ranks)
            assert m.merge(piece) == want
            assert not any(m.queue.words) and not m.queue.held


def test_the_cache_is_bounded(monkeypatch, library):
    from quillgate.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "CACHED", 50)
    m = ByteBPE()
    text = " ".join(f"w{i}q" for i in range(500)) + " " + "x" * 100
    assert m.encode(text).tolist() == library.encode_ordinary(text)
    assert len(m.known) <= 51 and not any(len(k) > byte_bpe.SHORT for k in m.known)


ROWS = [(1, "hello world"), (2, ""), (3, None), (None, "no id"), (4, "same"), (4, "same"), (5, "long " * 100_000), (6, "ſ<|endoftext|>\x00"), (7, "z" * 50_000)]


def test_rows(spark, library):
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as ids", "2 as decoded", "3 as _id", "4 as _t", "5 as `a.b`")
    got = decode_ids(encode_texts(docs).withColumn("kept", F.col("ids"))).collect()
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.kept, bytes(r.decoded)) for r in got) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert decode_ids(encode_texts(empty)).count() == 0
    assert decode_ids(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded is None


def test_query(spark, tmp_path, library):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_byte_bpe(spark, str(tmp_path)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in ROWS:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_decoding_lists():
    own = pa.array([[464], None, [], [464, 3290], [50255]], pa.list_(pa.int32()))
    want = [b"The", None, b"", b"The dog", DECODER.tokens[50255].as_py()]
    assert DECODER.decode(own).to_pylist() == want and DECODER.decode(own[1:]).to_pylist() == want[1:] and DECODER.decode(own[:0]).to_pylist() == []
    for bad in (10**6, 60_000):
        with pytest.raises((ValueError, IndexError)):
            DECODER.decode(pa.array([[bad]], pa.list_(pa.int32())))


def test_a_file_of_ranks(tmp_path):
    (tmp_path / "r").write_text("YQ== 0\nYg== 1\nYWI= 2\n\n")
    assert read_ranks(str(tmp_path / "r")) == {b"a": 0, b"b": 1, b"ab": 2}
    assert ByteBPE(str(tmp_path / "r"), "[ab]+").encode("abba-ab").tolist() == [2, 1, 0, 2]
