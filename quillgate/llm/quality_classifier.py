"""Quality classifier by compression.

Two zstandard dictionaries are trained on blocks of text labelled good and bad. A text is
compressed in blocks with each; the difference of the compressed sizes, per byte of the
text, tells which of the two it is more like, and a logistic curve fitted on other labelled
texts turns it into a probability. Text that repeats itself needs neither dictionary, and so
has a difference near that of bad text. Only bounded samples of labelled rows are learned
from; of these, the dictionaries draw from all blocks and the curve takes all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm._learn import fold, labelled_sample
from quillgate.llm._store import drop, materialise

#: Labelled rows of each label for the dictionaries and the curve together; blocks that a
#: dictionary is trained on; bytes of a block and of a dictionary.
SAMPLE, BLOCKS, BLOCK, DICTIONARY, LEVEL = 2400, 6000, 2048, 112_640, 3


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self._ready = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ready"} | {"_ready": None}

    def difference(self, text: bytes | list[bytes]) -> float:
        """(bytes with the bad dictionary - with the good one) / bytes of the text; 0 for none."""
        if self._ready is None:
            self._ready = [_compressor(x) for x in (self.good, self.bad)]
        own = blocks(text) if isinstance(text, bytes) else text
        size = sum(map(len, own))
        if not size:
            return 0.0
        good, bad = (sum(len(c.compress(b)) for b in own) for c in self._ready)
        return (bad - good) / size

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(difference) + self.shift, -30, 30)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content)  # trained, or plain text
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)


def build_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary trained on the blocks. Of too few to train on, they are the dictionary."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit_curve(x: np.ndarray, y: np.ndarray, share: float = 0.5) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small ridge, as if
    ``share`` of the rows were good: the sample has other shares than the labels."""
    if not len(x) or len(set(y.tolist())) < 2:
        return 1.0, 0.0
    scale = float(np.std(x)) or 1.0
    X = np.stack((x / scale, np.ones(len(x))), 1)
    w = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
        g = X.T @ (w * (p - y)) + 1e-3 * b
        H = (X * (w * p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2)
        b = b - np.linalg.solve(H, g)
    return float(b[0] / scale), float(b[1])


def _sampled_blocks(rows: DataFrame, label: int) -> list[bytes]:
    """At most BLOCKS of all blocks of the rows with ``label``, those first by their digests."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(blocks(t), pa.binary())], names=["block"])

    own = rows.where(F.col("label") == label).select("text").mapInArrow(run, "block binary").withColumn("spot", F.md5("block"))
    return [bytes(r.block) for r in own.orderBy("spot").limit(BLOCKS).collect()]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> CompressionModel:
    """Fits the model on at most ``sample`` rows of each label. Two of three sampled rows
    go to the dictionaries, the others, whole, to the curve. Without rows of a label its
    dictionary is empty, and without both every score is that of no difference. Nulls,
    repeated labels and repeated ids as in :func:`labelled_sample`."""
    labels = labels.withColumn(label_col, F.col(label_col).cast("int"))
    share = labels.where(F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0]
    rows = materialise(labelled_sample(docs, labels, label_col, sample, id_col, text_col), "quality-sample")
    third = F.crc32(F.col("spot").cast("binary")) % 3
    model = CompressionModel(*(build_dictionary(_sampled_blocks(rows.where(third != 0), y)) for y in (1, 0)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            d = [model.difference(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("spot"), pa.array(d, pa.float64())], names=["label", "spot", "d"])

    # 2 * sample numbers at most
    rest = sorted(rows.where(third == 0).mapInArrow(run, "label int, spot string, d double").collect(), key=lambda r: (r.spot, r.label))
    drop(rows)
    model.slope, model.shift = fit_curve(np.array([r.d for r in rest]), np.array([r.label for r in rest]), 0.5 if share is None else min(max(share, 0.01), 0.99))
    return model


def score_quality(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and score (0 to 1, higher: good likelier) of the whole
    text. Null and empty texts have the score of no difference; null ids and repeated rows
    stay; an empty table gives no rows; other columns are not looked at."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            d = [model.difference(t.as_py() or b"") for t in b.column("_t").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(model.score(np.array(d)), pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return score_quality(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
