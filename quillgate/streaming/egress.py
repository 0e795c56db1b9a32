"""The single way out of a stream of payloads. A batch is judged once and committed once: what
may leave under ``held=0``, what may not, without its content, under ``held=1``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from quillgate.operators.payloads import judged
from quillgate.streaming.commits import commit_batch, committed, committed_stream


def _sides(batch: DataFrame, id_col: str, json_col: str, depth: int | None) -> DataFrame:
    return judged(batch, id_col, json_col, depth).withColumn("held", (~F.col("safe")).cast("int")).drop("safe")


def write_batch(batch: DataFrame, number: int, root: str, id_col: str = "payload_id", json_col: str = "payload", depth: int | None = None) -> bool:
    """Judges and commits a batch; False where one of its number was committed before. Each
    row is judged by itself: null payloads are safe, null ids and repeated rows are rows of
    their own, and an empty batch is committed as one without rows."""
    return commit_batch(_sides(batch, id_col, json_col, depth), number, root, "held")


def gated_stream(payloads: DataFrame, root: str, checkpoint: str, id_col: str = "payload_id", json_col: str = "payload", depth: int | None = None, **trigger: object) -> StreamingQuery:
    """Starts the sink over a stream of payloads."""
    return committed_stream(payloads, lambda batch: _sides(batch, id_col, json_col, depth), root, checkpoint, "held", **trigger)


def _side(spark: SparkSession, root: str, payloads: StructType, id_col: str, held: int) -> DataFrame:
    schema = StructType().add("own", payloads).add("id", payloads[id_col].dataType).add("n_findings", LongType()).add("findings", ArrayType(StringType()))
    return committed(spark, root, schema, f"held={held}")


def sent(spark: SparkSession, root: str, payloads: StructType, id_col: str = "payload_id") -> DataFrame:
    """The rows that have left, of all committed batches; ``payloads`` is their schema."""
    return _side(spark, root, payloads, id_col, 0).select("own.*")


def quarantined(spark: SparkSession, root: str, payloads: StructType, id_col: str = "payload_id") -> DataFrame:
    """(id, n_findings, findings) of the rows that are held, of all committed batches."""
    return _side(spark, root, payloads, id_col, 1).select(F.col("id").alias(id_col), "n_findings", "findings")
