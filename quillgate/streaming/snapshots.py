"""The documents on each snapshot, for a stream of snapshots: told apart once, told three ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillgate.operators.gate import document_findings
from quillgate.streaming.commits import committed, committed_stream

KINDS = ("region", "blocked", "document")


def snapshot_documents(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, ord, region, blocked, document), a row for each medium of a snapshot that
    shows a document: what to redact on the screen, what to tell as withheld, and what was
    found. ``ord`` is the medium's place. Media not seen or without a box are passed over; a
    snapshot without media, or one of nulls, has no rows; null ids and repeated rows stay."""
    m = snapshots.select("snapshot_id", F.posexplode("mediaCandidates").alias("ord", "m"))
    media = m.select(
        F.col("snapshot_id").alias("page_id"), "ord", "m.visible", "m.bbox", F.col("m.ocrText").alias("ocr_text"), F.col("m.fileName").alias("file_name"), "m.alt", "m.title", F.col("m.mimeType").alias("mime"), "m.tag"
    )
    return document_findings(media).withColumnRenamed("page_id", "snapshot_id")


def snapshot_sink(snapshots: DataFrame, root: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts the stream: every batch is read and classified once and committed once, with all
    three of :data:`KINDS`."""
    return committed_stream(snapshots, snapshot_documents, root, checkpoint, **trigger)


def projection(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(snapshot_id, ord, ...) of one of :data:`KINDS`, of all committed batches. Only the
    columns of that kind are read."""
    return committed(spark, root, _schema(spark)).select("snapshot_id", "ord", f"{kind}.*")


def _schema(spark: SparkSession) -> StructType:
    from quillgate.sources.snapshots import SNAPSHOT

    return snapshot_documents(spark.createDataFrame([], SNAPSHOT)).schema
