"""Batches of a stream that are written once, however often they are done.

A batch goes to a folder with its number in one job. Then a file with the number is created in
one step; from then on all of the batch is there, and before it nothing. A batch that comes
again, after a failure or a restart, is passed over where its file is there and replaces its
own folder where it isn't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillgate.sources.files import Folder

_BATCHES, _DONE = "batches", "done"


def commit_batch(rows: DataFrame, number: int, root: str, by: str | None = None) -> bool:
    """Writes a batch, apart by the values of ``by``; False where one of its number was
    committed before. A batch without rows is committed as well."""
    done = Folder(rows.sparkSession, f"{root}/{_DONE}")
    if done.exists(str(number)):
        return False
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{root}/{_BATCHES}/{number}")
    return done.create(str(number), "")


def committed(spark: SparkSession, root: str, schema: StructType, part: str | None = None) -> DataFrame:
    """All committed rows, or those of one part as ``by=value``."""
    sides, end = Folder(spark, f"{root}/{_BATCHES}"), f"/{part}" if part else ""
    # a part of a batch has no folder where it has no row
    paths = [f"{root}/{_BATCHES}/{n}{end}" for n in Folder(spark, f"{root}/{_DONE}").names() if sides.exists(f"{n}{end}")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def committed_stream(rows: DataFrame, make: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, by: str | None = None, **trigger: object) -> StreamingQuery:
    """Starts a stream whose batches, as ``make`` turns them, are committed; ``trigger`` as
    for writeStream, or all that is there."""

    def one(batch: DataFrame, number: int) -> None:
        commit_batch(make(batch), number, root, by)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
