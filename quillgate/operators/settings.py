"""Settings of many owners as a versioned table. A write is merged with what is there and
becomes the next version in one step; of two that began from the same version one loses."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.sources.files import Folder

SETTINGS = "owner string, name string, value string"


class Conflict(Exception):
    """Another write has taken the version."""


def latest(changes: DataFrame, order: list[Column]) -> DataFrame:
    """(owner, name, value): of several changes of a setting the last by ``order``; a null value
    is a value. Changes without a name are passed over."""
    last = F.max_by(F.struct("value"), F.struct(*order))
    return changes.where("name is not null").groupBy("owner", "name").agg(last.alias("l")).select("owner", "name", "l.value")


def version(spark: SparkSession, root: str) -> int:
    """The number of the last version; 0 where none is written."""
    return max(map(int, Folder(spark, f"{root}/versions").names()), default=0)


def stored(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """(owner, name, value) of a version, the last where none is named."""
    at = version(spark, root) if at is None else at
    if not at:
        return spark.createDataFrame([], SETTINGS)
    return spark.read.schema(SETTINGS).parquet(f"{root}/tables/{Folder(spark, f'{root}/versions').read(str(at))}")


def merge(spark: SparkSession, root: str, changes: DataFrame, base: int) -> int:
    """Writes ``changes`` (owner, name, value; each setting once) over version ``base`` and
    returns the new version. A setting that isn't changed stays; a changed one has the new
    value, a null one too. Raises :class:`Conflict`, and leaves all as it was, where ``base``
    isn't the last version any more. Null owners are an owner like any other."""
    if version(spark, root) != base:
        raise Conflict(f"version {base} is not the last one")
    new = changes.select(F.col("owner").alias("o"), F.col("name").alias("n"), F.struct("value").alias("v"))
    old = stored(spark, root, base)
    both = old.join(new, F.col("owner").eqNullSafe(F.col("o")) & (F.col("name") == F.col("n")), "full")
    value = F.when(F.col("v").isNotNull(), F.col("v.value")).otherwise(F.col("value"))
    owner = F.when(F.col("n").isNotNull(), F.col("o")).otherwise(F.col("owner"))
    own = f"{base + 1}-{uuid.uuid4().hex}"
    both.select(owner.alias("owner"), F.coalesce("n", "name").alias("name"), value.alias("value")).write.parquet(f"{root}/tables/{own}")
    if not Folder(spark, f"{root}/versions").create(str(base + 1), own):
        Folder(spark, f"{root}/tables").delete(own)
        raise Conflict(f"version {base + 1} was written by another")
    return base + 1
