"""Bounded samples of labelled rows for models fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, spot, text) of at most ``most`` labelled documents of each label 0 and 1, those
    first by the digest of their ids: 2 * most rows at most. ``labels``: (id, label), rows
    with nulls left out and repeats counted once; of documents that share an id, the
    smallest text is taken, a null text being empty."""
    own = labels.select(F.col(id_col).alias("_l"), F.col(label_col).alias("label")).where("_l is not null and label in (0, 1)").distinct().withColumn("spot", F.md5(F.col("_l").cast("string")))
    taken = None
    for value in (0, 1):
        part = own.where(F.col("label") == value).orderBy("spot", "_l").limit(most)
        taken = part if taken is None else taken.union(part)
    # 2 * most rows at most
    joined = docs.select(F.col(id_col).alias("_d"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(taken), F.col("_d") == F.col("_l"))
    return joined.groupBy("label", "spot").agg(F.min("text").alias("text"))
