"""A bounded sketch of a set of keys, to leave rows that need no join where they are.

Keys set bits in a table of at most 2**20 words of 64 bits (16 MB, whatever the number of
keys), which is broadcast. A row whose bit isn't set has none of the keys. A row whose bit
is set may have one and goes through an exact join; with very many keys most rows do, and
the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.llm._store import unused

WORDS_LOG2 = 20


def _word(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - WORDS_LOG2)


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))


def sketch(keys: DataFrame, key: Column) -> DataFrame:
    """(w, bits) of ``key``, a 64-bit hash of each row of ``keys``."""
    return keys.select(_word(key).alias("w"), _bit(key).alias("b")).groupBy("w").agg(F.bit_or("b").alias("bits"))


def marked(df: DataFrame, key: Column, held: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: false where ``key`` is surely not among the keys of ``held``."""
    w, bits = unused([*df.columns, name], "sketch_w", "sketch_bits")
    table = F.broadcast(held.select(F.col("w").alias(w), F.col("bits").alias(bits)))  # at most 2 ** WORDS_LOG2 rows
    on = F.coalesce(F.col(bits).bitwiseAND(_bit(key)) != 0, F.lit(False))
    return df.join(table, _word(key) == F.col(w), "left").select(*(df[c] for c in df.columns), on.alias(name))
