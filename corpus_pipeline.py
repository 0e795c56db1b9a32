"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and gets what the one
before has kept.

Rows are told apart by their id and the digest of their text, so ids may be null or repeat.
Columns that a stage adds for itself get names that ``docs`` doesn't have. An empty table
gives an empty table; repeated rows are rows of their own until exact dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm._sketch import marked, sketch
from quillgate.llm._store import drop, materialise, unused
from quillgate.llm.exact_dedup import drop_exact_copies
from quillgate.llm.mixing import mix_sources
from quillgate.llm.ngram_join import ngram_jaccard_join
from quillgate.llm.packing import pack_documents
from quillgate.llm.toxicity import drop_toxic, train


def _with_key(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` and ``key``, by which rows with other ids or texts differ."""
    return docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels, and lets toxic documents go. Null and empty texts have the
    score of no words; without labels of both kinds all texts have one score."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays, a null id being the smallest;
    a null text equals an empty one."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays, a null id being
    the smallest, and of one id the text with the smallest digest. Documents that link with
    nothing, those without a word among them, stay."""
    (key, component, maybe) = unused(docs.columns, "row_key", "row_component", "row_maybe")
    own = _with_key(docs, key)
    groups = ngram_jaccard_join(own.select(key, "text"), key)
    gone = materialise(groups.where(F.col("component_id") < F.col(key)).select(F.col(key).alias(component)).distinct(), "near-gone")
    told = marked(own, F.xxhash64(key), sketch(gone, F.xxhash64(component)), maybe)
    rest, some = told.where(~F.col(maybe)), told.where(maybe)
    return rest.select(*docs.columns).unionByName(some.join(gone, F.col(key) == F.col(component), "left_anti").select(*docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: taken / size, rounded. Runs take documents
    whole but at their ends, so little is rounded. Documents without words aren't taken; of
    rows that repeat id and text each is taken as often as the one taken most."""
    key, of, times, copy = unused(docs.columns, "row_key", "row_of", "row_times", "row_copy")
    own = _with_key(docs, key)
    told = mix_sources(own.select(key, "text", "source"), key)
    often = told.where("size > 0").groupBy(F.col(key).alias(of)).agg(F.max(F.round(F.col("taken") / F.col("size")).cast("int")).alias(times)).where(F.col(times) > 0)
    taken = own.join(often, F.col(key) == F.col(of))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a null or empty text is one token."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("mixing", mixing), ("best-fit packing", packing)]

#: The classifier and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
