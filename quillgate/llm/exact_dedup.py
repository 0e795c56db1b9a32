"""Exact dedup as stateful streaming with a disk-backed keyed state.

Rows arrive in an inbox as digests, each with a locator of its content: the file and the row
in it. A stream reads the inbox; its state, in RocksDB on the executors' disks with its log
in the shared folder, has one entry per digest and never expires: the digest, the stable
identifier and the content locator of the row that stays, and the number of rows. An inbox
that gets new rows later is read on from where the stream ended, against the same state.

A hit (a digest seen before) is an equal digest only. The contents of hits are then read
back by their locators and compared byte for byte with the content of the row that stays;
digests whose contents differ are told apart by the contents themselves. Contents of
digests with one row aren't moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm._sketch import marked, sketch
from quillgate.llm._store import drop, materialise, settings, shared_path, unused

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How the state is kept while the stream runs.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # executors look this often whether a store's stream has ended, and then free its local files
    "spark.sql.streaming.stateStore.maintenanceInterval": "2s",
    # a store would set 4 MB aside for its manifest however small it is: a GB for 250 partitions
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
PLACE = ("file", "row")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame, name: str = "dedup-contents") -> DataFrame:
    """``docs`` with file and row, where each row's content lies. A scan of Parquet files
    has them; rows of anything else, or with columns of these names, are written first."""
    if not {c.lower() for c in docs.columns} & set(PLACE):
        try:
            return docs.select(*docs.columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        except AnalysisException:
            pass
    file, row = unused(docs.columns, *PLACE)
    held = materialise(docs, name)
    return held.select(*docs.columns, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))


class DedupStream:
    """A standing dedup: :meth:`add` rows to the inbox, :meth:`advance` the state over what
    has come since, read it by :meth:`state`. A new object on the same folder goes on."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or shared_path(spark, "exact-dedup")
        self.inbox, self.log, self.out, self.sources = (f"{self.root}/{x}" for x in ("inbox", "checkpoint", "updates", "sources"))

    def add(self, contents: DataFrame, digest: Callable[[Column], Column] = sha256) -> None:
        """contents: (id, text, file, row), as of :func:`located`; only digests are written.
        ``seq`` tells rows apart that a plan has made from one stored row."""
        own = contents.select("id", "file", "row", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha"), F.monotonically_increasing_id().alias("seq"))
        own.write.mode("append").parquet(self.inbox)
        files = self.spark.createDataFrame([(f, contents.columns[1]) for f in contents.inputFiles()], "file string, text_col string")
        files.coalesce(1).write.mode("append").parquet(self.sources)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.inbox)

    def advance(self) -> None:
        """Reads on what the inbox has got, in one micro-batch, and stops."""
        with settings(self.spark, STATE):
            arrived = self.spark.readStream.schema(self.rows().schema).parquet(self.inbox)
            seen = arrived.groupBy("digest").agg(F.max(F.struct("id", "file", "row", "seq")).alias("stays"), F.count(F.lit(1)).alias("rows"))

            def write(batch: DataFrame, n: int) -> None:
                # overwritten when a lost batch is done again
                batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{self.out}/batch={n}")

            query = seen.writeStream.outputMode("update").option("checkpointLocation", self.log).foreachBatch(write).trigger(availableNow=True).start()
            query.awaitTermination()

    def state(self) -> DataFrame:
        """(digest, id, file, row, seq, rows): the state, as the last update of each digest."""
        kind = self.rows().schema["id"].dataType.simpleString()
        schema = f"digest string, stays struct<id:{kind},file:string,row:bigint,seq:bigint>, rows bigint, batch int"
        updates = self.spark.read.schema(schema).parquet(self.out)
        last = updates.groupBy("digest").agg(F.max_by(F.struct("stays", "rows"), "batch").alias("s"))
        return last.select("digest", "s.stays.id", "s.stays.file", "s.stays.row", "s.stays.seq", "s.rows")

    def hits(self, contents: DataFrame) -> DataFrame:
        """(digest, file, row, text, stays) of the rows behind hits, their contents read back
        from ``contents`` (text, file, row) by their locators; ``stays`` marks those that
        the state names. A stored row counts once."""
        state = self.state().where("rows > 1").select("digest", F.col("file").alias("keep_file"), F.col("row").alias("keep_row"))
        places = self.rows().join(state, "digest").select("digest", F.col("file").alias("at_file"), F.col("row").alias("at_row"), ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("stays"))
        places = materialise(places.distinct(), "dedup-hits")
        place = lambda f, r: F.xxhash64(F.col(f), F.col(r))
        some = marked(contents.select("text", "file", "row"), place("file", "row"), sketch(places, place("at_file", "at_row")), "maybe").where("maybe")
        return some.join(places, (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row"))).select("digest", "file", "row", "text", "stays")

    def clashes(self, contents: DataFrame) -> DataFrame:
        """(digest) of the hits whose contents aren't all equal, byte for byte. Each task
        reduces its contents of a digest before any shuffle."""
        same = self.hits(contents).groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
        return same.where("low != high").select("digest")

    def contents(self, id_col: str, text_col: str) -> DataFrame:
        """(id, text, file, row) of all rows added so far, from the files they came from."""
        files = [r.file for r in self.spark.read.parquet(self.sources).select("file").distinct().collect()]
        return located(self.spark.read.parquet(*files).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))


def _told(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(id, file, row, keep_id, group_size, kept, sha) of each row, and ``docs`` located."""
    placed = located(docs)
    file, row = placed.columns[-2:]
    contents = placed.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(file).alias("file"), F.col(row).alias("row"))
    stream = DedupStream(docs.sparkSession)
    stream.add(contents, digest)
    stream.advance()
    mixed = materialise(stream.clashes(contents), "dedup-mixed")
    stays = stream.state().select("digest", F.col("id").alias("keep_id"), F.col("seq").alias("keep_seq"), F.col("rows").alias("group_size"))
    rows = stream.rows()
    clean = mixed.isEmpty()
    same = stays if clean else stays.join(mixed, "digest", "left_anti")
    names = ["id", "file", "row", "keep_id", "group_size", (F.col("seq") == F.col("keep_seq")).alias("kept"), "sha"]
    told = rows.join(same, "digest").select(*names)
    if not clean:
        apart = rows.join(mixed, "digest", "left_semi").withColumnsRenamed({"file": "at_file", "row": "at_row"})
        texts = contents.select("text", "file", "row")
        apart = materialise(apart.join(texts, (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row"))).select("id", "file", "row", "seq", "sha", "text"), "dedup-apart")
        by_text = apart.groupBy("text").agg(F.max(F.struct("id", "file", "row", "seq")).alias("s"), F.count(F.lit(1)).alias("group_size"))
        told = told.unionByName(apart.join(by_text.select("text", "s.*", "group_size").withColumnsRenamed({"id": "keep_id", "seq": "keep_seq", "file": "f", "row": "r"}), "text").select(*names))
    return told, placed


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; texts are equal as they are. Of equal texts the row with the
    largest id stays, a null id being the smallest; of rows that also repeat the id, one.
    An empty table gives no rows; other columns are not looked at. ``digest`` is a string
    column of the text; whatever it is, only equal texts are put together.
    """
    told, _ = _told(docs, id_col, text_col, digest)
    return told.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns; nulls,
    ties and empty tables as there. Rows that stay go where they are; only those that share
    the sketch of the others are joined to these, by their locators."""
    told, placed = _told(docs, id_col, text_col, sha256)
    file, row = placed.columns[-2:]
    gone_file, gone_row, n, maybe = unused(placed.columns, "gone_file", "gone_row", "gone_n", "gone_maybe")
    # a stored row that a plan repeats has one place; all but one of its rows may be gone
    by_place = told.groupBy(F.col("file").alias(gone_file), F.col("row").alias(gone_row)).agg(F.bool_or("kept").alias("any"), F.count(F.lit(1)).alias(n))
    gone = materialise(by_place.where(f"not any or {n} > 1"), "dedup-gone")
    place = lambda f, r: F.xxhash64(F.col(f), F.col(r))
    own = marked(placed, place(file, row), sketch(gone, place(gone_file, gone_row)), maybe)
    at = (F.col(file) == F.col(gone_file)) & (F.col(row) == F.col(gone_row))
    rest = own.where(~F.col(maybe)).select(*docs.columns)
    some = own.where(maybe)
    kept = rest.unionByName(some.join(gone.select(gone_file, gone_row), at, "left_anti").select(*docs.columns))
    if gone.where("any").isEmpty():
        return kept
    once = some.join(gone.where("any").select(gone_file, gone_row), at).dropDuplicates([file, row]).select(*docs.columns)
    return kept.unionByName(once)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM d JOIN g USING (text)
"""
