"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame expressions.

Sizes are words. Targets come from the weights, limited to twice a source's size, and what
is above is shared again. The whole target is a number of equal-token blocks, allocated to
the sources by highest quotients target / (2 q + 1), and a source's blocks to its shards in
the same way by the shards' sizes. In each shard the documents stand in seeded order as one
stream of words, cut into blocks; a quota takes whole rounds of the shard and, for what is
left, a run of blocks from a seeded block on, around the end. So documents are taken whole
but where a run begins or ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate.llm._store import materialise

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block; documents of a shard at most, on average; seed of the order.
BLOCK, SHARD_DOCS, SEED = 32, 5000, "mix-1"
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): the weights repeat over the sources by code
    point, null last; no target is above ``most`` times its source's size.

    A level l makes target = min(most * size, l * weight). Sources are capped in order of
    most * size / weight; the level behind the capped ones follows from running sums.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    everything = W.partitionBy()
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * float(share)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weights_left)
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    whole = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(whole))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(parts: DataFrame, seats: Column | str, votes: str, group: list[str], order: list[Column]) -> DataFrame:
    """Adds ``quota``: ``seats`` of a group given to its parts by the highest quotients
    votes / (2 q + 1); equal quotients go by ``order``. ``_id`` tells the parts apart.

    With k parts, a part's seats are at least share * (seats - k / 2) - 1/2; so many are
    given at once, and only the few left are given by comparing quotients.
    """
    own = W.partitionBy(*group)
    seats = F.col(seats) if isinstance(seats, str) else seats
    k, total = F.count(F.lit(1)).over(own), F.sum(votes).over(own)
    p = parts.withColumn("_seats", seats.cast("long")).withColumn("_k", k).withColumn("_total", total.cast("double"))
    share = F.when(F.col("_total") > 0, F.col(votes) / F.col("_total")).otherwise(0.0)
    p = p.withColumn("_sure", F.greatest(F.lit(0).cast("long"), F.floor(share * (F.col("_seats") - F.col("_k") / 2.0) - 0.5).cast("long")))
    p = p.withColumn("_left", F.col("_seats") - F.sum("_sure").over(own))
    most = F.floor(share * (F.col("_k") + 1.0)).cast("long") + 2
    more = p.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), most))).where(f"{votes} > 0")
    rank = F.row_number().over(W.partitionBy(*group).orderBy((F.col(votes) / (2 * (F.col("_sure") + F.col("_q")) + 1)).desc(), *order, F.col("_q")))
    given = more.withColumn("_rank", rank).where("_rank <= _left").groupBy("_id").agg(F.count(F.lit(1)).alias("_more"))
    return p.join(given, "_id", "left").withColumn("quota", F.col("_sure") + F.coalesce("_more", F.lit(0).cast("long"))).select(*parts.columns, "quota")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    shard_docs: int = SHARD_DOCS,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken.

    Null texts have size 0 and are never taken; a null source is a source of its own, last
    in order; rows with a null id are placed by their text and, of copies, their number, so
    that many of them are many places. Repeated rows are rows of their own: where they stand
    at the edge of a run they may get different shares, the same over reruns. An empty table gives no rows; other columns are not looked at.
    """
    id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(id.alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"), F.when(id.isNull(), F.md5(F.coalesce(text, F.lit("")))).alias("digest"))
    spot = lambda *name: F.md5(F.concat(F.lit(f"{seed}/"), *name)).alias("spot")
    sized = rows.where("id is not null").select("id", "source", "size", spot(F.col("id").cast("string")))
    # rows without an id are counted by text and numbered, so copies are told apart
    alike = rows.where("id is null").groupBy("id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    sized = sized.unionByName(alike.select("id", "source", "size", spot(F.lit("null/"), F.col("digest"), F.lit("/"), F.col("copy").cast("string"))))
    sized = materialise(sized, "mix-sizes")
    number = lambda at, n: F.conv(F.substring("spot", at, n), 16, 10).cast("long")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count(F.lit(1)) / shard_docs).cast("long").alias("shards"))
    by_source = targets(sources.select("source", "source_size"), weights, share, most).join(sources.select(F.col("source").alias("s2"), "shards"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    all_sources = W.partitionBy()
    quotas = sainte_lague(
        by_source.withColumn("_id", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("all", F.lit(1)),
        F.round(F.sum("target").over(all_sources) / block),
        "target",
        ["all"],
        [F.col("_id")],
    )
    # a row for each source, and below one for each shard: read again, not worked out again
    quotas = materialise(quotas.select("source", "source_size", "target", "shards", F.col("quota").alias("blocks")), "mix-quotas")
    # a shard of a source, so that no window has a whole source
    placed = sized.join(quotas.select(F.col("source").alias("s2"), "shards"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    placed = placed.withColumn("shard", number(1, 8) % F.col("shards"))
    in_shard = W.partitionBy("source", "shard").orderBy("spot", "id", "size")
    placed = placed.withColumn("end", F.sum("size").over(in_shard.rowsBetween(W.unboundedPreceding, 0)))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(quotas.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    shards = shards.withColumn("_id", F.concat_ws("/", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))), F.col("shard").cast("string")))
    shards = materialise(shards, "mix-shards")
    plan = sainte_lague(shards, "blocks", "shard_size", ["source"], [F.col("shard")])
    n = F.ceil(F.col("shard_size") / block).cast("long")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("_id"))), 1, 8), 16, 10).cast("long")
    plan = (
        plan.withColumn("n", n)
        .withColumn("quota", F.least("quota", most * F.col("n")))
        .withColumn("rounds", F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(0).cast("long"))
        .withColumn("run", F.col("quota") - F.col("rounds") * F.col("n"))
        .withColumn("a", F.when(F.col("n") > 0, start % F.greatest("n", F.lit(1))).otherwise(0).cast("long"))
        .select(F.col("source").alias("s2"), F.col("shard").alias("h2"), "source_size", "target", "rounds", (F.col("a") * block).alias("a"), ((F.col("a") + F.col("run")) * block).alias("b"), (F.col("n") * block).alias("around"))
    )
    out = placed.join(plan, F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("h2")))
    inside = lambda lo, hi: F.greatest(F.lit(0).cast("long"), F.least("end", hi) - F.greatest(F.col("end") - F.col("size"), lo))
    run = inside(F.col("a"), F.least("b", "around")) + F.when(F.col("b") > F.col("around"), inside(F.lit(0).cast("long"), F.col("b") - F.col("around"))).otherwise(0)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("rounds") * F.col("size") + run).cast("long").alias("taken"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WEIGHT = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"


def _lague(parts: str, seats: str, votes: str, group: str, order: str) -> str:
    """:func:`sainte_lague` in DuckDB SQL: (id, quota)."""
    return f"""
  SELECT id, any_value(sure) + count(*) FILTER (quotient_rank <= left_over AND q IS NOT NULL) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY {group}, q IS NULL ORDER BY {votes} / (2 * (sure + q) + 1) DESC, {order}, q) AS quotient_rank FROM (
      SELECT *, unnest(CASE WHEN {votes} > 0 THEN range(0, CAST(floor(share * (k + 1.0::DOUBLE)) AS BIGINT) + 3) ELSE [NULL] END) AS q FROM (
        SELECT *, {seats} - sum(sure) OVER (PARTITION BY {group}) AS left_over FROM (
          SELECT *, greatest(0, CAST(floor(share * ({seats} - k / 2.0::DOUBLE) - 0.5::DOUBLE) AS BIGINT)) AS sure FROM (
            SELECT *, count(*) OVER (PARTITION BY {group}) AS k,
              CASE WHEN sum({votes}) OVER (PARTITION BY {group}) > 0 THEN {votes} / CAST(sum({votes}) OVER (PARTITION BY {group}) AS DOUBLE) ELSE 0 END AS share
            FROM {parts}))))) GROUP BY id"""


OP10_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), 'null/' || md5(coalesce(text, '')) || '/' || row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))))) AS spot FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(ceil(count(*) / {SHARD_DOCS}::DOUBLE) AS BIGINT) AS shards FROM sized GROUP BY source),
w AS (SELECT *, {_WEIGHT} AS weight, CAST(source_size * {MOST} AS DOUBLE) AS cap, sum(source_size) OVER () * {SHARE}::DOUBLE AS total FROM src),
l AS (SELECT *, (total - coalesce(sum(cap) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS lev
  FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN cap <= lev * weight THEN cap
    ELSE (SELECT arg_min(lev, pos) FROM (SELECT lev, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS pos FROM l WHERE NOT cap <= lev * weight)) * weight END AS target FROM l),
tq AS (SELECT source, source_size, target, shards, row_number() OVER (ORDER BY source NULLS LAST) AS id, 1 AS g,
    CAST(round(sum(target) OVER () / {BLOCK}) AS BIGINT) AS seats FROM t),
q1 AS ({_lague("tq", "seats", "target", "g", "id")}),
quotas AS (SELECT tq.*, q1.quota AS blocks FROM tq JOIN q1 USING (id)),
placed AS (SELECT s.*, q.source_size, q.target, q.blocks, CAST('0x' || substr(s.spot, 1, 8) AS BIGINT) % q.shards AS shard
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
ended AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY spot, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM placed),
sh AS (SELECT source, shard, any_value(blocks) AS blocks, CAST(sum(size) AS BIGINT) AS shard_size,
    coalesce('s' || source, 'n') || '/' || shard AS id FROM placed GROUP BY source, shard),
q2 AS ({_lague("sh", "blocks", "shard_size", "source", "shard")}),
plan AS (SELECT source, shard, n, least(quota, {MOST} * n) AS quota,
    CASE WHEN n > 0 THEN CAST('0x' || substr(md5('{SEED}/' || id), 1, 8) AS BIGINT) % n ELSE 0 END AS a
  FROM (SELECT sh.*, q2.quota, CAST(ceil(shard_size / {BLOCK}::DOUBLE) AS BIGINT) AS n FROM sh JOIN q2 USING (id))),
run AS (SELECT source, shard, CASE WHEN n > 0 THEN quota // n ELSE 0 END AS rounds, a * {BLOCK} AS a,
    (a + quota - CASE WHEN n > 0 THEN quota // n ELSE 0 END * n) * {BLOCK} AS b, n * {BLOCK} AS around FROM plan)
SELECT doc_id, size, source_size, target, CAST(rounds * size
    + greatest(0, least(stop, least(b, around)) - greatest(stop - size, a))
    + CASE WHEN b > around THEN greatest(0, least(stop, b - around) - greatest(stop - size, 0)) ELSE 0 END AS BIGINT) AS taken
FROM ended e JOIN run r ON e.source IS NOT DISTINCT FROM r.source AND e.shard = r.shard
"""
