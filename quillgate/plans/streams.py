"""Queries of the streaming and ordered operators, with their DuckDB SQL. Streams read files
written from the given tables, run until all is read, and are read back from their sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgate.functions import patterns as P
from quillgate.functions.dates import clock, epoch_ms, iso_utc
from quillgate.functions.decisions import privacy_state, retry_class, status_detail, status_level, status_title
from quillgate.functions.fields import classify_field
from quillgate.functions.perception import parse_perception, parse_plan
from quillgate.functions.regex import sql
from quillgate.functions.text import findings
from quillgate.operators import gate, ordered, quality, rules, settings
from quillgate.operators.payloads import payload_nodes, verdict
from quillgate.plans.queries import _LEAVES, TURNS_SQL, _file_sql, _findings_sql, _keyword_sql, query, table, turn_payloads
from quillgate.sources.files import Folder, shared_folder
from quillgate.sources.html import page_elements
from quillgate.sources.png import png_dimensions
from quillgate.sources.snapshots import snapshot_stream
from quillgate.streaming import attempts, changes, counters, egress, latency, snapshots, task_log


def _inbox(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A stream of what comes to a folder, all that is there as one batch."""
    Folder(spark, folder).make()
    return spark.readStream.schema(schema).parquet(folder)


def _in_parts(parts: Iterable[DataFrame], folder: str, advance: Callable[[], None]) -> None:
    """Writes the parts one after the other, each in as many files as its plan has tasks, and
    lets ``advance`` read each before the next comes. A stream that goes on from its checkpoint
    has each part as a batch."""
    for rows in parts:
        rows.write.mode("append").parquet(folder)
        advance()


# the sink of payloads --------------------------------------------------------------------


@query("gated_egress_stream", f"SELECT payload_id, safe AS sent, n_findings, findings FROM ({TURNS_SQL})")
def gated_egress_stream(spark: SparkSession, d: str) -> DataFrame:
    """The payloads of :func:`turn_payloads` through the sink, in three batches, each of them
    once more by a stream that knows nothing of the first."""
    rows, root = turn_payloads(spark, d), shared_folder(spark, "egress")
    # judging takes far longer than reading: as many files as a shuffle has parts
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def advance() -> None:
        for log in ("log", "log-again"):
            egress.gated_stream(_inbox(spark, f"{root}/in", rows.schema), f"{root}/out", f"{root}/{log}").awaitTermination()

    _in_parts((rows.where(F.pmod("payload_id", F.lit(3)) == k).repartition(files, "payload_id") for k in range(3)), f"{root}/in", advance)
    left = egress.sent(spark, f"{root}/out", rows.schema).select("payload_id", F.lit(True).alias("sent"), F.lit(0).cast("long").alias("n_findings"), F.lit("").alias("findings"))
    return left.unionByName(egress.quarantined(spark, f"{root}/out", rows.schema).select("payload_id", F.lit(False).alias("sent"), "n_findings", F.array_join("findings", ", ").alias("findings")))


# snapshots -------------------------------------------------------------------------------

# a medium for each paragraph of a page, with a name, a type and a size made of its place
_SHOWN = """SELECT page_id, i, CASE (page_id + i) % 9 WHEN 0 THEN 'pan-card.png' WHEN 1 THEN 'salary_slip.pdf' WHEN 2 THEN 'holiday.jpg' WHEN 3 THEN '' END AS file_name,
 CASE (page_id * 3 + i) % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' END AS mime, CASE (page_id + 2 * i) % 8 WHEN 0 THEN 'bank statement' WHEN 1 THEN '' END AS alt,
 CASE (page_id + i) % 6 WHEN 0 THEN 'Passport' END AS title, p || CASE (page_id + 5 * i) % 10 WHEN 0 THEN ' PAN ABCDE1234F' WHEN 1 THEN ' Medical Report of a patient' ELSE '' END AS ocr,
 (page_id + i) % 10 <> 0 AS seen, CASE WHEN (page_id + i) % 11 <> 0 THEN 100 + (page_id * 37 + i) % 300 END AS w, (page_id * 53 + 7 * i) % 250 AS h"""
_PARAGRAPHS = "regexp_extract_all(html, '<p>([^<]+)', 1)"
_METHODS = "list_filter(ms, lambda x, i: list_position(ms, x) = i)"
_SNAPSHOT_SQL = f"""
WITH p AS ({_SHOWN} FROM (SELECT page_id, m[i + 1] AS p, i FROM (SELECT page_id, m, unnest(range(0, len(m))) AS i FROM (SELECT page_id, {_PARAGRAPHS} AS m FROM pages)))),
a AS (SELECT *, coalesce(nullif(alt, ''), title) AS told, coalesce(nullif(alt, ''), nullif(title, ''), 'img') AS label FROM p WHERE seen AND w IS NOT NULL),
e AS (SELECT *, list_filter(list_concat([{_keyword_sql("ocr")}], list_transform([{_keyword_sql("told")}], lambda x: CASE WHEN x IS NOT NULL THEN {{'m': 'alt_text', 'c': x.c, 'w': x.w}} END), [{_file_sql("nullif(file_name, '')")},
  CASE WHEN mime IN ({", ".join(map(sql, P.MIME_TYPES))}) THEN {{'m': 'mime_type', 'c': 'document', 'w': 0.8::DOUBLE}} END,
  CASE WHEN coalesce(w / nullif(h, 0)::DOUBLE BETWEEN 1.35 AND 1.85, false) THEN {{'m': 'aspect_ratio', 'c': 'generic_identity', 'w': 0.4::DOUBLE}} END]), lambda x: x IS NOT NULL) AS e FROM a),
c AS (SELECT *, list_transform(e, lambda x: x.m) AS ms, least(1.0::DOUBLE, list_max(list_transform(e, lambda x: x.w)) + 0.05::DOUBLE * (len(e) - 1)) AS confidence,
  coalesce(list_filter(list_transform(e, lambda x: x.c), lambda x: x NOT IN ('generic_identity', 'document'))[1], e[1].c) AS category FROM e WHERE len(e) > 0),
d AS (SELECT *, CASE WHEN list_max(list_transform(e, lambda x: x.w)) >= 0.7 OR confidence >= 0.7 THEN 'redact' WHEN confidence >= 0.35 THEN 'confirm' ELSE 'safe' END AS decision FROM c)
SELECT page_id AS snapshot_id, CAST(i AS INTEGER) AS ord, kind, category, CASE kind WHEN 'region' THEN decision WHEN 'blocked' THEN label ELSE array_to_string({_METHODS}, ',') END AS told,
  CASE WHEN kind <> 'blocked' THEN round(confidence, 4) END AS confidence, CASE WHEN kind = 'region' THEN CAST(w AS DOUBLE) END AS width
FROM (SELECT *, unnest(['region', 'blocked', 'document']) AS kind FROM d WHERE decision <> 'safe')"""


@query("snapshot_documents_stream", _SNAPSHOT_SQL)
def snapshot_documents_stream(spark: SparkSession, d: str) -> DataFrame:
    """Pages as snapshots of nested JSON, in files of a stream; all three projections."""
    pages = table(spark, d, "pages").selectExpr("page_id", f"posexplode({_PARAGRAPHS}) as (i, p)")
    media = spark.sql(f"{_SHOWN} FROM {{p}}", p=pages)
    box = F.when(F.col("w").isNotNull(), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("w").cast("double").alias("width"), F.col("h").cast("double").alias("height")))
    medium = F.struct(F.lit("img").alias("tag"), "alt", "title", F.col("file_name").alias("fileName"), F.col("mime").alias("mimeType"), F.col("ocr").alias("ocrText"), F.col("seen").alias("visible"), box.alias("bbox"))
    by = media.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", medium.alias("m")))), lambda x: x["m"]).alias("mediaCandidates"))
    shots, root = by.join(table(spark, d, "pages").select("page_id", "url"), "page_id").withColumnRenamed("page_id", "snapshot_id"), shared_folder(spark, "snapshots")
    shots.repartition(3).write.json(f"{root}/in")
    snapshots.snapshot_sink(snapshot_stream(spark, f"{root}/in", 1), f"{root}/out", f"{root}/log").awaitTermination()
    none = F.lit(None).cast("double")
    told = {
        "region": (F.col("decision"), F.round("score", 4), F.col("bbox.width")),
        "blocked": (F.col("label"), none, none),
        "document": (F.array_join("methods", ","), F.round("confidence", 4), none),
    }
    out = None
    for kind, (what, confidence, width) in told.items():
        one = snapshots.projection(spark, f"{root}/out", kind).select("snapshot_id", "ord", F.lit(kind).alias("kind"), "category", what.alias("told"), confidence.alias("confidence"), width.alias("width"))
        out = one if out is None else out.unionByName(one)
    return out


# the log of tasks ------------------------------------------------------------------------

_ENTRY = "'{\"n\":' || CAST(event_id AS {s}) || ',\"value\":' || CAST(event_id % 10 AS {s}) || ',\"kind\":\"' || event_type || '\"}'"


def _timed_parts(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame]]:
    """The events, and these in four parts by time; the last one has, besides, the newest of
    the third again and some that are far too late."""
    e = table(spark, d, "events").where("ts is not null")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    at = (F.col("ts").cast("double") - F.lit(first).cast("double")) / F.greatest(F.lit(last).cast("double") - F.lit(first).cast("double"), F.lit(1.0))
    log = e.select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("event"), "value", F.expr(_ENTRY.replace("{s}", "STRING")).alias("props"), F.least(F.lit(3), F.floor(4 * at)).cast("int").alias("part"))
    span = last - first
    again = log.where("part = 2").where(F.col("ts") >= F.lit(first + span * 0.74)).withColumn("part", F.lit(3))
    late = log.where("part = 0 and seq % 5 = 0").withColumns({"seq": F.col("seq") + 10**9, "part": F.lit(3)})
    return log, [*(log.where(F.col("part") == k) for k in range(3)), log.where("part = 3").unionByName(again).unionByName(late)]


@query("task_log_last", f"""
SELECT user_id, seq, event, replace(entry, '"value":' || (seq % 10), '"value":"[REDACTED]"') AS entry FROM (
  SELECT user_id, event_id AS seq, event_type AS event, {_ENTRY.replace("{s}", "VARCHAR")} AS entry, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50""")
def task_log_last(spark: SparkSession, d: str) -> DataFrame:
    """The last 50 entries of each user, kept as state, of a log in which a day's entries come
    twice and old ones too late."""
    root = shared_folder(spark, "task-log")
    log, parts = _timed_parts(spark, d)
    stream = _inbox(spark, f"{root}/in", log.schema)
    _in_parts(parts, f"{root}/in", lambda: task_log.append_log(stream, "user_id", f"{root}/log", f"{root}/state", late="2 days").awaitTermination())
    return task_log.last_entries(spark, f"{root}/state").select("user_id", "seq", "event", "entry")


# counters --------------------------------------------------------------------------------

_COUNTS = "count(*) FILTER (event_type = 'view') AS scans, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS blocked, count(*) AS events, max(ts) AS last_at"
_TIMES = """strftime(begins, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(extract(millisecond FROM begins) AS INTEGER) % 1000 AS VARCHAR), 3, '0') || 'Z' AS begins, epoch_us(ends) // 1000 AS ends_ms,
 strftime(last_at, '%I:%M %p') AS last_clock, last_at"""


def _drained(spark: SparkSession, d: str, make) -> DataFrame:
    """A stream of counters over :func:`_timed_parts`, with a row of no user behind all, by
    which the last windows are closed."""
    root = shared_folder(spark, "counters")
    log, parts = _timed_parts(spark, d)
    end = log.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 90 days")).alias("ts"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields[2:]))
    stream = _inbox(spark, f"{root}/in", log.schema).withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["seq"])
    counts = {"scans": F.col("event") == "view", "blocked": F.col("event") == "purchase"}
    kept = make(stream, "user_id", {c: v.cast("int") for c, v in counts.items()})
    _in_parts([*parts, end], f"{root}/in", lambda: counters.counters_sink(kept, f"{root}/out", f"{root}/state").awaitTermination())
    out = spark.read.schema(kept.schema).parquet(f"{root}/out").where("user_id is not null")
    return out.select("user_id", iso_utc(F.col("begins")).alias("begins"), epoch_ms(F.col("ends")).alias("ends_ms"), "scans", "blocked", "events", "last_reason", clock(F.col("last_at")).alias("last_clock"), F.col("last_at").cast("timestamp_ntz").alias("last_at"))


_REASON = "arg_max(event_id, ts) FILTER (event_type = 'error') AS last_reason"


@query("event_windows_stream", f"""
SELECT user_id, {_TIMES}, scans, blocked, events, CAST(last_reason AS VARCHAR) AS last_reason FROM (SELECT user_id, date_trunc('day', ts) AS begins, date_trunc('day', ts) + INTERVAL 1 DAY AS ends, {_COUNTS}, {_REASON} FROM events GROUP BY user_id, date_trunc('day', ts))""")
def event_windows_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each user and day, from a stream with repeated and late events."""
    reason = F.when(F.col("event") == "error", F.col("seq").cast("string"))
    return _drained(spark, d, lambda rows, key, counts: counters.window_counters(rows, key, counts, "1 day", reason, late=None))


@query("event_sessions_stream", f"""
WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT user_id, {_TIMES}, scans, blocked, events, CAST(last_reason AS VARCHAR) AS last_reason FROM (SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 12 HOUR AS ends, {_COUNTS}, {_REASON} FROM r GROUP BY user_id, run)""")
def event_sessions_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each user's sessions, which end with twelve quiet hours."""
    reason = F.when(F.col("event") == "error", F.col("seq").cast("string"))
    return _drained(spark, d, lambda rows, key, counts: counters.session_counters(rows, key, counts, "12 hours", reason, late=None))


# settings --------------------------------------------------------------------------------


@query("settings_versions", """
SELECT CAST(user_id AS VARCHAR) AS owner, event_type AS name, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS VARCHAR) END AS value, 3 AS version FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def settings_versions(spark: SparkSession, d: str) -> DataFrame:
    """Events as changes of their users' settings, merged in three versions by time; a second
    writer from each version, with other values, loses."""
    root = shared_folder(spark, "settings")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("owner"), F.col("event_type").alias("name"), F.expr("case when event_id % 7 <> 0 then cast(event_id as string) end").alias("value"), "ts", "event_id")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    edges = [first + (last - first) * k / 3 for k in (1, 2)]
    part = F.expr("0") + sum((F.col("ts") > F.lit(x)).cast("int") for x in edges)
    for k in range(3):
        changes = settings.latest(e.where(part == k), [F.col("ts"), F.col("event_id")])
        settings.merge(spark, root, changes, k)
        try:
            settings.merge(spark, root, changes.withColumn("value", F.lit("lost")), k)
        except settings.Conflict:
            continue
        raise AssertionError("both writers of a version have won")
    return settings.stored(spark, root).withColumn("version", F.lit(settings.version(spark, root)))


# runs ------------------------------------------------------------------------------------

# one user with a third of all events and more
_HOT = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END"
_RUNS_SQL = f"""
WITH e AS (SELECT {_HOT} AS user_id, ts, event_type IN ('view', 'click') AS calm FROM events),
s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR lag(calm) OVER w <> calm OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600 * 1000000::BIGINT THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, calm)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, calm ROWS UNBOUNDED PRECEDING) AS run FROM s),
runs AS (SELECT user_id, calm, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, calm, run)"""


def _event_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.expr(_HOT).alias("user_id"), "ts", F.col("event_type").isin("view", "click").alias("calm"))
    return ordered.runs(e, "user_id", "ts", "calm", gap=21_600)


@query("event_runs", f"{_RUNS_SQL} SELECT * FROM runs")
def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of calm and other events of each user, with six hours between two at most."""
    return _event_runs(spark, d)


@query("longest_event_runs", f"{_RUNS_SQL} SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1")
def longest_event_runs(spark: SparkSession, d: str) -> DataFrame:
    return ordered.longest_runs(_event_runs(spark, d), "user_id")


@query("running_status", f"""
SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS events, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS blocked, max(CASE WHEN event_type = 'view' THEN ts END) OVER w AS last_scan_at
FROM (SELECT *, {_HOT} AS u FROM events) WINDOW w AS (PARTITION BY u ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_status(spark: SparkSession, d: str) -> DataFrame:
    """Counters and the time of the last scan at every event, one user having a third of all."""
    e = table(spark, d, "events").withColumn("u", F.expr(_HOT))
    sums = {"events": F.lit(1).cast("long"), "blocked": (F.col("event_type") == "purchase").cast("long")}
    return ordered.running(e, "u", ["ts", "event_id"], sums, {"last_scan_at": F.when(F.col("event_type") == "view", F.col("ts"))}).select("event_id", *sums, "last_scan_at")


# quality ---------------------------------------------------------------------------------


@query("detector_curve", f"""
WITH f AS (SELECT id, max(confidence) + least(count(*), 50) / 1000.0::DOUBLE AS s FROM ({_findings_sql("SELECT doc_id AS id, text FROM documents")}) GROUP BY id),
j AS (SELECT coalesce(lang, 'none') AS lang, coalesce(f.s, 0) AS s, toxic = 1 AS y FROM labels JOIN documents USING (doc_id) LEFT JOIN f ON doc_id = f.id),
b AS (SELECT lang, s, count(*) FILTER (y) AS y, count(*) FILTER (NOT y) AS n FROM j GROUP BY lang, s),
c AS (SELECT lang, s AS threshold, CAST(sum(y) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(y) OVER a - sum(y) OVER w AS BIGINT) AS fn, CAST(sum(n) OVER a - sum(n) OVER w AS BIGINT) AS tn FROM b
  WINDOW w AS (PARTITION BY lang ORDER BY s DESC), a AS (PARTITION BY lang))
SELECT lang, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 9) AS f1 FROM c""")
def detector_curve(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of the detectors against the labels, at every threshold, by
    language. A document's score is its surest finding and, a little, their number."""
    f = findings(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), f.alias("f"))
    score = F.when(F.size("f") > 0, F.array_max(F.transform("f", lambda x: x["confidence"])) + F.least(F.size("f"), F.lit(50)) / F.lit(1000.0)).otherwise(0.0)
    told = table(spark, d, "labels").join(docs.select("doc_id", "lang", score.alias("score")), "doc_id").withColumn("expected", F.col("toxic") == 1)
    c = quality.threshold_curve(told, "lang")
    return c.withColumns({"threshold": F.round("threshold", 6), **{r: F.round(r, 9) for r in ("precision", "recall", "f1")}})


# attempts --------------------------------------------------------------------------------

_TRIED = "CASE WHEN value < 2 THEN 'browser:upload_file' ELSE 'mouse:click' END"


@query("event_attempts_stream", f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(date_trunc('millisecond', ts)) AS ms, event_type NOT IN ('error', 'purchase', 'view') AS ok, {_TRIED} AS variant, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('millisecond', ts), event_id) AS n FROM events),
r AS (SELECT *, 1 AS attempt, CASE WHEN ok THEN 'done' WHEN variant = 'browser:upload_file' THEN 'confirm' ELSE 'retry' END AS next FROM e WHERE n = 1
  UNION ALL SELECT e.*, a, CASE WHEN e.ok THEN 'done' WHEN e.variant = 'browser:upload_file' THEN 'confirm' WHEN a >= 3 THEN 'stop' ELSE 'retry' END
  FROM (SELECT r.user_id AS u, r.n + 1 AS m, r.ms AS before, r.attempt AS t, r.next AS nx FROM r) p JOIN e ON e.user_id = u AND e.n = m, LATERAL (SELECT CASE WHEN nx = 'retry' AND e.ms <= before + 14400000 * t THEN t + 1 ELSE 1 END AS a))
SELECT event_id, CAST(attempt AS INTEGER) AS attempt, next FROM r
UNION ALL SELECT event_id, CAST(attempt AS INTEGER), 'expired' FROM r WHERE next = 'retry' AND NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = r.user_id AND e.n = r.n + 1 AND e.ms <= r.ms + 14400000 * r.attempt)""")
def event_attempts_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as tries; four hours, and more with each attempt, are waited for the
    next. A row of no user behind all lets the last ones end."""
    root, none = shared_folder(spark, "attempts"), F.lit(None).cast("string")
    cls = retry_class(F.col("variant"), none, none, none)
    e = table(spark, d, "events").select("user_id", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "purchase", "view")).alias("ok"), F.expr(_TRIED).alias("variant"))
    tries = e.select("user_id", "ts", "seq", "ok", F.lit(False).alias("succeeded"), cls.alias("retry"))
    # out of order within a day
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    half = F.col("ts") + F.expr("make_interval(0, 0, 0, 0, pmod(seq * 7, 20))") > F.lit(first + (last - first) / 2)
    tries = tries.withColumn("_h", half.cast("int"))
    end = tries.agg(F.max("ts").alias("ts"), F.max("retry").alias("retry")).select(F.lit(None).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 90 days")).alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("ok"), F.lit(False).alias("succeeded"), "retry", F.lit(2).alias("_h"))
    told = attempts.attempt_stream(_inbox(spark, f"{root}/in", end.schema), "user_id", wait_ms=14_400_000, late="2 days")
    _in_parts([tries.where("_h = 0"), tries.where("_h = 1"), end], f"{root}/in", lambda: attempts.attempts_sink(told, f"{root}/out", f"{root}/state").awaitTermination())
    return spark.read.schema(told.schema).parquet(f"{root}/out").where("user_id is not null").select(F.col("seq").alias("event_id"), "attempt", "next")


# rules -----------------------------------------------------------------------------------


@query("rule_hits_documents", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS rule, CASE " + " ".join(f"WHEN contains(t, {sql(w)}) THEN {sql(w)}" for w in words) + " END AS word FROM (SELECT doc_id, lower(text) AS t FROM documents)" for c, words in P.DOCUMENT_KEYWORDS.items()
) + ") WHERE word IS NOT NULL")
def rule_hits_documents(spark: SparkSession, d: str) -> DataFrame:
    """The keyword groups of documents as a table of rules over all texts."""
    r = spark.createDataFrame(list(P.DOCUMENT_KEYWORDS.items()), "rule string, words array<string>")
    return rules.rule_hits(table(spark, d, "documents"), r, "doc_id", "text").drop("at")


# latency ---------------------------------------------------------------------------------


@query("scan_latency", f"SELECT count(*) AS scans, count(*) FILTER (NOT safe) AS blocked, true AS in_order FROM ({TURNS_SQL})")
def scan_latency(spark: SparkSession, d: str) -> DataFrame:
    """Scans of all turns' payloads in two batches, each looked at once: how many, how many
    blocked, and whether the times by rank lie in order between 0 and the longest."""
    rows, parts = turn_payloads(spark, d), []
    for k in range(2):
        own, seen = latency.timed(rows.where(F.expr(f"pmod(payload_id, 2) = {k}")))
        own.write.format("noop").mode("overwrite").save()
        parts.append(latency.scans(seen))
    whole = latency.merged(spark, parts)
    q = list(latency.quantiles(spark, whole).values())
    return spark.createDataFrame([(whole.n, whole.blocked, [0, *q, whole.most_ns] == sorted([0, *q, whole.most_ns]))], "scans long, blocked long, in_order boolean")


# what is told of pages and turns ----------------------------------------------------------

# the links of a page, some with an address, a number or a date behind their text
_LINKED = """label || CASE (page_id * 5 + ord) % 19 WHEN 0 THEN ' a@b.co' WHEN 4 THEN ' call 9876543210' WHEN 9 THEN ' 01/02/1990' WHEN 11 THEN ' room 4321' ELSE '' END"""
_LINKS_SQL = f"""l AS (SELECT page_id, i - 1 AS ord, m[i] AS label FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1) AS m FROM pages))),
e AS (SELECT page_id, ord, {_LINKED} AS label FROM l),
f AS (SELECT id.p AS page_id, id.o AS ord, arg_min(category, (r, s)) AS category, max(confidence) AS best FROM ({_findings_sql("SELECT {'p': page_id, 'o': ord} AS id, label AS text FROM e", True)}) GROUP BY id)"""
_URLS_SQL = f"u AS (SELECT DISTINCT id FROM ({_findings_sql('SELECT page_id AS id, url AS text FROM pages')}))"


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of every page's links, in their order."""
    a = page_elements(table(spark, d, "pages").select("page_id", "html")).where("tag = 'a'").withColumn("at", F.monotonically_increasing_id())
    ranked = a.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1)
    e = ranked.withColumn("label", F.expr(_LINKED))
    none = F.lit(None).cast("string")
    return gate.element_verdicts(e.select("page_id", "ord", "label", F.col("tag").alias("type"), F.col("label").alias("text"), F.lit(False).alias("flagged"), none.alias("kind"), F.lit(0.8).alias("confidence")))


@query("gate_regions_pages", f"WITH {_LINKS_SQL} SELECT page_id, CAST(ord AS INTEGER) AS ord, category, 'regex' AS source, greatest(0.8::DOUBLE, best) AS score FROM f")
def gate_regions_pages(spark: SparkSession, d: str) -> DataFrame:
    """The sensitive ones of every page's links."""
    return gate.regions(_links(spark, d))


@query("gate_context_pages", f"""
WITH {_LINKS_SQL}, {_URLS_SQL},
k AS (SELECT page_id, category, min(ord) AS o FROM f GROUP BY page_id, category),
ks AS (SELECT page_id, string_agg(category, ', ' ORDER BY o, category) AS kinds FROM k GROUP BY page_id),
t AS (SELECT page_id, label, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM e WHERE label <> '' AND (page_id, ord) NOT IN (SELECT (page_id, ord) FROM f)),
ts AS (SELECT page_id, string_agg(CASE WHEN length(label) > 120 THEN left(label, 120) || '…' ELSE label END, ', ' ORDER BY n) AS others FROM t WHERE n <= 25 GROUP BY page_id)
SELECT page_id, concat_ws(' ', CASE WHEN u.id IS NOT NULL THEN '[REDACTED]' WHEN length(url) > 120 THEN left(url, 120) || '…' ELSE nullif(url, '') END,
  'This page contains the following sensitive field types (values withheld): ' || kinds || '.', 'Other visible non-sensitive elements: ' || others || '.', 'User task: read page ' || page_id) AS context
FROM pages LEFT JOIN ks USING (page_id) LEFT JOIN ts USING (page_id) LEFT JOIN u ON u.id = page_id""")
def gate_context_pages(spark: SparkSession, d: str) -> DataFrame:
    """What may be told of every page: its address, kinds of sensitive links, other links."""
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("description"), F.concat(F.lit("read page "), F.col("page_id").cast("string")).alias("instruction"))
    return gate.context(_links(spark, d), pages)


@query("privacy_state_turns", f"""
WITH v AS ({TURNS_SQL}), f AS (SELECT id.c AS c, count(*) AS n FROM ({_findings_sql(f"SELECT id, t AS text FROM ({_LEAVES})")}) GROUP BY id.c)
SELECT payload_id, CASE WHEN NOT safe THEN 'BLOCKED' WHEN coalesce(n, 0) > 0 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS state,
  CASE WHEN NOT safe THEN {sql(P.STATE_REASONS["leak"])} WHEN coalesce(n, 0) > 0 THEN {sql(P.STATE_REASONS["regions"])} ELSE {sql(P.STATE_REASONS["safe"])} END AS reason FROM v LEFT JOIN f ON c = payload_id""")
def privacy_state_turns(spark: SparkSession, d: str) -> DataFrame:
    """The state of each conversation: blocked by its scan, or suspicious for what is found in
    its turns, surely or not."""
    rows = turn_payloads(spark, d)
    v = rows.select("payload_id", verdict(F.col("payload")).alias("v"), F.filter(payload_nodes(F.col("payload")), lambda n: n["s"].isNotNull()).alias("nodes"))
    n = F.aggregate(F.transform("nodes", lambda x: F.size(findings(x["s"]))), F.lit(0), lambda a, x: a + x)
    state = privacy_state(F.col("v.safe"), n, F.lit(True), F.lit(True), F.lit(True), F.lit(False))
    return v.select("payload_id", state.alias("s")).select("payload_id", "s.state", "s.reason")


@query("activity_log_props", """
SELECT user_id, event_id AS seq, 'value=[redacted] kind=' || event_type || ' n=' || CAST(event_id AS VARCHAR) AS props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""")
def activity_log_props(spark: SparkSession, d: str) -> DataFrame:
    """The last twenty entries of each user with their properties, as they may be shown."""
    e = table(spark, d, "events")
    props = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("n"), F.col("event_id").cast("string"))
    log = e.select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("event"), props.alias("props"))
    told = changes.activity_view(log, "user_id")
    return told.select("user_id", "seq", F.concat_ws(" ", F.transform(F.map_entries("props"), lambda x: F.concat_ws("=", x["key"], x["value"]))).alias("props"))


@query("status_of_users", f"""
WITH l AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id) AS models FROM events)
SELECT user_id, CASE event_type WHEN 'purchase' THEN 'blocked' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'model_unavailable' WHEN 'view' THEN 'attention' ELSE 'protected' END AS level,
  CASE event_type WHEN 'purchase' THEN {sql(P.STATUS["blocked"])} WHEN 'click' THEN {sql(P.STATUS["running"])} WHEN 'error' THEN {sql(P.STATUS["unavailable"])} WHEN 'view' THEN {sql(P.STATUS["no_ocr"])} ELSE {sql(P.STATUS["ready"])} END AS title,
  CASE event_type WHEN 'purchase' THEN 'purchase ' || event_id WHEN 'click' THEN {sql(P.STATUS_DETAIL["running"])} WHEN 'error' THEN {sql(P.STATUS_DETAIL["unavailable"])} WHEN 'view' THEN {sql(P.STATUS_DETAIL["no_ocr"])}
    ELSE CASE WHEN models > 10 THEN {sql(P.STATUS_DETAIL["ready_remote"])} ELSE {sql(P.STATUS_DETAIL["ready"])} END END AS detail FROM l WHERE n = 1""")
def status_of_users(spark: SparkSession, d: str) -> DataFrame:
    """What the status shows after each user's last event: level, title and detail."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("l"), F.count_if(F.col("event_type") == "signup").alias("signups"))
    kind = F.col("l.event_type")
    blocked = F.when(kind == "purchase", F.concat(F.lit("purchase "), F.col("l.event_id").cast("string")))
    model = F.when(kind == "error", "unavailable").otherwise("ready")
    running, ocr = kind == "click", kind != "view"
    return last.select("user_id", status_level(blocked, running, model, ocr).alias("level"), status_title(blocked, running, model, ocr).alias("title"), status_detail(blocked, running, model, ocr, F.col("signups") > 10).alias("detail"))


@query("page_link_fields", r"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, m[i] AS label, h[i] AS href, 'html > body > nav > ul > ' || CASE WHEN len(m) > 1 THEN 'li:nth-of-type(' || i || ')' ELSE 'li' END || ' > a' AS selector_path, 'link' AS role
FROM (SELECT page_id, m, h, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1) AS m, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM pages))""")
def page_link_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every page's links as fields: their labels, targets and paths."""
    a = page_elements(table(spark, d, "pages").select("page_id", "html")).where("element = 'field' and tag = 'a'").withColumn("at", F.monotonically_increasing_id())
    ord = F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1
    return a.select("page_id", ord.alias("ord"), "label", "href", "selector_path", "role")


# parsers over the turns and pages ---------------------------------------------------------


@query("perception_of_turns", """
SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN coalesce(nullif(role, ''), 'element') ELSE 'unknown_region' END AS type, CASE WHEN turn % 4 < 2 THEN text END AS label,
  NOT (turn % 4 < 2 AND conv_id % 2 = 0) AS sensitive, CASE WHEN turn % 4 >= 2 THEN 0.0 WHEN turn % 3 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, turn % 4 >= 2 AS failed FROM conversations""")
def perception_of_turns(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a perception model made of the turns: in a fence, in prose, cut off, and
    without elements. What can't be read is one sensitive element."""
    t = table(spark, d, "conversations")
    one = F.struct(F.col("role").alias("type"), F.col("text").alias("label"), F.when(F.expr("conv_id % 2 = 0"), False).alias("sensitive"), F.when(F.expr("turn % 3 = 0"), 0.9).alias("confidence"))
    whole = F.to_json(F.struct(F.array(one).alias("elements")))
    k = F.expr("turn % 4")
    raw = F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```"))).when(k == 1, F.concat(F.lit("I see "), whole, F.lit(" there."))).when(k == 2, F.expr("left('{\"elements\":[{\"label\":\"cut', 25)")).otherwise('{"page":"nothing"}')
    p = t.select("conv_id", "turn", parse_perception(raw, F.lit(100), F.lit(50)).alias("p")).select("conv_id", "turn", F.get("p.elements", F.lit(0)).alias("e"), "p.failed")
    return p.select("conv_id", "turn", "e.type", "e.label", "e.sensitive", "e.confidence", "failed")


@query("plans_of_turns", f"""
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN CAST(conv_id % 4 AS INTEGER) END AS n, CASE WHEN turn % 4 = 0 THEN conv_id % 2 = 0 END AS done,
  CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN coalesce(text, '') = '' THEN {sql(P.PLAN_EMPTY)} ELSE {sql(P.PLAN_UNREAD)} END WHEN 2 THEN {sql(P.PLAN_EMPTY)} ELSE {sql(P.PLAN_WITHOUT_ACTIONS)} END AS error FROM conversations""")
def plans_of_turns(spark: SparkSession, d: str) -> DataFrame:
    """Remote answers made of the turns: plans with some actions, prose, nothing, no actions."""
    t, k = table(spark, d, "conversations"), F.expr("turn % 4")
    actions = F.slice(F.array(*(F.struct(F.lit("mouse:click").alias("variant"), F.col("text").alias("content")) for _ in range(3))), F.lit(1), F.expr("cast(conv_id % 4 as int)"))
    raw = F.when(k == 0, F.concat(F.lit("```\n"), F.to_json(F.struct(actions.alias("actions"), F.expr("conv_id % 2 = 0").alias("done"))), F.lit("\n```"))).when(k == 1, F.col("text")).when(k == 3, '{"done":false}').otherwise("")
    return t.select("conv_id", "turn", parse_plan(raw).alias("p")).select("conv_id", "turn", F.when(F.col("p.error").isNull(), F.size("p.actions")).alias("n"), "p.done", "p.error")


@query("png_headers_of_pages", """
SELECT page_id, CASE WHEN page_id % 5 <> 0 AND page_id % 7 <> 0 THEN CAST(page_id * 37 % 5000 + 1 AS INTEGER) END AS width, CASE WHEN page_id % 5 <> 0 AND page_id % 7 <> 0 THEN CAST(length(url) AS INTEGER) END AS height FROM pages""")
def png_headers_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """A header for every page, its height the length of the address; some with another
    signature, some cut off."""
    side = lambda c: F.lpad(F.hex(c), 8, "0")
    start = F.when(F.expr("page_id % 5 = 0"), "0000000000000000").otherwise("89504E470D0A1A0A")
    data = F.concat(start, F.lit("0000000D49484452"), side(F.expr("page_id * 37 % 5000 + 1")), side(F.length("url")))
    data = F.base64(F.unhex(F.when(F.expr("page_id % 7 = 0"), F.left(data, F.lit(40))).otherwise(data)))
    url = F.when(F.expr("page_id % 2 = 0"), F.concat(F.lit("data:image/png;base64,"), data)).otherwise(data)
    return table(spark, d, "pages").select("page_id", png_dimensions(url).alias("p")).select("page_id", "p.width", "p.height")


_HINTS = f"list_filter([{', '.join(map(sql, P.NAME_HINTS))}], lambda x: contains(hay, x))"


@query("classify_link_fields", f"""
WITH {_LINKS_SQL}, g AS (SELECT page_id, ord, lower('   ' || label || ' ') AS hay FROM e)
SELECT page_id, CAST(ord AS INTEGER) AS ord, len({_HINTS}) > 0 AS sensitive, {_HINTS}[1] AS category, array_to_string(list_transform({_HINTS}, lambda x: 'field hint "' || x || '"'), ', ') AS reasons FROM g""")
def classify_link_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every page's links as form fields, classified by their labels, with the reasons."""
    none = F.lit(None).cast("string")
    c = classify_field(none, none, none, none, F.col("label"), none)
    return _links(spark, d).select("page_id", "ord", c.alias("c")).select("page_id", "ord", "c.sensitive", "c.category", F.array_join("c.reasons", ", ").alias("reasons"))
