"""Queries of the privacy engine and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgate.functions import decisions as D
from quillgate.functions import leaks
from quillgate.functions import patterns as P
from quillgate.functions.documents import classify, redaction_label, shape_evidence
from quillgate.functions.fields import classify_field
from quillgate.functions.perception import host_of, parse_perception, parse_plan, settings_of
from quillgate.functions.regex import java, re2, sql
from quillgate.functions.text import findings, sanitize_text
from quillgate.operators import gate, pixels, session, vault
from quillgate.operators.payloads import payload_gate, payload_leaks
from quillgate.plans import fixtures as X
from quillgate.sources.html import page_elements
from quillgate.sources.png import png_dimensions
from quillgate.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# text findings -------------------------------------------------------------------------


def _findings_sql(rows: str, numbered: bool = False) -> str:
    """(id, category, match, start, end, confidence) of every finding in ``rows`` (id, text),
    and the rule's place where ``numbered``."""
    parts = []
    place = lambda: f", {len(parts)} AS r" if numbered else ""
    cut = "CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER)"
    for category, pattern, strong in P.TEXT_PATTERNS:
        words = " OR ".join(f"contains(w, {sql(w)})" for w in P.CONTEXT_WORDS.get(category, [])) or "false"
        parts.append(f"""
SELECT id, {sql(category)} AS category, match, s, CAST(s + length(match) AS INTEGER) AS e, CASE WHEN {words} THEN 0.95 ELSE {0.8 if strong else 0.35} END::DOUBLE AS confidence{place()}
FROM (SELECT *, lower(substr(text, greatest(s - 60, 0) + 1, s + 60 - greatest(s - 60, 0))) AS w FROM (
  SELECT id, text, m[i] AS match, {cut} AS s FROM (
    SELECT id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT id, text, regexp_extract_all(text, {sql(re2(pattern))}) AS m, regexp_split_to_array(text, {sql(re2(pattern))}) AS g FROM ({rows})))))""")
    for category, pattern, confidence in P.LABELED_PATTERNS:
        own = "(?i)" + re2(pattern)
        keep = f"WHERE regexp_matches(regexp_extract(match, {sql(own)}, 1), {sql('(?i)[0-9]|' + P.ADDRESS_HINTS)})" if category == "address" else ""
        parts.append(f"""
SELECT id, {sql(category)} AS category, {"left(match, 160)" if category == "address" else "match"} AS match, s, CAST(s + length(match) AS INTEGER) AS e, {confidence}::DOUBLE AS confidence{place()} FROM (
  SELECT id, m[i] AS match, {cut} AS s FROM (
    SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT id, regexp_extract_all(text, {sql(own)}) AS m, regexp_split_to_array(text, {sql(own)}) AS g FROM ({rows})))) {keep}""")
    return " UNION ALL ".join(parts)


def _found(d: DataFrame, id: Column, text: Column) -> DataFrame:
    f = d.select(id.alias("id"), F.explode(findings(text)).alias("f"))
    return f.select("id", "f.category", "f.match", F.col("f.start").alias("s"), F.col("f.end").alias("e"), "f.confidence")


_SUMMED = "SELECT category, confidence, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends, count(DISTINCT id) AS texts FROM ({}) GROUP BY ALL"


def _summed(f: DataFrame) -> DataFrame:
    return f.groupBy("category", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s").cast("long")).alias("starts"), F.sum(F.col("e").cast("long")).alias("ends"), F.countDistinct("id").alias("texts"))


for _name, _table, _id, _text in (("documents", "documents", "doc_id", "text"), ("pages", "pages", "page_id", "html"), ("conversations", "conversations", "conv_id * 1000 + turn", "text")):
    query(f"text_findings_{_name}", _SUMMED.format(_findings_sql(f"SELECT {_id} AS id, {_text} AS text FROM {_table}")))(
        lambda spark, d, t=_table, i=_id, x=_text: _summed(_found(table(spark, d, t), F.expr(i), F.col(x)))
    )

_NOTES_SQL = "SELECT * FROM " + X.values(list(enumerate(X.NOTES)), "id, text")


@query("text_findings_cases", _findings_sql(_NOTES_SQL))
def text_findings_cases(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark.createDataFrame(list(enumerate(X.NOTES)), "id int, text string"), F.col("id"), F.col("text"))


# notes made of keys of customers and orders, so that every category occurs
_NOTE = """CASE c_custkey % 6 WHEN 0 THEN 'PAN Number ABCDE' || lpad(CAST(c_custkey % 10000 AS {s}), 4, '0') || 'F'
 WHEN 1 THEN 'aadhaar: 1234 5678 ' || lpad(CAST(c_custkey % 10000 AS {s}), 4, '0') WHEN 2 THEN 'IFSC SBIN0' || lpad(CAST(c_custkey % 1000000 AS {s}), 6, '0')
 WHEN 3 THEN 'mobile 98765' || lpad(CAST(c_custkey % 100000 AS {s}), 5, '0') WHEN 4 THEN 'Name: Asha Rao, dob = 0' || CAST(c_custkey % 9 + 1 AS {s}) || '/10/1988'
 ELSE 'ship to pincode 5' || lpad(CAST(c_custkey % 100000 AS {s}), 5, '0') || ' Address: flat ' || CAST(c_custkey AS {s}) END"""


@query("text_findings_notes", _SUMMED.format(_findings_sql(f"SELECT c_custkey AS id, {_NOTE.format(s='VARCHAR')} AS text FROM customer")))
def text_findings_notes(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "customer").select("c_custkey", F.expr(_NOTE.format(s="STRING")).alias("text"))
    return _summed(_found(notes, F.col("c_custkey"), F.col("text")))


@query("sanitize_conversations", f"""
WITH f AS ({_findings_sql("SELECT conv_id * 1000 + turn AS id, text FROM conversations")})
SELECT conv_id, turn, CASE WHEN conv_id * 1000 + turn IN (SELECT id FROM f WHERE confidence >= 0.8) THEN '[REDACTED]' ELSE text END AS text FROM conversations""")
def sanitize_conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", sanitize_text(F.col("text")).alias("text"))


# documents -----------------------------------------------------------------------------


def _keyword_sql(text: str) -> str:
    """list<struct> of evidence in a text, nulls among it."""
    out = [f"CASE WHEN regexp_matches({text}, {sql('(?i)' + re2(p))}) THEN {{'m': '{m}', 'c': '{c}', 'w': {w}::DOUBLE}} END" for m, c, w, p in (("pan_pattern", "pan", 0.95, P.DOC_PAN), ("ifsc_pattern", "bank", 0.9, P.DOC_IFSC))]
    for category, words in P.DOCUMENT_KEYWORDS.items():
        hit = " OR ".join(f"contains(lower({text}), {sql(w)})" for w in words)
        out.append(f"CASE WHEN {hit} THEN {{'m': 'sensitive_keyword', 'c': '{category}', 'w': 0.85::DOUBLE}} END")
    return ", ".join(out)


def _file_sql(name: str) -> str:
    return ", ".join(f"CASE WHEN regexp_matches({name}, {sql('(?i)' + p)}) THEN {{'m': 'file_name', 'c': '{c}', 'w': {w}::DOUBLE}} END" for p, c, w in P.FILE_HINTS)


_LABEL_SQL = "CASE " + " ".join(f"WHEN category IN ({', '.join(map(sql, g))}) THEN {sql(t)}" for g, t in P.LABELS) + f" ELSE {sql(P.OTHER_LABEL)} END"


def _decided_sql(rows: str) -> str:
    """``rows``: (id, e) with e the evidence list."""
    return f"""
WITH ev AS (SELECT id, list_filter(e, lambda x: x IS NOT NULL) AS e FROM ({rows})),
c AS (SELECT id, e, CASE WHEN len(e) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, list_max(list_transform(e, lambda x: x.w)) + 0.05::DOUBLE * (len(e) - 1)) END AS confidence,
  coalesce(list_filter(list_transform(e, lambda x: x.c), lambda x: x NOT IN ('generic_identity', 'document'))[1], e[1].c) AS category FROM ev),
d AS (SELECT *, CASE WHEN len(e) = 0 THEN 'safe' WHEN list_max(list_transform(e, lambda x: x.w)) >= 0.7 OR confidence >= 0.7 THEN 'redact' WHEN confidence >= 0.35 THEN 'confirm' ELSE 'safe' END AS decision FROM c)
SELECT id, decision, category, round(confidence, 4) AS confidence, CAST(len(e) AS INTEGER) AS n_evidence, CASE WHEN decision <> 'safe' THEN {_LABEL_SQL} END AS label FROM d"""


def _classified(d: DataFrame, id: str, ocr: Column, file: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    c = classify(ocr, file, none, none, F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(False))
    d = d.select(F.col(id).alias("id"), c.alias("c"))
    return d.select("id", "c.decision", "c.category", F.round("c.confidence", 4).alias("confidence"), "c.n_evidence", "c.label")


@query("classify_documents", _decided_sql(f"SELECT doc_id AS id, [{_keyword_sql('text')}] AS e FROM documents"))
def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    return _classified(table(spark, d, "documents"), "doc_id", F.col("text"), F.lit(None).cast("string"))


_FILE = "CASE p_partkey % 8 WHEN 0 THEN 'pan_card' WHEN 1 THEN 'salary-slip' WHEN 2 THEN 'id-card' WHEN 3 THEN 'bank legal' WHEN 4 THEN 'form16' WHEN 5 THEN 'Epic Roll-No' ELSE p_name END || '.pdf'"


@query("classify_file_names", _decided_sql(f"SELECT p_partkey AS id, [{_file_sql('f')}] AS e FROM (SELECT p_partkey, {_FILE} AS f FROM part)"))
def classify_file_names(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.expr(_FILE).alias("f"))
    return _classified(parts, "p_partkey", F.lit(None).cast("string"), F.col("f"))


@query("redaction_labels", f"SELECT category, {_LABEL_SQL} AS label FROM (SELECT unnest([{', '.join(sql(c) for c in [*P.DOCUMENT_KEYWORDS, 'statement', 'other'])}]) AS category)")
def redaction_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in [*P.DOCUMENT_KEYWORDS, "statement", "other"]], "category string")
    return rows.select("category", redaction_label(F.col("category")).alias("label"))


_SIZES = "SELECT s_suppkey AS id, 300 + s_suppkey * 37 % 900 AS w, s_suppkey * 53 % 700 AS h FROM supplier"


@query("card_shapes", f"SELECT id, coalesce(w * 1.0::DOUBLE / nullif(h, 0) BETWEEN 1.35 AND 1.85, false) AS card_like FROM ({_SIZES})")
def card_shapes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("300 + s_suppkey * 37 % 900").alias("w"), F.expr("s_suppkey * 53 % 700").alias("h"))
    return s.select("id", (F.size(shape_evidence(F.col("w"), F.col("h"))) > 0).alias("card_like"))


@query("png_headers", "SELECT * FROM (VALUES (0, 1, 1), (1, NULL, NULL), (2, NULL, NULL), (3, 400, 252)) t(id, width, height)")
def png_headers(spark: SparkSession, d: str) -> DataFrame:
    one = "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg=="
    rows = spark.createDataFrame([(0, "data:image/png;base64," + one), (1, "not base64!"), (2, None), (3, "iVBORw0KGgoAAAANSUhEUgAAAZAAAAD8")], "id int, url string")
    return rows.select("id", png_dimensions(F.col("url")).alias("p")).select("id", "p.width", "p.height")


# leaks ---------------------------------------------------------------------------------


def _gate_sql(rows: str) -> str:
    """(id, category, match) of the gate patterns, keys and tokens in ``rows`` (id, t)."""
    own = []
    for category, pattern in P.GATE_PATTERNS:
        # RE2 has no lookahead: the character behind is matched and left out
        p = r"(?i)\b([\w.-]{2,}@[a-z]{2,})(?:[^\w.]|$)" if category == "upi" else re2(pattern)
        own.append(f"SELECT id, '{category}' AS category, unnest(regexp_extract_all(t, {sql(p)}, {1 if category == 'upi' else 0})) AS match FROM ({rows})")
    key = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, {sql(re2(p))}), '')" for p in P.API_KEYS) + ")"
    own.append(f"SELECT id, 'api_key' AS category, {key} AS match FROM ({rows}) WHERE {key} IS NOT NULL")
    own.append(f"SELECT id, 'access_token' AS category, regexp_extract(t, {sql(re2(P.BEARER))}) AS match FROM ({rows}) WHERE regexp_matches(t, {sql(re2(P.BEARER))})")
    return " UNION ALL ".join(own)


for _name, _table, _id, _text in (("documents", "documents", "doc_id", "text"), ("pages", "pages", "page_id", "html")):

    def _gated(spark: SparkSession, d: str, t: str = _table, i: str = _id, x: str = _text, most: int | None = P.SCAN_CHARS) -> DataFrame:
        s = F.col(x) if most is None else F.left(F.col(x), F.lit(most))
        found = [leaks._each(c, leaks.matches(s, c, p)) for c, p in P.GATE_PATTERNS]
        one = lambda c, v: leaks._one(c, v, 0.8)
        own = F.flatten(F.array(*found, one("api_key", F.coalesce(*(leaks.first(s, p) for p in P.API_KEYS))), one("access_token", leaks.first(s, P.BEARER))))
        return table(spark, d, t).select(F.col(i).alias("id"), F.explode(own).alias("f")).select("id", "f.category", "f.match")

    query(f"leak_patterns_{_name}", _gate_sql(f"SELECT {_id} AS id, left({_text}, {P.SCAN_CHARS}) AS t FROM {_table}"))(_gated)
    # the SQL above fixes a prefix; these two scan texts to their end
    query(f"leak_patterns_whole_{_name}", _gate_sql(f"SELECT {_id} AS id, {_text} AS t FROM {_table}"))(lambda spark, d, f=_gated: f(spark, d, most=None))


_LUHN = "list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN CAST(substr(x, i, 1) AS INT) WHEN CAST(substr(x, i, 1) AS INT) * 2 > 9 THEN CAST(substr(x, i, 1) AS INT) * 2 - 9 ELSE CAST(substr(x, i, 1) AS INT) * 2 END)) % 10 = 0"


def _scan_sql(rows: str) -> str:
    """(id, category, match, confidence, place) of a leak scan of ``rows`` (id, t), without the
    insides of base64 bodies: the forms of a text, the rules in order, each category and match
    once. ``place`` orders the findings of a row."""
    wide, narrow = sql(leaks._WIDE), sql(leaks._NARROW)
    forms = f"""SELECT {{'id': id, 'form': form}} AS id, text FROM (
      SELECT id, t, unnest([0, 1, 2]) AS form, unnest([t, coalesce(TRY(url_decode(replace(t, '+', '%2B'))), t), translate(t, {wide}, {narrow})]) AS text FROM ({rows})
      WHERE NOT regexp_matches(t, {sql(P.BASE64_BODY)}) AND NOT regexp_matches(t, {sql(P.DATA_URL)})) WHERE form = 0 OR text <> t"""
    files = sql("(?i)" + "|".join(P.FILE_NAMES))
    own = [f"""SELECT id, 0 AS r, 0 AS s, 'sensitive_filename' AS category, left(trim(text), 120) AS match, 0.85::DOUBLE AS confidence FROM ({forms})
      WHERE regexp_matches(text, {files}) AND regexp_matches(text, {sql("(?i)" + re2(chr(92) + "." + chr(92) + "b[a-z0-9]{2,5}" + chr(92) + "b"))}) AND NOT regexp_matches(text, '(?i)https?://')"""]
    every = lambda r, category, pattern, group=0: f"""SELECT id, {r} AS r, i AS s, '{category}' AS category, m[i] AS match, 0.95::DOUBLE AS confidence FROM (
      SELECT id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, regexp_extract_all(text, {sql(pattern)}, {group}) AS m FROM ({forms})))"""  # noqa: E731
    for k, (category, pattern) in enumerate(P.GATE_PATTERNS):
        # RE2 has no lookahead: the character behind is matched and left out
        own.append(every(1 + k, category, r"(?i)\b([\w.-]{2,}@[a-z]{2,})(?:[^\w.]|$)", 1) if category == "upi" else every(1 + k, category, re2(pattern)))
    kept = ", ".join(map(sql, P.ALWAYS_BLOCK))
    own.append(f"SELECT id, 100 + r AS r, s, category, match, confidence FROM ({_findings_sql(forms, True)}) WHERE category IN ({kept}) OR confidence >= 0.8")
    own.append(f"SELECT * EXCLUDE x FROM (SELECT *, regexp_replace(match, '[^0-9]', '', 'g') AS x FROM ({every(200, 'creditCard', re2(P.CARD))})) WHERE length(x) BETWEEN 13 AND 19 AND {_LUHN}")
    key = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {sql(re2(p))}), '')" for p in P.API_KEYS) + ")"
    own.append(f"SELECT id, 300 AS r, 0 AS s, 'api_key' AS category, {key} AS match, 0.8::DOUBLE AS confidence FROM ({forms}) WHERE {key} IS NOT NULL")
    own.append(f"SELECT id, 301 AS r, 0 AS s, 'access_token' AS category, regexp_extract(text, {sql(re2(P.BEARER))}) AS match, 0.9::DOUBLE AS confidence FROM ({forms}) WHERE regexp_matches(text, {sql(re2(P.BEARER))})")
    return f"""SELECT id.id AS id, category, match, confidence, (id.form, r, s) AS place FROM ({" UNION ALL ".join(own)})
      QUALIFY row_number() OVER (PARTITION BY id.id, category, match ORDER BY id.form, r, s) = 1"""


# no text of the tables is a base64 body, whose insides the SQL doesn't scan
@query("leak_scan_documents", f"SELECT id AS doc_id, category, match, confidence FROM ({_scan_sql('SELECT doc_id AS id, text AS t FROM documents')})")
def leak_scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(F.concat(leaks.scan_text(F.col("text"), None), leaks.scan_base64(F.col("text")))).alias("f")).select("doc_id", "f.*")


@query("luhn_cards", f"""
SELECT doc_id, match, length(x) BETWEEN 13 AND 19 AND {_LUHN} AS valid FROM (SELECT doc_id, match, regexp_replace(match, '[^0-9]', '', 'g') AS x
FROM (SELECT doc_id, unnest(regexp_extract_all(text, {sql(re2(P.CARD))})) AS match FROM documents))""")
def luhn_cards(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(java(P.CARD)), F.lit(0))).alias("match"))
    return m.select("doc_id", "match", leaks.luhn(F.col("match")).alias("valid"))


# a nested payload of each conversation, with a key that must not leave in every third
_PAYLOAD = "CASE WHEN conv_id % 3 = 0 THEN '{\"messages\":[{\"role\":\"user\",\"n\":1},{\"auth\":{\"Token\":[1,null]}}],\"turns\":' ELSE '{\"messages\":[{\"role\":\"user\"}],\"turns\":' END || CAST(count(*) AS {s}) || '}'"


@query("leak_nested_keys", f"""
WITH p AS (SELECT conv_id, {_PAYLOAD.replace("{s}", "VARCHAR")} AS payload FROM conversations GROUP BY conv_id)
SELECT conv_id AS payload_id, replace(j.fullkey, '"', '') AS path FROM p, json_tree(p.payload) j WHERE lower(j.key) IN ({", ".join(map(sql, P.SENSITIVE_KEYS))})""")
def leak_nested_keys(spark: SparkSession, d: str) -> DataFrame:
    p = _payloads(spark, d)
    return payload_leaks(p, depth=None).where("category = 'sensitive_key'").select("payload_id", "path")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """The SQL's payload with the real turns in the place of their number."""
    turns = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    n = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return n.select(F.col("conv_id").alias("payload_id"), F.expr(_PAYLOAD.replace("CAST(count(*) AS {s})", "turns")).alias("payload"))


@query("payload_gate_conversations", "SELECT conv_id AS payload_id, conv_id % 3 <> 0 AS safe, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_findings FROM conversations GROUP BY conv_id")
def payload_gate_conversations(spark: SparkSession, d: str) -> DataFrame:
    return payload_gate(_payloads(spark, d), depth=None).drop("findings")


# the turns with addresses, numbers, names of files and repeated keys planted among them
_TOLD_TURNS = """SELECT conv_id, turn, role || CASE WHEN (conv_id + turn) % 67 = 0 THEN ' ABCDE1234F' ELSE '' END AS role, text || CASE (conv_id * 7 + turn) % 41 WHEN 0 THEN ' write to u' || CAST(conv_id AS {s}) || '@mail.example.org'
 WHEN 3 THEN ' a%40b.co or 9876543210' WHEN 5 THEN ' card 4111 1111 1111 1111, Bearer abcdefghijklmnop' WHEN 7 THEN ' pan-card-scan.png' ELSE '' END AS text FROM conversations"""
_LEAVES = f"""SELECT {{'c': conv_id, 'i': i, 'k': k, 'path': '$.turns[' || i || '].' || CASE k WHEN 0 THEN 'role' ELSE 'text' END}} AS id, CASE k WHEN 0 THEN role ELSE text END AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i, unnest([0, 1]) AS k FROM ({_TOLD_TURNS.replace("{s}", "VARCHAR")}))"""
TURNS_SQL = f"""WITH f AS ({_scan_sql(_LEAVES)}),
o AS (SELECT id.c AS c, category || '@' || id.path AS v, row_number() OVER (PARTITION BY id.c ORDER BY id.i, id.k, place) AS n FROM f),
g AS (SELECT c, count(*) AS n, string_agg(v, ', ' ORDER BY n) FILTER (n <= 10) AS v FROM o GROUP BY c)
SELECT conv_id AS payload_id, g.n IS NULL AS safe, coalesce(g.n, 0) AS n_findings, coalesce(g.v, '') AS findings FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN g ON conv_id = c"""


def turn_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A payload of each conversation's turns; in every third turn the text's key is repeated
    behind it, with nothing to find."""
    t = spark.sql(_TOLD_TURNS.replace("{s}", "STRING").replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, d, "conversations"))
    turn = lambda x: F.to_json(F.struct(x["role"].alias("role"), x["text"].alias("text")))
    each = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.regexp_replace(turn(x), r"\}$", F.when(x["turn"] % 3 == 0, ',"text":"quiet"}').otherwise("}")))
    p = t.groupBy("conv_id").agg(F.concat(F.lit('{"turns":['), F.array_join(each, ","), F.lit("]}")).alias("payload"))
    return p.withColumnRenamed("conv_id", "payload_id")


@query("payload_gate_turns", TURNS_SQL)
def payload_gate_turns(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the real turns and what is planted in them, with the first ten findings."""
    return payload_gate(turn_payloads(spark, d)).withColumn("findings", F.array_join("findings", ", "))


@query("payload_gate_cases", "SELECT id AS payload_id, expect AS safe FROM " + X.values([(i, e) for i, _, e in X.PAYLOADS], "id, expect"))
def payload_gate_cases(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([(i, t) for i, t, _ in X.PAYLOADS], "payload_id int, payload string")
    return payload_gate(p, depth=12).select("payload_id", "safe")


@query("payload_gate_findings", "SELECT id AS payload_id, findings FROM " + X.values([(i, f) for i, _, f in X.ORDERED_PAYLOADS], "id, findings"))
def payload_gate_findings(spark: SparkSession, d: str) -> DataFrame:
    """The first ten findings, in the order of the payload's text, repeats kept."""
    p = spark.createDataFrame([(i, t) for i, t, _ in X.ORDERED_PAYLOADS], "payload_id int, payload string")
    return payload_gate(p, depth=None).select("payload_id", F.array_join("findings", ", ").alias("findings"))


@query("perception_cases", "SELECT id, elements, failed FROM " + X.values([(i, e, f) for i, _, e, f in X.PERCEPTIONS], "id, elements, failed"))
def perception_cases(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model over a frame of 100 by 50, each element as one line of text."""
    p = spark.createDataFrame([(i, t) for i, t, _, _ in X.PERCEPTIONS], "id int, raw string").withColumn("p", parse_perception(F.col("raw"), F.lit(100), F.lit(50)))
    said = lambda x: F.concat_ws("|", x["type"], F.coalesce(x["label"], F.lit("-")), x["sensitive"].cast("string"), x["confidence"].cast("string"), *(x["bbox"][k].cast("int").cast("string") for k in ("x", "y", "width", "height")))
    return p.select("id", F.array_join(F.transform("p.elements", said), "; ").alias("elements"), "p.failed")


@query("plan_cases", "SELECT id, n, error FROM " + X.values([(i, n, e) for i, _, n, e in X.PLANS], "id, n, error"))
def plan_cases(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([(i, t) for i, t, _, _ in X.PLANS], "id int, raw string").withColumn("p", parse_plan(F.col("raw")))
    return p.select("id", F.size("p.actions").alias("n"), "p.error").withColumn("n", F.when(F.col("error").isNull(), F.col("n")))


# pages and forms -----------------------------------------------------------------------


@query("page_links", r"""SELECT page_id, count(*) AS n_links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[ >]')) FROM pages) GROUP BY page_id""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return page_elements(table(spark, d, "pages")).where("tag = 'a'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


def _fields_sql() -> str:
    hay = "lower(coalesce(name, '') || ' ' || coalesce(id, '') || ' ' || coalesce(label, '') || ' ' || coalesce(placeholder, ''))"
    hints = f"list_filter([{', '.join(map(sql, P.NAME_HINTS))}], lambda x: contains({hay}, x))"
    return f"""SELECT page_id, ord, category IS NOT NULL AS sensitive, category, n_hints FROM (
SELECT *, coalesce(CASE WHEN input_type IN ({", ".join(map(sql, P.INPUT_TYPES))}) THEN input_type END, CASE WHEN autocomplete IN ({", ".join(map(sql, P.AUTOCOMPLETE))}) THEN autocomplete END,
  {hints}[1], CASE WHEN input_type = 'file' THEN 'file_upload' END) AS category, CAST(len({hints}) AS INTEGER) AS n_hints FROM {X.values(X.FIELDS, X.FIELD_COLUMNS)})"""


_FIELD_TYPES = "page_id int, ord int, input_type string, autocomplete string, name string, id string, label string, placeholder string"


@query("classify_fields", _fields_sql())
def classify_fields(spark: SparkSession, d: str) -> DataFrame:
    f = spark.createDataFrame(X.FIELDS, _FIELD_TYPES)
    c = classify_field(*(F.col(x) for x in ("input_type", "autocomplete", "name", "id", "label", "placeholder")))
    return f.select("page_id", "ord", c.alias("c")).select("page_id", "ord", "c.sensitive", "c.category", F.size(F.filter("c.reasons", lambda r: r.startswith("field hint"))).alias("n_hints"))


@query("gate_regions")
def gate_regions(spark: SparkSession, d: str) -> DataFrame:
    """Every page's links as perceived elements, with the form fixture as the second layer."""
    e = page_elements(table(spark, d, "pages")).withColumn("ord", F.monotonically_increasing_id())
    seen = gate.element_verdicts(e.select("page_id", "ord", "label", F.col("tag").alias("type"), F.col("label").alias("text"), F.lit(False).alias("flagged"), F.lit(None).cast("string").alias("kind"), F.lit(0.8).alias("confidence")))
    fields = gate.field_verdicts(spark.createDataFrame(X.FIELDS, _FIELD_TYPES).withColumns({"page_id": F.col("page_id").cast("long"), "ord": F.col("ord").cast("long")}))
    return gate.regions(seen.unionByName(fields)).drop("ord")


@query("gate_context")
def gate_context(spark: SparkSession, d: str) -> DataFrame:
    fields = gate.field_verdicts(spark.createDataFrame(X.FIELDS, _FIELD_TYPES))
    pages = spark.createDataFrame([(1, "A form.", "fill it"), (2, None, None)], "page_id int, description string, instruction string")
    return gate.context(fields, pages)


# decisions -----------------------------------------------------------------------------


@query("privacy_states", f"""SELECT id, CASE WHEN scan_safe = false THEN 'BLOCKED' WHEN scan_safe IS NULL OR redaction_ok = false THEN 'UNVERIFIED' WHEN uncertain THEN 'SUSPICIOUS'
WHEN regions > 0 AND NOT perception_ok AND NOT ocr THEN 'UNVERIFIED' WHEN regions > 0 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS state FROM {X.values(X.STATES[::-1], X.STATE_COLUMNS)}""")
def privacy_states(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame(X.STATES, "id int, scan_safe boolean, regions int, redaction_ok boolean, perception_ok boolean, ocr boolean, uncertain boolean")
    return s.select("id", D.privacy_state(*(F.col(c) for c in s.columns[1:]))["state"].alias("state"))


_HARM = " OR ".join(f"contains(h, {sql(w)})" for w in P.DESTRUCTIVE_WORDS)


@query("action_recovery", f"""SELECT id, CASE WHEN variant IN ({", ".join(map(sql, P.PRIVATE_VARIANTS))}) THEN 'confirm' WHEN coalesce(variant, '') NOT IN ({", ".join(map(sql, P.SAFE_VARIANTS))}) AND ({_HARM}) THEN 'confirm'
WHEN attempt >= 3 THEN 'stop' ELSE 'retry' END AS next FROM (SELECT *, lower(concat_ws(' ', path, label, content)) AS h FROM {X.values(X.ACTIONS, X.ACTION_COLUMNS)})""")
def action_recovery(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame(X.ACTIONS, "id int, variant string, path string, label string, content string, attempt int")
    cls = D.retry_class(*(F.col(c) for c in ("variant", "path", "label", "content")))
    return a.withColumn("c", cls).select("id", D.recovery(F.col("c"), F.lit(False), F.col("attempt"), F.lit(3)).alias("next"))


@query("order_routes", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 10) / 10.0::DOUBLE >= 0.7 THEN 'local' WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'remote' ELSE 'local' END AS route FROM orders""")
def order_routes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", D.route(k % 2 == 0, (k % 10) / 10.0, k % 3 == 0, F.when(k % 5 != 0, "https://x")).alias("route"))


@query("action_outcomes", """SELECT event_id, a OR b AS success, CASE WHEN a AND b THEN 1.0 WHEN a OR b THEN 0.6 ELSE 0.1 END::DOUBLE AS confidence FROM (SELECT event_id, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b FROM events)""")
def action_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "events").select("event_id", D.outcome(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0).alias("o"))
    return o.select("event_id", "o.success", "o.confidence")


_STATUS = [(i, b, r, m, o, n, s) for i, (b, r, m, o, n, s) in enumerate((b, r, m, o, n, s) for b in ("leak", None) for r in (True, False) for m in ("ready", "loading", "unavailable", "none") for o in (True, False) for n in (0, 1) for s in (True, False))]


@query("status_steps", f"""SELECT id, CASE WHEN blocked IS NOT NULL THEN 'blocked' WHEN running OR model = 'loading' THEN 'processing' WHEN model = 'unavailable' THEN 'model_unavailable' WHEN NOT ocr THEN 'attention' ELSE 'protected' END AS level,
CASE WHEN running THEN 'running' ELSE 'completed' END || ',' || CASE WHEN model IN ('ready', 'loading') OR ocr THEN CASE WHEN running THEN 'running' ELSE 'completed' END ELSE 'unavailable' END || ',' ||
CASE WHEN regions > 0 THEN 'completed' ELSE 'pending' END || ',' || CASE WHEN blocked IS NOT NULL THEN 'blocked' WHEN scan THEN 'completed' ELSE 'pending' END || ',' ||
CASE WHEN blocked IS NOT NULL THEN 'blocked' WHEN running THEN 'running' WHEN scan THEN 'completed' ELSE 'pending' END AS steps FROM {X.values(_STATUS, "id, blocked, running, model, ocr, regions, scan")}""")
def status_steps(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame(_STATUS, "id int, blocked string, running boolean, model string, ocr boolean, regions int, scan boolean")
    c = {n: F.col(n) for n in s.columns}
    steps = D.pipeline_steps(c["blocked"], c["running"], c["model"], c["ocr"], c["regions"], c["scan"])
    return s.select("id", D.status_level(c["blocked"], c["running"], c["model"], c["ocr"]).alias("level"), F.array_join(F.transform(steps, lambda x: x["state"]), ",").alias("steps"))


@query("validate_actions", "SELECT id, error FROM " + X.values([(i, e) for i, (_, e) in enumerate(X.CHECKED_ACTIONS)][::-1], "id, error"))
def validate_actions(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(X.CHECKED_ACTIONS)], "id int, a string")
    return a.select("id", D.action_error(F.parse_json("a")).alias("error"))


# steps of a task --------------------------------------------------------------------------


@query("log_redaction", """SELECT conv_id, turn, '{"turn":' || turn || ',"role":' || to_json(role) || ',"text":"[REDACTED]","more":[{"content":"[REDACTED]","of":{"role":' || to_json(role) || ',"value":"[REDACTED]"}}]}' AS entry FROM conversations""")
def log_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a nested log entry, without the values of sensitive keys."""
    own = F.struct("turn", "role", "text", F.array(F.struct(F.col("text").alias("content"), F.struct("role", F.col("text").alias("value")).alias("of"))).alias("more"))
    return table(spark, d, "conversations").select("conv_id", "turn", session.redact_log(F.to_json(own, {"ignoreNullFields": "false"})).alias("entry"))


_VARIANT = "CASE event_type WHEN 'view' THEN 'mouse:scroll' WHEN 'purchase' THEN 'browser:upload_file' ELSE 'mouse:click' END"


@query("action_attempts", f"""WITH t AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, event_id % 5 = 0 AS ok, event_id % 7 = 0 AS done, {_VARIANT} AS variant FROM events),
a AS (SELECT *, n // 4 AS run, CAST(n % 4 + 1 AS INTEGER) AS attempt FROM t),
x AS (SELECT *, CASE WHEN ok THEN 'done' WHEN done THEN 'stop' WHEN variant = 'browser:upload_file' THEN 'confirm' WHEN attempt >= 3 THEN 'stop' ELSE 'retry' END AS next FROM a)
SELECT event_id, attempt, next, CASE WHEN next = 'retry' THEN CAST(attempt AS BIGINT) * 1000 END AS wait_ms FROM x
WHERE NOT EXISTS (SELECT 1 FROM x e WHERE e.user_id = x.user_id AND e.run = x.run AND e.attempt < x.attempt AND e.next <> 'retry')""")
def action_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Every four events of a user as the tries of one action."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, d, "events").select("event_id", "user_id", n.alias("n"), (F.col("event_id") % 5 == 0).alias("ok"), (F.col("event_id") % 7 == 0).alias("succeeded"), F.expr(_VARIANT).alias("variant"))
    none = F.lit(None).cast("string")
    tries = e.withColumns({"action": F.struct("user_id", F.expr("n div 4")), "attempt": F.expr("n % 4 + 1"), "retry": D.retry_class(F.col("variant"), none, none, none)})
    return session.attempts(tries, "action").select("event_id", "attempt", "next", "wait_ms")


@query("page_hosts", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]+)', 1)), CASE WHEN url LIKE 'https:%' THEN ':443$' ELSE ':80$' END, '') AS host FROM pages")
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", host_of(F.col("url")).alias("host"))


@query("local_plans", "SELECT id, plan FROM " + X.values([(i, p) for i, _, _, p in X.LOCAL_PLANS], "id, plan"))
def local_plans(spark: SparkSession, d: str) -> DataFrame:
    """Each action of a plan as variant, place and role."""
    fields = "array<struct<label:string,name:string,placeholder:string,input_type:string,selector_path:string,visible:boolean,disabled:boolean>>"
    p = spark.createDataFrame([(i, t, f) for i, t, f, _ in X.LOCAL_PLANS], f"id int, task string, fields {fields}").withColumn("p", session.plan_locally(F.col("task"), F.col("fields")))
    return p.select("id", F.array_join(F.transform("p", lambda a: F.concat_ws(" ", a["variant"], a["selector_path"], a["credential_role"])), "; ").alias("plan"))


@query("region_layers", "SELECT page_id, regions::BIGINT AS regions, documents::BIGINT AS documents, visual::BIGINT AS visual, categories, uncertain FROM " + X.values(X.REGION_TOTALS, "page_id, regions, documents, visual, categories, uncertain"))
def region_layers(spark: SparkSession, d: str) -> DataFrame:
    """Regions of forms, documents and pixels of each page, counted."""
    box = "bbox struct<x:double,y:double,width:double,height:double>"
    media = spark.createDataFrame(X.MEDIA, f"page_id int, ord int, visible boolean, {box}, ocr_text string, file_name string, alt string, title string, mime string")
    seen = spark.createDataFrame(X.SEEN, f"page_id int, category string, score double, {box}")
    off = settings_of(F.create_map(F.lit("ENABLE_SIGNATURE"), F.lit("false")))
    fields = gate.regions(gate.field_verdicts(spark.createDataFrame(X.FIELDS, _FIELD_TYPES)))
    layers = fields.unionByName(gate.document_regions(media), True).unionByName(gate.visual_regions(seen, off), True)
    return gate.region_totals(layers).withColumn("categories", F.array_join("categories", ","))


# ordered and stateful --------------------------------------------------------------------

_EVENT = "CASE event_type WHEN 'click' THEN 'action_executed' WHEN 'view' THEN 'privacy_gate' WHEN 'purchase' THEN 'potential_leak_blocked' ELSE event_type END"


@query("activity_log", f"""WITH r AS (SELECT user_id, ts, event_id AS seq, {_EVENT} AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, seq, coalesce(label, event, 'Event') AS label, coalesce(tone, 'neutral') AS tone FROM r LEFT JOIN {X.values(P.ACTIVITY_EVENTS, "ev, label, tone")} t ON r.event = t.ev WHERE n <= 5""")
def activity_log(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.expr(_EVENT).alias("event"), F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("kind"), F.col("event_type")).alias("props"))
    return changes.activity_view(log, "user_id", 5).select("user_id", "seq", "label", "tone")


@query("running_counts", "SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS total_one, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS total_blocked FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.lit(1).cast("long").alias("one"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long").alias("blocked"))
    return changes.running_counters(e, "user_id", "event_id", ["one", "blocked"]).select("event_id", "total_one", "total_blocked")


@query("last_known_values", "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cached FROM (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN event_type END AS v FROM events)")
def last_known_values(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("v"))
    return changes.last_known(e, "user_id", "event_id", "v").select("event_id", "cached")


@query("changed_vectors", """WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
l AS (SELECT vec_id, b, lag(b) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM b)
SELECT vec_id, p IS NULL OR len(list_filter(range(1, len(b) + 1), lambda i: b[i] <> p[i])) / len(b)::DOUBLE > 0.5 AS changed FROM l""")
def changed_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"))
    return changes.changed(e, "label", "vec_id", "bits", 0.5).select("vec_id", "changed")


# quality, secrets, images ------------------------------------------------------------------


@query("detector_metrics", f"""WITH f AS (SELECT DISTINCT id FROM ({_findings_sql("SELECT doc_id AS id, text FROM documents")}) WHERE confidence >= 0.8),
j AS (SELECT toxic = 1 AS expected, f.id IS NOT NULL AS found FROM labels LEFT JOIN f ON doc_id = f.id)
SELECT count(*) FILTER (expected AND found) AS tp, count(*) FILTER (expected AND NOT found) AS fn, count(*) FILTER (NOT expected AND found) AS fp, count(*) FILTER (NOT expected AND NOT found) AS tn FROM j""")
def detector_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a detector's hits against labels, as for precision and recall."""
    docs = table(spark, d, "documents").select("doc_id", F.exists(findings(F.col("text")), lambda f: f["confidence"] >= 0.8).alias("found"))
    j = table(spark, d, "labels").join(docs, "doc_id", "left").select((F.col("toxic") == 1).alias("e"), F.coalesce("found", F.lit(False)).alias("f"))
    return j.agg(F.count_if(F.col("e") & F.col("f")).alias("tp"), F.count_if(F.col("e") & ~F.col("f")).alias("fn"), F.count_if(~F.col("e") & F.col("f")).alias("fp"), F.count_if(~F.col("e") & ~F.col("f")).alias("tn"))


@query("vault_roundtrip", "SELECT * FROM (VALUES ('otp', '123456', true), ('password', 'pä ss', true)) t(role, value, opened)")
def vault_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("otp", "123456"), ("password", "pä ss")], "role string, value string")
    return vault.decrypt_vault(vault.encrypt_vault(rows, F.lit("open sesame")), F.lit("open sesame"))


@query("image_regions")
def image_regions(spark: SparkSession, d: str) -> DataFrame:
    bars = b"".join((b"\0\0\0\xff" if x // 4 % 2 else b"\xff\xff\xff\xff") for x in range(80)) * 40
    face, blank = b"\xd2\xaa\x8c\xff" * 3600, b"\xff\xff\xff\xff" * 1600
    images = spark.createDataFrame([(0, 80, 40, bytearray(bars)), (1, 60, 60, bytearray(face)), (2, 40, 40, bytearray(blank))], "image_id int, width int, height int, rgba binary")
    return pixels.image_regions(images)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its decision and its strong findings by category."""
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None)
    c = classify(F.col("text"), none.cast("string"), none.cast("string"), none.cast("string"), none.cast("int"), none.cast("int"), F.lit(False))
    strong = F.array_distinct(F.transform(F.filter(findings(F.col("text")), lambda f: f["confidence"] >= 0.8), lambda f: f["category"]))
    out = docs.select("doc_id", c.alias("c"), strong.alias("sensitive_categories"))
    return out.select("doc_id", "c.decision", "c.category", "c.confidence", "c.label", "sensitive_categories")
