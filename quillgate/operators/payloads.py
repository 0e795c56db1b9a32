"""Leak scan of nested payloads. A payload is read in the order of its text, repeated keys
and all, to an array of its nodes beside it; the nodes are scanned by expressions in the same
row. So a payload is judged where it is, in one pass, without a shuffle or a second scan."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillgate.functions import leaks
from quillgate.functions import patterns as P
from quillgate.functions.text import empty, let

#: Findings that a blocked payload is reported with; nodes of a batch of the walk; payloads
#: whose nodes are Python objects at once.
TOLD, BATCH, SOME = 10, 20_000, 256
_NODES = "ord long, path string, key string, kind string, s string, level int"
_LEAK = "struct<path:string,category:string,match:string,confidence:double>"


class Pairs(list):
    """The members of an object in order: a key may stand there more than once."""


def nodes_of(payload: str | None) -> Iterator[tuple]:
    """(path, key, kind, s, level) of every node, depth first, in the order of the text; kind
    is object, array, string or other, s a string's value. Every member of an object is told,
    those of a repeated key under the same path. What is no JSON is one string; what nests
    deeper than the parser goes is one node of kind unread."""
    if payload is None:
        return
    try:
        tree = json.loads(payload, object_pairs_hook=Pairs)
    except ValueError:
        tree = payload
    except RecursionError:
        yield "$", None, "unread", None, 0
        return
    todo = [("$", None, tree, 0)]
    while todo:
        path, key, v, level = todo.pop()
        kind = "object" if isinstance(v, Pairs) else "array" if isinstance(v, list) else "string" if isinstance(v, str) else "other"
        # lone surrogates can't leave as UTF-8
        yield path, key, kind, v.encode("utf-8", "replace").decode() if kind == "string" else None, level
        if kind == "object":
            todo += [(f"{path}.{k}", k, x, level + 1) for k, x in reversed(v)]
        elif kind == "array":
            todo += [(f"{path}[{k}]", None, x, level + 1) for k, x in reversed(list(enumerate(v)))]


def _safe(text: str | None) -> str | None:
    # lone surrogates can't leave as UTF-8
    return text.encode("utf-8", "replace").decode() if isinstance(text, str) else text


def walk(payloads: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, ord, path, key, kind, s, level) of every node of every payload, as of
    :func:`nodes_of`, numbered in order. Null payloads have none; null ids and repeated rows
    stay; an empty table gives no rows; other columns are not looked at."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
        for b in it:
            at, rows = [], []

            def out(b: pa.RecordBatch = b) -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
                return pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *columns], names=["id", *(x.split()[0] for x in _NODES.split(", "))])

            for i, text in enumerate(b.column("payload").to_pylist()):
                for n, node in enumerate(nodes_of(text)):
                    at.append(i)
                    rows.append((n, *map(_safe, node)))
                    if len(at) >= BATCH:
                        yield out()
                        at, rows = [], []
            yield out()

    kind = payloads.schema[id_col].dataType.simpleString()
    return payloads.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{json_col}`").cast("string").alias("payload")).mapInArrow(run, f"id {kind}, {_NODES}")


_NODE = pa.struct([("path", pa.string()), ("key", pa.string()), ("kind", pa.string()), ("s", pa.string()), ("level", pa.int32())])


@F.arrow_udf(ArrayType(StructType([*(StructField(c, StringType()) for c in ("path", "key", "kind", "s")), StructField("level", IntegerType())])))
def payload_nodes(payload: pa.Array) -> pa.Array:
    """The nodes of a payload in order; none for null. Few are held as Python objects at once,
    however many a batch has."""
    parts = []
    for at in range(0, len(payload), SOME):
        columns, ends = [[] for _ in _NODE], [0]
        for text in payload.slice(at, SOME).to_pylist():
            for n in nodes_of(text):
                for c, v in zip(columns, n):
                    c.append(_safe(v))
            ends.append(len(columns[0]))
        nodes = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE)], fields=list(_NODE))
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_NODE))


def node_leaks(node: Column, depth: int | None = None) -> Column:
    """array<path, category, match, confidence> of one node, in the order of the rules. Below
    ``depth`` nothing is read, and what stands there is a finding of its own, as is what can't
    be read; with None there is no bound."""
    key, kind, s, path = F.lower(node["key"]), node["kind"], node["s"], node["path"]
    fixed = lambda when, category, confidence: F.when(F.coalesce(when, F.lit(False)), leaks._leak(category, F.lit(None).cast("string"), confidence))
    secret = key.isin(P.SENSITIVE_KEYS)
    deep = kind == "unread"
    if depth is not None:
        deep = deep | ((node["level"] == depth) & kind.isin("object", "array"))
    entropy = (F.length(s) >= 16) & s.rlike("[A-Za-z0-9]")
    rules = [fixed(key.isin(P.IMAGE_KEYS) & s.isNotNull(), "original_image_data", 1.0), fixed(secret, "sensitive_key", 0.9), fixed(secret & entropy, "credential_value", 1.0), fixed(deep, "unverified", 1.0)]
    place = lambda found, at: F.transform(found, lambda f: F.struct(at.alias("path"), *(f[c].alias(c) for c in ("category", "match", "confidence"))))
    none = empty(_LEAK)
    direct = F.when(key.isNotNull() | (kind != "string"), place(F.array_compact(F.array(*rules)), path)).otherwise(none)
    said = F.when(s.isNotNull(), place(leaks.scan_text(s, None), path)).otherwise(none)
    coded = F.when(leaks.is_base64(s), place(leaks.scan_base64(s), F.concat(path, F.lit(" (base64)")))).otherwise(none)
    found = F.concat(direct, said, coded)
    return found if depth is None else F.when(node["level"] <= depth, found).otherwise(none)


def leaks_of(payload: Column, depth: int | None = None) -> Column:
    """array<path, category, match, confidence>: all findings of a payload in the order of its
    text; none for null."""
    return F.coalesce(F.flatten(F.transform(payload_nodes(payload), lambda n: node_leaks(n, depth))), empty(_LEAK))


def verdict(payload: Column, depth: int | None = None) -> Column:
    """struct<safe, n_findings, findings> of a payload, findings the first ten as
    category@path; a null payload is safe."""

    def told(found: Column) -> Column:
        first = F.transform(F.slice(found, 1, TOLD), lambda f: F.concat_ws("@", f["category"], f["path"]))
        return F.struct((F.size(found) == 0).alias("safe"), F.size(found).cast("long").alias("n_findings"), first.alias("findings"))

    return let(leaks_of(payload, depth), told)


def payload_leaks(payloads: DataFrame, id_col: str = "payload_id", json_col: str = "payload", depth: int | None = None) -> DataFrame:
    """(id, path, category, match, confidence, ord): ``ord`` counts a payload's findings from
    0. Null payloads have none, null ids and repeated rows stay, an empty table gives no rows,
    other columns are not looked at."""
    found = payloads.select(F.col(f"`{id_col}`").alias("_id"), leaks_of(F.col(f"`{json_col}`").cast("string"), depth).alias("_f"))
    return found.select("_id", F.posexplode("_f").alias("ord", "f")).select(F.col("_id").alias(id_col), "f.*", "ord")


def payload_gate(payloads: DataFrame, id_col: str = "payload_id", json_col: str = "payload", depth: int | None = None) -> DataFrame:
    """(id, safe, n_findings, findings), a row for each row of ``payloads``, as of
    :func:`verdict`. Rows that share an id are judged each by itself. An empty table gives no
    rows."""
    return payloads.select(F.col(f"`{id_col}`").alias("_id"), verdict(F.col(f"`{json_col}`").cast("string"), depth).alias("_v")).select(F.col("_id").alias(id_col), "_v.*")


def judged(payloads: DataFrame, id_col: str, json_col: str, depth: int | None = None) -> DataFrame:
    """(own, id, safe, n_findings, findings): the rows of ``payloads`` as structs, so that no
    column of theirs can clash; null where the row is held back, so that its content goes no
    further."""
    v = payloads.select(F.struct(*(F.col(f"`{c}`") for c in payloads.columns)).alias("_own"), verdict(F.col(f"`{json_col}`").cast("string"), depth).alias("_v"))
    return v.select(F.when(F.col("_v.safe"), F.col("_own")).alias("own"), F.col("_own").getField(id_col).alias("id"), "_v.*")


def send_gated(payloads: DataFrame, path: str, quarantine: str, id_col: str = "payload_id", json_col: str = "payload", depth: int | None = None) -> None:
    """The single way out of a table: payloads without a finding are appended to ``path``, the
    others, without their content, to ``quarantine`` with what was found. Rows that share an id
    with a blocked one are blocked; a null id is an id like any other.

    The verdicts are written first, without the content of what is held, and both sides come
    from them, the quarantine before anything is sent: a failure never leaves a row sent
    whose fellow isn't in quarantine yet. For repeated runs see ``streaming.egress``.
    """
    spark = payloads.sparkSession
    staged = f"{quarantine.rstrip('/')}/_judged-{uuid.uuid4().hex}"  # readers pass over the underscore
    rows = judged(payloads, id_col, json_col, depth)
    rows.write.parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    held = rows.where("not safe")
    held.select(F.col("id").alias(id_col), "n_findings", "findings").distinct().write.mode("append").parquet(quarantine)
    blocked = held.select(F.col("id").alias("_b")).distinct()
    rows.where("safe").join(blocked, F.col("id").eqNullSafe(F.col("_b")), "left_anti").select("own.*").write.mode("append").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
