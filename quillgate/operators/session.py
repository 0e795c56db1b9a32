"""The steps of a task as tables: local plans, attempts, what a log may hold, the report."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillgate.functions import patterns as P
from quillgate.functions.decisions import recovery
from quillgate.operators.ordered import own_columns

MOST_ATTEMPTS, WAIT_MS = 3, 1000
MARK = "[REDACTED]"
ACTION = "struct<variant:string,selector_path:string,credential_role:string>"


def marked_json(text: str | None) -> str | None:
    """The JSON text without the values of the log's sensitive keys, at any depth. What can't
    be read is marked as a whole; null stays null."""
    if text is None:
        return None
    try:
        kept = json.loads(text, object_hook=lambda o: {k: MARK if k in P.LOG_KEYS else v for k, v in o.items()})
    except (ValueError, RecursionError):
        kept = MARK
    # lone surrogates can't leave as UTF-8
    return json.dumps(kept, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace").decode()


@F.pandas_udf(StringType())
def redact_log(entries: pd.Series) -> pd.Series:
    """:func:`marked_json` of each entry."""
    return entries.map(marked_json, na_action="ignore")


def plan_locally(instruction: Column, fields: Column) -> Column:
    """array<ACTION> for the fields that can be filled without any model, in their order, or
    null if none can. ``fields``: array of structs with label, name, placeholder, input_type,
    selector_path, visible, disabled; fields not known to be visible, and disabled ones, are
    passed over, and so are those without any name. A null instruction is an empty one."""
    asked = F.contains(F.lower(F.coalesce(instruction, F.lit(""))), F.lit("aadhaar"))

    def action(f: Column) -> Column:
        name = F.lower(F.coalesce(*(F.nullif(f[k], F.lit("")) for k in ("label", "name", "placeholder"))))
        own = asked & F.contains(name, F.lit("aadhaar"))
        told = lambda variant, role: F.struct(F.lit(variant).alias("variant"), f["selector_path"].alias("selector_path"), F.lit(role).alias("credential_role"))
        done = (
            F.when(own & f["input_type"].eqNullSafe("file"), told("browser:upload_file", "aadhaar_document"))
            .when(own, told("local:fill_credential", "aadhaar_number"))
            .when(f["input_type"] == "password", told("local:fill_credential", "password"))
        )
        return F.when(F.coalesce(f["visible"], F.lit(False)) & ~F.coalesce(f["disabled"], F.lit(False)) & name.isNotNull(), done)

    found = F.array_compact(F.transform(fields, action))
    return F.when(F.size(found) > 0, found.cast(f"array<{ACTION}>"))


def attempts(tries: DataFrame, key: str, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The attempts that are made of those that would be: adds next (done, stop, confirm or
    retry) and wait_ms before the next one.

    ``tries``: (key, attempt from 1, ok, succeeded, retry); ok says that the attempt ran
    without error, succeeded that the page changed all the same, retry is a retry class. An
    action ends with its first attempt that isn't to be tried again. Null flags are false;
    rows of a null key are one action; of rows that share an attempt, the order is open.
    """
    attempt = F.col("attempt")
    after = F.when(F.coalesce("ok", F.lit(False)), "done").otherwise(recovery(F.col("retry"), F.col("succeeded"), attempt, F.lit(most)))
    w = W.partitionBy(key).orderBy("attempt").rowsBetween(W.unboundedPreceding, -1)
    own = own_columns(tries, "_ended")[0]
    ended = tries.withColumn("next", after).withColumn(own, F.coalesce(F.max(F.col("next") != "retry").over(w), F.lit(False)))
    return ended.where(~F.col(own)).drop(own).withColumn("wait_ms", F.when(F.col("next") == "retry", attempt.cast("long") * WAIT_MS))


def diagnostics(items: DataFrame) -> DataFrame:
    """One row (report): JSON of all items (k, v), the report's own list of some dozen lines,
    in order of k. Of a key that repeats the largest value stays; null keys go, null values
    are empty; without items the report has none."""
    own = items.where("k is not null").groupBy("k").agg(F.max(F.coalesce("v", F.lit(""))).alias("v"))
    listed = own.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("diagnostics"))
    return listed.select(F.to_json(F.struct(F.lit(True).alias("safe"), "diagnostics")).alias("report"))
