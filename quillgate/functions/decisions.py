"""Decision tables as ordered conditions over columns; null flags count as not given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.functions import patterns as P


def _on(flag: Column, default: bool) -> Column:
    return F.coalesce(flag, F.lit(default))


def privacy_state(scan_safe: Column, regions: Column, redaction_ok: Column, perception_ok: Column, ocr: Column, uncertain: Column) -> Column:
    """struct<state, reason>; a scan that is null was not made, and proves nothing."""
    some = F.coalesce(regions, F.lit(0)) > 0
    rows = [
        (scan_safe == F.lit(False), "BLOCKED", P.STATE_REASONS["leak"]),
        (scan_safe.isNull(), "UNVERIFIED", P.STATE_REASONS["no_scan"]),
        (~_on(redaction_ok, True), "UNVERIFIED", P.STATE_REASONS["redaction"]),
        (_on(uncertain, False), "SUSPICIOUS", P.STATE_REASONS["document"]),
        (some & ~_on(perception_ok, True) & ~_on(ocr, True), "UNVERIFIED", P.STATE_REASONS["blind"]),
        (some, "SUSPICIOUS", P.STATE_REASONS["regions"]),
    ]
    out = F.struct(F.lit("SAFE").alias("state"), F.lit(P.STATE_REASONS["safe"]).alias("reason"))
    for when, state, reason in reversed(rows):
        out = F.when(when, F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def can_proceed(state: Column) -> Column:
    return F.coalesce(state == "SAFE", F.lit(False))


def retry_class(variant: Column, target_path: Column, target_label: Column, content: Column, target_json: Column | None = None) -> Column:
    """struct<retryable, requires_confirmation, reason>; ``target_json`` is all of the target,
    in any part of which a harmful word counts."""
    words = F.lower(F.concat_ws(" ", target_path, target_label, content, *([] if target_json is None else [target_json])))
    harmful = F.exists(F.array(*map(F.lit, P.DESTRUCTIVE_WORDS)), lambda w: F.contains(words, w))
    told = lambda retry, reason: F.struct(F.lit(retry).alias("retryable"), F.lit(not retry).alias("requires_confirmation"), F.lit(reason).alias("reason"))
    return (
        F.when(variant.isin(P.PRIVATE_VARIANTS), told(False, P.RETRY_REASONS["private"]))
        .when(variant.isin(P.SAFE_VARIANTS), told(True, P.RETRY_REASONS["safe"]))
        .when(harmful, told(False, P.RETRY_REASONS["harmful"]))
        .otherwise(told(True, P.RETRY_REASONS["neutral"]))
    )


def recovery(retry: Column, succeeded: Column, attempt: Column, most: Column) -> Column:
    """stop, confirm or retry, from a retry class."""
    return (
        F.when(_on(succeeded, False), "stop")
        .when(~retry["retryable"] & retry["requires_confirmation"], "confirm")
        .when(~retry["retryable"], "stop")
        .when(F.coalesce(attempt, F.lit(0)) >= F.coalesce(most, F.lit(3)), "stop")
        .otherwise("retry")
    )


def outcome(visual: Column, dom: Column) -> Column:
    a, b = _on(visual, False), _on(dom, False)
    return F.struct(
        (a | b).alias("success"), F.when(a & b, 1.0).when(a | b, 0.6).otherwise(0.1).alias("confidence"), F.when(a | b, "state_changed").otherwise("no_observable_change").alias("verdict")
    )


def actionable(exists: Column, visible: Column, enabled: Column, obstructed: Column) -> Column:
    return _on(exists, True) & _on(visible, True) & _on(enabled, True) & ~_on(obstructed, False)


def route(local_first: Column, confidence: Column, allow_remote: Column, endpoint: Column) -> Column:
    return F.when(_on(local_first, False) & (confidence >= 0.7), "local").when(_on(allow_remote, False) & (F.coalesce(endpoint, F.lit("")) != ""), "remote").otherwise("local")


def ocr_fail_closed(ocr: Column, suspicious: Column) -> Column:
    return F.when(_on(suspicious, False) & ~_on(ocr, False), "UNVERIFIED").otherwise("SAFE")


def status_level(blocked: Column, running: Column, model: Column, ocr: Column) -> Column:
    """The first that holds, from blocked to protected."""
    return (
        F.when(F.coalesce(blocked, F.lit("")) != "", "blocked")
        .when(_on(running, False) | (model == "loading"), "processing")
        .when(model == "unavailable", "model_unavailable")
        .when(ocr == F.lit(False), "attention")
        .otherwise("protected")
    )


def status_title(blocked: Column, running: Column, model: Column, ocr: Column) -> Column:
    return (
        F.when(F.coalesce(blocked, F.lit("")) != "", P.STATUS["blocked"])
        .when(_on(running, False), P.STATUS["running"])
        .when(model == "loading", P.STATUS["loading"])
        .when(model == "unavailable", P.STATUS["unavailable"])
        .when(ocr == F.lit(False), P.STATUS["no_ocr"])
        .when(model == "ready", P.STATUS["ready"])
        .otherwise(P.STATUS["other"])
    )


def status_detail(blocked: Column, running: Column, model: Column, ocr: Column, remote_allowed: Column) -> Column:
    """The sentence beside :func:`status_title`; a blocked request's is its reason."""
    return (
        F.when(F.coalesce(blocked, F.lit("")) != "", blocked)
        .when(_on(running, False), P.STATUS_DETAIL["running"])
        .when(model == "loading", P.STATUS_DETAIL["loading"])
        .when(model == "unavailable", P.STATUS_DETAIL["unavailable"])
        .when(ocr == F.lit(False), P.STATUS_DETAIL["no_ocr"])
        .when((model == "ready") & _on(remote_allowed, False), P.STATUS_DETAIL["ready_remote"])
        .when(model == "ready", P.STATUS_DETAIL["ready"])
        .otherwise(P.STATUS_DETAIL["other"])
    )


def pipeline_steps(blocked: Column, running: Column, model: Column, ocr: Column, regions: Column, scan_ok: Column) -> Column:
    """array<struct<id, state>> of the five steps."""
    stop, run, good = F.coalesce(blocked, F.lit("")) != "", _on(running, False), _on(scan_ok, False)
    active = F.when(run, "running").otherwise("completed")
    states = {
        "capture": active,
        "detect": F.when(_on(model.isin("ready", "loading"), False) | _on(ocr, True), active).otherwise("unavailable"),
        "redact": F.when(F.coalesce(regions, F.lit(0)) > 0, "completed").otherwise("pending"),
        "scan": F.when(stop, "blocked").when(good, "completed").otherwise("pending"),
        "send": F.when(stop, "blocked").when(run, "running").when(good, "completed").otherwise("pending"),
    }
    return F.array(*(F.struct(F.lit(k).alias("id"), v.alias("state")) for k, v in states.items()))


#: fixed values: what an action of each variant must have, in the order it is looked at.
REQUIRED = {
    "mouse:click": "x:number y:number", "mouse:double_click": "x:number y:number", "mouse:right_click": "x:number y:number", "mouse:drag": "from:object to:object",
    "mouse:scroll": "x:number y:number deltaX:number deltaY:number", "keyboard:type": "content:string", "keyboard:enter": "", "keyboard:tab": "", "keyboard:backspace": "",
    "keyboard:select_all": "", "browser:tab:switch": "index:number", "browser:tab:new": "", "browser:navigate": "url:string",
    "browser:upload_file": "target:object credentialRole:string", "local:fill_credential": "target:object credentialRole:string",
}


def action_error(action: Column) -> Column:
    """What is wrong with an action given as a variant, or null: fields are looked up by name
    and by type, so a number given as text is an error. A null action is no object."""
    kind = lambda name: F.schema_of_variant(F.try_variant_get(action, f"$.{name}", "variant"))
    is_a = {
        "number": lambda t: t.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"),
        "string": lambda t: t == "STRING",
        "object": lambda t: t.startswith("OBJECT") | t.startswith("ARRAY"),
    }
    article = {"number": "a number", "string": "a string", "object": "an object"}
    variant = F.try_variant_get(action, "$.variant", "string")
    whole = F.coalesce(is_a["object"](F.schema_of_variant(action)), F.lit(False))
    out = F.when(~whole, "Action must be an object").when(~kind("variant").eqNullSafe("STRING") | ~F.coalesce(variant.isin(list(REQUIRED)), F.lit(False)), F.concat(F.lit("Unknown action variant: "), F.coalesce(variant, F.lit("undefined"))))
    for name, fields in REQUIRED.items():
        checks = []
        for f in fields.split():
            field, what = f.split(":")
            checks.append(F.when(~F.coalesce(is_a[what](kind(field)), F.lit(False)), f"Action.{field} must be {article[what]}"))
            if field == "target":
                has = lambda k: F.coalesce(F.try_variant_get(action, f"$.target.{k}", "string"), F.lit("")) != ""
                checks.append(F.when(~has("selectorPath") & F.try_variant_get(action, "$.target.bbox", "variant").isNull(), "Action.target must include a selectorPath or bbox"))
        if checks:
            out = out.when(variant == name, F.coalesce(*checks))
    return out
