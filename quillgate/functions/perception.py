"""What models and pages tell of a screen, as columns: parsers that fail closed, defaults,
boxes, and the settings that hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.functions import patterns as P
from quillgate.functions.text import let

_FENCE = r"(?is)```(?:json)?\s*(.*?)```"
BOX = "struct<x:double,y:double,width:double,height:double>"


def json_body(raw: Column) -> Column:
    """The text of the first code fence, if any, from its first brace to its last."""
    fenced = F.when(raw.rlike(_FENCE), F.regexp_extract(raw, _FENCE, 1)).otherwise(raw)

    def sliced(t: Column) -> Column:
        first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        return F.when((first > 0) & F.contains(t, F.lit("}")), F.substr(t, first, last - first + 1)).otherwise(t)

    return let(F.trim(F.coalesce(fenced, F.lit(""))), sliced)


def _number(v: Column, path: str) -> Column:
    """A JSON number, null for anything else; strings aren't read as numbers."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(v, path, "double"))


def clamp(n: Column, low: float | Column, high: Column) -> Column:
    """Between the bounds; null and NaN are the lower one."""
    low = F.lit(low) if not isinstance(low, Column) else low
    return F.greatest(low, F.least(high, F.coalesce(F.when(~F.isnan(n), n), low)))


def box(v: Column, width: Column, height: Column) -> Column:
    """A struct BOX inside the frame of what a variant says; the whole frame for nothing."""
    x, y, w, h = (clamp(_number(v, f"$.{k}"), 0.0, side) for k, side in (("x", width), ("y", height), ("width", width), ("height", height)))
    told = F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    return F.when(v.isNull() | F.is_variant_null(v), frame(width, height)).otherwise(told)


def frame(width: Column, height: Column) -> Column:
    return F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), width.alias("width"), height.alias("height"))


def _element(kind: Column, label: Column, text: Column, bbox: Column, sensitive: Column, category: Column, confidence: Column) -> Column:
    return F.struct(kind.alias("type"), label.alias("label"), text.alias("text"), bbox.alias("bbox"), sensitive.alias("sensitive"), category.alias("sensitive_type"), confidence.cast("double").alias("confidence"))


def parse_perception(raw: Column, width: Column, height: Column) -> Column:
    """struct<elements, page_description, failed> of a model's answer.

    An element without a type is an 'element', without a confidence has 0.5, and is
    sensitive unless it says false; boxes are clamped to the frame. An answer that can't be
    read, null and empty ones among them, is one sensitive element over the whole frame.
    """
    width, height = width.cast("double"), height.cast("double")
    none = F.lit(None).cast("string")
    string = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    def element(v: Column) -> Column:
        said_no = F.coalesce((F.schema_of_variant(F.try_variant_get(v, "$.sensitive", "variant")) == "BOOLEAN") & ~F.try_variant_get(v, "$.sensitive", "boolean"), F.lit(False))
        return _element(
            F.coalesce(F.nullif(string(v, "$.type"), F.lit("")), F.lit("element")), string(v, "$.label"), string(v, "$.text"), box(F.try_variant_get(v, "$.bbox", "variant"), width, height),
            ~said_no, string(v, "$.sensitiveType"), F.coalesce(_number(v, "$.confidence"), F.lit(0.5)),
        )

    closed = F.array(_element(F.lit("unknown_region"), none, none, frame(width, height), F.lit(True), F.lit("unparsed_perception"), F.lit(0.0)))

    def told(v: Column) -> Column:
        elements = F.try_variant_get(v, "$.elements", "array<variant>")
        good = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.elements", "variant")).startswith("ARRAY"), F.lit(False)) & elements.isNotNull()
        return F.struct(
            F.when(good, F.transform(elements, element)).otherwise(closed).alias("elements"), F.when(good, string(v, "$.pageDescription")).alias("page_description"), (~good).alias("failed")
        )

    return let(F.try_parse_json(json_body(raw)), told)


def parse_plan(raw: Column) -> Column:
    """struct<actions array<variant>, done, error> of a remote answer; ``error`` says why there
    is no plan."""

    def told(v: Column) -> Column:
        actions = F.try_variant_get(v, "$.actions", "array<variant>")
        error = F.when(F.coalesce(raw, F.lit("")) == "", P.PLAN_EMPTY).when(v.isNull(), P.PLAN_UNREAD).when(actions.isNull(), P.PLAN_WITHOUT_ACTIONS)
        return F.struct(F.when(error.isNull(), actions).alias("actions"), F.when(error.isNull(), F.try_variant_get(v, "$.done", "boolean")).alias("done"), error.alias("error"))

    return let(F.try_parse_json(json_body(raw)), told)


def dom_only(fields: Column, title: Column, url: Column) -> Column:
    """struct<elements, page_description> from form fields alone (structs with role, tag,
    label, name, placeholder, bbox); the gate's layer of fields tells what is sensitive."""
    first = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c))
    element = lambda f: _element(
        F.coalesce(first(f["role"], f["tag"]), F.lit("element")), first(f["label"], f["name"], f["placeholder"]), first(f["label"], f["placeholder"]), f["bbox"], F.lit(False), F.lit(None).cast("string"), F.lit(0.8)
    )
    said = F.concat(F.lit("Page: "), F.coalesce(title, F.lit("")), F.lit(" ("), F.coalesce(url, F.lit("")), F.lit(")"))
    return F.struct(F.transform(F.coalesce(fields, F.array()), element).alias("elements"), said.alias("page_description"))


def visible(display: Column, visibility: Column, opacity: Column, width: Column, height: Column) -> Column:
    """Whether a box of a style is seen; a style that isn't told hides nothing, a size that
    isn't told is none."""
    hidden = F.coalesce((display == "none") | (visibility == "hidden"), display == "none", visibility == "hidden", F.lit(False))
    return ~hidden & F.coalesce(opacity != 0, F.lit(True)) & F.coalesce((width > 0) & (height > 0), F.lit(False))


def host_of(url: Column) -> Column:
    """Host and port of a URL in lower case, without the port its scheme implies; empty for
    what is no URL and for null."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), P.URL_HOST, 2))
    port = F.when(url.rlike("(?i)^https:"), ":443$").when(url.rlike("(?i)^http:"), ":80$").otherwise("$")
    return F.regexp_replace(host, port, F.lit(""))


def settings_of(stored: Column) -> Column:
    """map<string, string> of the settings: what is stored goes before the defaults."""
    defaults = F.create_map(*(F.lit(x) for pair in P.DEFAULT_SETTINGS.items() for x in pair))
    own = F.coalesce(stored, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k)), own)
