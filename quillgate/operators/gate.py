"""The privacy gate: what perception and forms tell of a page, split into blocked and allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate.functions import patterns as P
from quillgate.functions.documents import classify
from quillgate.functions.fields import classify_field
from quillgate.functions.text import findings, safe_descriptive

UNCERTAIN, SHOWN = 0.6, 25


def element_verdicts(elements: DataFrame) -> DataFrame:
    """Adds sensitive, category, source, score to rows (page_id, ord, type, label, text,
    flagged, kind, confidence)."""
    e = elements.withColumn("f", findings(F.when(F.col("text") != "", F.col("text"))))
    unsure = F.coalesce(F.col("confidence") < UNCERTAIN, F.lit(False)) & F.col("flagged").isNull()
    seen = F.coalesce("flagged", F.lit(False)) | unsure
    best = F.greatest(F.coalesce("confidence", F.lit(0.0)), F.coalesce(F.array_max(F.transform("f", lambda x: x["confidence"])), F.lit(0.0)), F.lit(0.5))
    return e.select(
        "page_id", "ord", "label", "type", "text", (seen | (F.size("f") > 0)).alias("sensitive"),
        F.coalesce(F.when(F.col("kind") != "", F.col("kind")), F.get("f", F.lit(0))["category"], F.lit("unknown")).alias("category"),
        F.when(seen, "vlm").otherwise("regex").alias("source"), best.alias("score"),
    )


def field_verdicts(fields: DataFrame) -> DataFrame:
    c = classify_field(*(F.col(x) for x in ("input_type", "autocomplete", "name", "id", "label", "placeholder")))
    f = fields.withColumn("c", c)
    return f.select(
        "page_id", "ord", F.coalesce(F.when(F.col("label") != "", F.col("label")), "name").alias("label"), F.lit("dom_field").alias("type"), F.lit(None).cast("string").alias("text"),
        "c.sensitive", F.coalesce("c.category", F.lit("unknown")).alias("category"), F.lit("dom").alias("source"), F.lit(0.9).alias("score"),
    )


def regions(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("sensitive").select("page_id", "ord", "category", "source", "score")


def document_findings(media: DataFrame) -> DataFrame:
    """(page_id, ord, region, blocked, document) of the media that show a document, from one
    classification: the region (bbox, category, source, score, decision) to be redacted or
    confirmed as a whole, what is told as blocked (label, category), and what was found (tag,
    category, confidence, methods).

    ``media``: (page_id, ord, visible, bbox, ocr_text, file_name, alt, title, mime, tag). Media
    without a box or not seen are passed over, so is what shows none; ids may be null.
    """
    seen = media.where("visible and bbox is not null")
    alt = F.coalesce(F.nullif("alt", F.lit("")), F.col("title"))
    c = classify(F.col("ocr_text"), F.col("file_name"), alt, F.col("mime"), F.col("bbox.width"), F.col("bbox.height"), F.lit(False))
    found = seen.withColumn("c", c).where("c.decision <> 'safe'")
    category = F.coalesce("c.category", F.lit("identity_document"))
    label = F.coalesce(F.nullif("alt", F.lit("")), F.nullif("title", F.lit("")), "tag")
    return found.select(
        "page_id", "ord",
        F.struct("bbox", category.alias("category"), F.lit("document_detector").alias("source"), F.col("c.confidence").alias("score"), F.col("c.decision").alias("decision")).alias("region"),
        F.struct(label.alias("label"), category.alias("category")).alias("blocked"),
        F.struct("tag", F.col("c.category").alias("category"), F.col("c.confidence").alias("confidence"), F.col("c.methods").alias("methods")).alias("document"),
    )


def document_regions(media: DataFrame) -> DataFrame:
    """The regions of :func:`document_findings`, flat; ``media`` without a tag."""
    found = document_findings(media.withColumn("tag", F.lit(None).cast("string")))
    return found.select("page_id", "ord", *(f"region.{x}" for x in ("category", "source", "score", "decision", "bbox")))


def visual_regions(found: DataFrame, settings: Column) -> DataFrame:
    """Rows (page_id, category, score, bbox) of pixel detectors that the settings, a
    map<string, string> column of :func:`settings_of`, leave on, with source and mode: faces
    are blurred, all else is redacted. Other categories are off."""
    name = F.create_map(*(F.lit(x) for pair in P.VISUAL_SETTINGS.items() for x in pair))
    on = F.lower(F.coalesce(F.try_element_at(settings, F.try_element_at(name, F.col("category"))), F.lit("true"))) != "false"
    kept = found.where(F.col("category").isin(list(P.VISUAL_SETTINGS)) & on)
    return kept.withColumns({"source": F.lit("visual_cv"), "mode": F.when(F.col("category") == "face", "blur").otherwise("redact")})


def region_totals(all_regions: DataFrame) -> DataFrame:
    """(page_id, regions, documents, visual, categories, uncertain) of the union of all
    layers' regions (page_id, category, source, decision): uncertain where any document is to
    be confirmed. Null ids are one page; an empty table gives no rows."""
    return all_regions.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("regions"),
        F.count_if(F.col("source") == "document_detector").alias("documents"),
        F.count_if(F.col("source") == "visual_cv").alias("visual"),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.coalesce(F.bool_or(F.col("decision") == "confirm"), F.lit(False)).alias("uncertain"),
    )


def context(verdicts: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, context): four sentences at most about a page (page_id, description,
    instruction), naming kinds of sensitive fields and up to 25 others, never values."""
    first = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    kinds = verdicts.where("sensitive").groupBy("page_id", "category").agg(F.min("ord").alias("o"))
    kinds = kinds.groupBy("page_id").agg(first(F.struct(F.col("o"), F.col("category").alias("v"))).alias("kinds"))
    told = verdicts.where("not sensitive and coalesce(nullif(text, ''), nullif(label, '')) is not null")
    told = told.withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("ord"))).where(F.col("n") <= SHOWN)
    told = told.withColumn("v", safe_descriptive(F.coalesce(F.when(F.col("label") != "", F.col("label")), safe_descriptive(F.col("text")))))
    told = told.groupBy("page_id").agg(first(F.struct("n", "v")).alias("others"))
    line = lambda a, before, after=".": F.when(F.size(a) > 0, F.concat(F.lit(before), F.array_join(a, ", "), F.lit(after)))
    p = pages.join(kinds, "page_id", "left").join(told, "page_id", "left")
    task = F.when(F.col("instruction") != "", F.concat(F.lit("User task: "), "instruction"))
    text: Column = F.concat_ws(
        " ",
        safe_descriptive(F.col("description")),
        line(F.col("kinds"), "This page contains the following sensitive field types (values withheld): "),
        line(F.filter("others", lambda x: x.isNotNull()), "Other visible non-sensitive elements: "),
        task,
    )
    return p.select("page_id", text.alias("context"))
