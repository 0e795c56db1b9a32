"""Document classification: evidence from texts, file names, types and shape, decided by weight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.functions import patterns as P
from quillgate.functions.regex import java
from quillgate.functions.text import empty, let

EVIDENCE = "struct<method:string,category:string,weight:double,detail:string>"


def _evidence(method: str, category: str, weight: float, detail: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), F.lit(category).alias("category"), F.lit(weight).alias("weight"), detail.alias("detail"))


def _told(method: str, category: str) -> Callable[[Column], Column]:
    return lambda word: F.when(word.isNotNull(), _evidence(method, category, 0.85, word))


def text_evidence(text: Column, method: str | None = None) -> Column:
    """In order: the two number patterns, then of each keyword group the first word found."""
    out = []
    for name, category, weight, pattern in (("pan_pattern", "pan", 0.95, P.DOC_PAN), ("ifsc_pattern", "bank", 0.9, P.DOC_IFSC)):
        hit = F.regexp_extract(text, "(?i)" + java(pattern), 0)
        out.append(F.when(hit != "", _evidence(method or name, category, weight, hit)))

    def groups(low: Column) -> Column:
        found = []
        for category, words in P.DOCUMENT_KEYWORDS.items():
            first = F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words))
            # looked for once, though the condition and the value name it
            found.append(let(first, _told(method or "sensitive_keyword", category)))
        return F.array_compact(F.array(*found))

    return F.coalesce(F.concat(F.array_compact(F.array(*out)), let(F.lower(text), groups)), empty(EVIDENCE))


def file_evidence(name: Column) -> Column:
    hits = [F.when(name.rlike("(?i)" + p), _evidence("file_name", c, w, name)) for p, c, w in P.FILE_HINTS]
    return F.array_compact(F.array(*hits))


def mime_evidence(mime: Column) -> Column:
    return F.array_compact(F.array(F.when(F.lower(mime).isin(P.MIME_TYPES), _evidence("mime_type", "document", 0.8, mime))))


def shape_evidence(width: Column, height: Column) -> Column:
    ratio = F.try_divide(width.cast("double"), height)
    return F.array_compact(F.array(F.when((width != 0) & ratio.between(1.35, 1.85), _evidence("aspect_ratio", "generic_identity", 0.4, F.format_number(ratio, 3)))))


def redaction_label(category: Column) -> Column:
    label = F.lit(P.OTHER_LABEL)
    for group, text in reversed(P.LABELS):
        label = F.when(category.isin(group), text).otherwise(label)
    return label


def classify(ocr: Column, file_name: Column, alt: Column, mime: Column, width: Column, height: Column, force: Column) -> Column:
    """struct<decision, category, confidence, methods, redact, label, n_evidence>. A forced
    region with no evidence has a confidence of -0.05."""
    null = lambda c: F.when(c != "", c)
    evidence = F.concat(text_evidence(null(ocr)), text_evidence(null(alt), "alt_text"), file_evidence(null(file_name)), mime_evidence(null(mime)), shape_evidence(width, height))
    force = F.coalesce(force, F.lit(False))

    def decided(e: Column) -> Column:
        none = (F.size(e) == 0) & ~force
        weight = F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(e, lambda x: x["weight"])), F.lit(0.0)))
        confidence = F.when(none, 0.0).otherwise(F.least(F.lit(1.0), weight + F.lit(0.05) * (F.size(e) - 1)))
        names = F.transform(e, lambda x: x["category"])
        own = F.filter(names, lambda c: ~c.isin("generic_identity", "document"))
        category = F.when(~none, F.coalesce(F.get(own, F.lit(0)), F.get(names, F.lit(0)), F.lit("generic_identity")))
        strong = F.exists(e, lambda x: x["weight"] >= 0.7) | force
        decision = F.when(none, "safe").when(strong | (confidence >= 0.7), "redact").when(confidence >= 0.35, "confirm").otherwise("safe")
        return F.struct(
            decision.alias("decision"),
            category.alias("category"),
            confidence.alias("confidence"),
            F.array_distinct(F.transform(e, lambda x: x["method"])).alias("methods"),
            F.when(decision == "safe", "field").otherwise("whole_region").alias("redact"),
            F.when(decision != "safe", redaction_label(category)).alias("label"),
            F.size(e).alias("n_evidence"),
        )

    return let(evidence, decided)
