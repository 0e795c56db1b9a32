"""Sensitive spans in a text column, as one array of structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.functions import patterns as P
from quillgate.functions.regex import java

FINDING = "struct<category:string,match:string,start:int,end:int,confidence:double,requires_context:boolean>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def spans(text: Column, pattern: str) -> Column:
    """array<struct<match, start>> of all matches from left to right. A start is the length
    of everything before: the gaps up to it and the matches before it."""
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    # texts are cut into gaps only where there is a match
    cut = lambda m: let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("g")), lambda c: F.transform(c["m"], lambda x, i: F.struct(x.alias("match"), (length(F.slice(c["g"], F.lit(1), i + 1)) + length(F.slice(c["m"], F.lit(1), i))).alias("start"))))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, cut(m)).otherwise(empty("struct<match:string,start:int>")))


def near(text: Column, start: Column, words: list[str]) -> Column:
    """Whether one of the words stands within the span of characters around a start."""
    if not words:
        return F.lit(False)
    low = F.greatest(start - P.CONTEXT_SPAN, F.lit(0))
    window = F.lower(F.substr(text, low + 1, start + P.CONTEXT_SPAN - low))

    def any_of(w: Column) -> Column:
        found = F.contains(w, F.lit(words[0]))
        for word in words[1:]:
            found = found | F.contains(w, F.lit(word))
        return found

    return let(window, any_of)


def _finding(category: str, match: Column, start: Column, confidence: Column, bare: Column) -> Column:
    whole = F.length(match)
    return F.struct(F.lit(category).alias("category"), match.alias("match"), start.cast("int").alias("start"), (start + whole).cast("int").alias("end"), confidence.alias("confidence"), bare.alias("requires_context"))


def _by_pattern(text: Column, category: str, pattern: str, strong: bool) -> Column:
    def one(s: Column) -> Column:
        def judged(found: Column) -> Column:
            other = 0.8 if strong else 0.35
            return _finding(category, s["match"], s["start"], F.when(found, 0.95).otherwise(other), ~found & F.lit(not strong))

        return let(near(text, s["start"], P.CONTEXT_WORDS.get(category, [])), judged)

    found = F.when(text.rlike(P.NEEDS[category]), spans(text, java(pattern))).otherwise(empty("struct<match:string,start:int>"))
    return F.transform(found, one)


def _labeled(text: Column, category: str, pattern: str, confidence: float) -> Column:
    found = spans(text, "(?i)" + java(pattern))
    if category == "address":
        tail = lambda s: F.regexp_extract(s["match"], "(?i)" + java(pattern), 1)
        found = F.filter(found, lambda s: tail(s).rlike("(?i)[0-9]|" + P.ADDRESS_HINTS))
    return F.transform(
        found,
        lambda s: _finding(category, s["match"], s["start"], F.lit(confidence), F.lit(False)).withField("match", F.left(s["match"], F.lit(P.ADDRESS_CLIP)) if category == "address" else s["match"]),
    )


def findings(text: Column) -> Column:
    """array<FINDING> by category in order, then labelled values; empty for null. Every
    pattern needs a digit, @, : or =, so other texts are passed over."""
    parts = [_by_pattern(text, *p) for p in P.TEXT_PATTERNS] + [_labeled(text, *p) for p in P.LABELED_PATTERNS]
    return F.when(text.rlike("[0-9@:=]"), F.flatten(F.array(*parts))).otherwise(empty(FINDING))


def sanitize_text(text: Column) -> Column:
    """The text, or a marker for it where a finding of 0.8 or more is in it; null stays."""
    return F.when(F.exists(findings(text), lambda f: f["confidence"] >= 0.8), "[REDACTED]").otherwise(text)


def safe_descriptive(text: Column) -> Column:
    """What may be told of a text: null for none, a marker for any finding, else 120 characters."""
    clipped = F.when(F.length(text) > 120, F.concat(F.left(text, F.lit(120)), F.lit("…"))).otherwise(text)
    return F.when(text.isNull() | (text == ""), F.lit(None)).when(F.size(findings(text)) > 0, "[REDACTED]").otherwise(clipped)


def ocr_decision(text: Column, confidence: Column) -> Column:
    """struct<sensitive, category, confidence, findings_count> of one recognised line."""
    high = F.filter(findings(text), lambda f: f["category"].isin("pan", "email", "dob", "ifsc") | (f["confidence"] >= 0.8))

    def decided(h: Column) -> Column:
        first = F.get(h, F.lit(0))
        own = F.when(F.coalesce(confidence, F.lit(0.0)) != 0, confidence)
        hit = F.size(h) > 0
        return F.struct(hit.alias("sensitive"), F.when(hit, first["category"]).alias("category"), F.when(hit, F.coalesce(own, first["confidence"])).alias("confidence"), F.size(h).alias("findings_count"))

    return let(high, decided)


def ocr_regions(lines: Column) -> Column:
    """array<struct<category, bbox, confidence>> of a page's recognised lines (structs of text,
    confidence, bbox): those that are sensitive and have a box. Texts aren't passed on."""
    told = F.transform(lines, lambda x: F.struct(ocr_decision(x["text"], x["confidence"]).alias("d"), x["bbox"].alias("bbox")))
    return F.transform(F.filter(told, lambda x: x["d"]["sensitive"] & x["bbox"].isNotNull()), lambda x: F.struct(x["d"]["category"].alias("category"), x["bbox"].alias("bbox"), x["d"]["confidence"].alias("confidence")))
