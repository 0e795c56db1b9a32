"""Leak scan of one string: its forms, the rules in order, one finding per category and match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.functions import patterns as P
from quillgate.functions.regex import java
from quillgate.functions.text import empty, findings, let

LEAK = "struct<category:string,match:string,confidence:double>"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_NARROW = "".join(chr(0x21 + i) for i in range(94))


def luhn(number: Column) -> Column:
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def forms(text: Column) -> Column:
    """The text, and where they differ its percent-decoded and its half-width form."""
    decoded = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    return F.array_distinct(F.array(text, decoded, F.translate(text, _WIDE, _NARROW)))


def _leak(category: str | Column, match: Column, confidence: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(category).alias("category"), match.alias("match"), lit(confidence).alias("confidence"))


def matches(text: Column, category: str, pattern: str) -> Column:
    """array<string> of all matches of a pattern."""
    return F.when(text.rlike(P.NEEDS[category]), F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))).otherwise(empty("string"))


def first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, java(pattern), 0), F.lit(""))


def _each(category: str, found: Column) -> Column:
    return F.transform(found, lambda m: _leak(category, m, 0.95))


def _one(category: str, match: Column, confidence: float) -> Column:
    return F.array_compact(F.array(F.when(match != "", _leak(category, match, confidence))))


def kept_findings(text: Column) -> Column:
    own = F.filter(findings(text), lambda f: f["category"].isin(P.ALWAYS_BLOCK) | (f["confidence"] >= 0.8))
    return F.transform(own, lambda f: _leak(f["category"], f["match"], f["confidence"]))


def scan_form(text: Column, most: int | None) -> Column:
    def rules(t: Column) -> Column:
        files = "(?i)" + "|".join(P.FILE_NAMES)
        name = F.when(text.rlike(files) & text.rlike(r"(?i)\." + java(r"\b[a-z0-9]{2,5}\b")) & ~text.rlike("(?i)https?://"), F.left(F.trim(text), F.lit(120)))
        gate = [_each(c, matches(t, c, p)) for c, p in P.GATE_PATTERNS]
        cards = _each("creditCard", F.filter(matches(t, "creditCard", P.CARD), luhn))
        key = F.coalesce(*(first(t, p) for p in P.API_KEYS))
        return F.flatten(
            F.array(_one("sensitive_filename", name, 0.85), *gate, kept_findings(t), cards, _one("api_key", key, 0.8), _one("access_token", F.regexp_extract(t, java(P.BEARER), 0), 0.9))
        )

    return let(text if most is None else F.left(text, F.lit(most)), rules)


def scan_text(text: Column, most: int | None = None) -> Column:
    """array<LEAK> of a string that is no base64 body. With ``most`` only so many characters
    of each form are scanned."""
    found = F.flatten(F.transform(forms(text), lambda f: scan_form(f, most)))
    once = F.aggregate(found, empty(LEAK), lambda a, x: F.when(F.exists(a, lambda y: (y["category"] == x["category"]) & (y["match"] == x["match"])), a).otherwise(F.concat(a, F.array(x))))
    return F.when(text.isNull() | is_base64(text), empty(LEAK)).otherwise(once)


def is_base64(text: Column) -> Column:
    return F.coalesce(text.rlike(P.BASE64_BODY) | text.rlike(P.DATA_URL), F.lit(False))


def scan_base64(text: Column) -> Column:
    """array<LEAK> in all printable runs of a base64 body, whole; null or broken: none."""
    body = F.regexp_replace(text, P.DATA_URL, "")
    plain = F.decode(F.try_to_binary(F.when(is_base64(text) & (F.length(body) >= 12), body), F.lit("base64")), "ISO-8859-1")
    runs = F.regexp_extract_all(plain, F.lit(rf"[\x20-\x7e]{{{P.LEAST_RUN},}}"), F.lit(0))
    return F.coalesce(F.flatten(F.transform(runs, kept_findings)), empty(LEAK))
