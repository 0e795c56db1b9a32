"""Form fields: classification by structure and sanitizing of field structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.functions import patterns as P
from quillgate.functions.text import sanitize_text

def _spellings(names: list[str]) -> set[str]:
    """Names as they are, and in small letters with underscores."""
    return {x for n in names for x in (n, "".join(f"_{c.lower()}" if c.isupper() else c for c in n))}


STRIPPED, TEXTS, LOCAL_ONLY = (_spellings(x) for x in (P.STRIPPED_FIELDS, P.TEXT_FIELDS, P.LOCAL_FIELDS))


def classify_field(input_type: Column, autocomplete: Column, name: Column, id: Column, label: Column, placeholder: Column) -> Column:
    """struct<sensitive, category, reasons>; the first rule that holds names the category."""
    words = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (name, id, label, placeholder))))
    hints = F.filter(F.array(*map(F.lit, P.NAME_HINTS)), lambda h: F.contains(words, h))
    kind = F.when(input_type.isin(P.INPUT_TYPES), input_type)
    auto = F.when(autocomplete.isin(P.AUTOCOMPLETE), autocomplete)
    file = F.when(input_type == "file", F.lit("file_upload"))
    reasons = F.concat(
        F.array_compact(F.array(F.concat(F.lit("input[type="), kind, F.lit("]")), F.concat(F.lit("autocomplete="), auto))),
        F.transform(hints, lambda h: F.concat(F.lit('field hint "'), h, F.lit('"'))),
        F.array_compact(F.array(F.when(file.isNotNull(), F.lit("file input (content unknown, treated conservatively)")))),
    )
    category = F.coalesce(kind, auto, F.get(hints, F.lit(0)), file)
    return F.struct(category.isNotNull().alias("sensitive"), category.alias("category"), reasons.alias("reasons"))


def sanitize_dom_field(field: Column, names: list[str]) -> Column:
    """The struct with its values marked and its texts sanitized; nulls stay."""
    own = lambda n: F.when(field[n].isNotNull(), "[REDACTED]") if n in STRIPPED else sanitize_text(field[n]) if n in TEXTS else field[n]
    return F.struct(*(own(n).alias(n) for n in names))


def strip_local_only(field: Column, names: list[str]) -> Column:
    """The struct without what must not leave the machine."""
    return F.struct(*(field[n].alias(n) for n in names if n not in LOCAL_ONLY))


def sanitize_field(field: Column, names: list[str]) -> Column:
    """Both: what may be sent of a field."""
    kept = [n for n in names if n not in LOCAL_ONLY]
    return sanitize_dom_field(field, kept)


def sanitize_snapshot(fields: Column, media: Column, url: Column, title: Column, field_names: list[str], media_names: list[str]) -> Column:
    """struct<fields, media_candidates, url, title> that may be sent; null lists are empty."""
    each = lambda a, names: F.transform(F.coalesce(a, F.array()), lambda f: sanitize_field(f, names))
    return F.struct(each(fields, field_names).alias("fields"), each(media, media_names).alias("media_candidates"), sanitize_text(url).alias("url"), sanitize_text(title).alias("title"))
