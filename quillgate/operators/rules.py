"""Rules as a table: words, any of which a text must hold, and what they stand for.

The words of all rules are one automaton, which finds those of a text in one pass over it,
however many rules there are; a rule is looked at only where one of its words is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules and characters of words that are sent to the executors.
MOST_RULES, MOST_CHARS = 100_000, 20_000_000


def rule_hits(texts: DataFrame, rules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rule, word, at): for each text and rule the first of the rule's words, in the
    rule's order, that the text holds in lower case, and the place of its first letter there.

    ``rules``: (rule, words array<string>). Empty and null words, and null rules, are passed
    over; words of rules that share a name are one list by their places, equal places by code point. Null texts hold none;
    null ids and repeated rows stay; an empty table on either side gives no rows. More rules
    or characters than :data:`MOST_RULES` and :data:`MOST_CHARS` are refused.
    """
    import ahocorasick

    r = rules.where("rule is not null and words is not null")
    n, size = r.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.coalesce(F.length(w), F.lit(0)))), F.lit(0))).first()
    if n > MOST_RULES or size > MOST_CHARS:
        raise ValueError(f"{n} rules with {size} characters are too many to send")
    owners: dict[str, dict[str, int]] = {}  # of a word: its place in each rule's list
    for row in r.select(F.col("rule").cast("string").alias("rule"), "words").collect():  # bounded, as checked
        for place, w in enumerate(row.words):
            if w:
                owners.setdefault(w.lower(), {}).setdefault(row.rule, place)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ahocorasick.Automaton()
        for w in owners:
            index.add_word(w, w)
        if owners:
            index.make_automaton()
        for b in it:
            at, rule, word, place = [], [], [], []
            for i, text in enumerate(b.column("_t").to_pylist()) if owners else ():
                first: dict[str, int] = {}
                for end, w in index.iter((text or "").lower()):
                    first.setdefault(w, end - len(w) + 1)
                best: dict[str, tuple[int, str]] = {}
                for w in first:
                    for name, k in owners[w].items():
                        if name not in best or (k, w) < best[name]:
                            best[name] = (k, w)
                for name, (_, w) in sorted(best.items()):
                    at.append(i)
                    rule.append(name)
                    word.append(w)
                    place.append(first[w])
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(at, pa.int64())), pa.array(rule, pa.string()), pa.array(word, pa.string()), pa.array(place, pa.int32())], names=[id_col, "rule", "word", "at"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, rule string, word string, at int")
