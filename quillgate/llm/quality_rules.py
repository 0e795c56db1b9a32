r"""Quality rules by weak supervision, in DataFrame and SQL expressions only.

Rules over a text's statistics vote good (1) or bad (0), or abstain (null). They overlap, so
every fault is seen by two rules or more, and they are strict, so each fires on clean texts
as well. How often it does isn't given: expectation-maximisation over the counts of all vote
patterns (3 to the number of rules at most, whatever the corpus) estimates each rule's share
of bad votes on good texts and on every kind of bad text, and the shares of the kinds. A
text's posterior probability of being good replaces the demand that all rules pass: a bad
vote that no other rule seconds, by a rule that often errs, is outvoted.

Words are ``[^\x20\x09-\x0D]+``. Windows of eight words are compared by 64-bit hashes
within a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm._store import materialise

WINDOW, ROUNDS = 8, 60
#: Where EM starts: a rule's bad votes on kinds of text that it looks for and on others; the
#: share of good texts; votes that each start counts as.
LOOKED_FOR, OTHERWISE, GOOD, PRIOR = 0.8, 0.05, 0.8, 1.0
#: Kinds of good and of bad text by the rules that look for each.
CLEAN = {"plain": (), "repeated lines": ("dup_lines", "repeats")}
KINDS = {"marked words": ("symbols", "letters"), "lists": ("symbols", "bare"), "shouting": ("case", "marks"), "repetition": ("repeats", "distinct")}
_SPACE = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"
_BARE = r"(?:^|[\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|$)"
_SYMBOLS = "#*$%&|<>"


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each row's whole text: n_words, word_chars, n_symbols, n_lines (with a
    word), n_dup_lines, n_repeat_words, n_distinct_words, n_upper, n_letters, n_marks (of
    exclamation or question), n_bare (words without letter or digit). Null is an empty text;
    null ids and repeated rows stay, an empty table gives no rows; other columns are not
    looked at."""
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    trimmed = F.btrim("_t", F.lit(_SPACE))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0)
    size = lambda c: F.size(c).cast("long")
    less = lambda c: (F.length("_t") - F.length(c)).cast("long")
    d = d.select(
        "_id",
        F.when(F.length(trimmed) > 0, F.split(trimmed, _GAP)).otherwise(F.array().cast("array<string>")).alias("w"),
        lines.alias("l"),
        F.length(F.translate("_t", _SPACE, "")).cast("long").alias("word_chars"),
        less(F.translate("_t", _SYMBOLS, "")).alias("n_symbols"),
        less(F.regexp_replace("_t", r"\p{Lu}+", "")).alias("n_upper"),
        less(F.regexp_replace("_t", r"\p{L}+", "")).alias("n_letters"),
        less(F.translate("_t", "!?", "")).alias("n_marks"),
        F.regexp_count("_t", F.lit(_BARE)).cast("long").alias("n_bare"),
    )
    windows = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    d = d.select(
        "_id", "word_chars", "n_symbols", "n_upper", "n_letters", "n_marks", "n_bare", size("w").alias("n_words"), size(F.array_distinct("w")).alias("n_distinct_words"),
        size("l").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), windows.alias("h"),
    )
    # only texts that repeat a window have theirs sorted
    order = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.withColumn("s", F.coalesce(order, F.array().cast("array<struct<h:bigint,i:int>>"))).drop("h")
    at = lambda i: F.get("s", i)["h"]
    twice = F.filter("s", lambda x, i: F.coalesce(x["h"] == at(i - 1), F.lit(False)) | F.coalesce(x["h"] == at(i + 1), F.lit(False)))
    d = d.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    return d.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"), "n_distinct_words", "n_upper", "n_letters", "n_marks", "n_bare")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1)


def default_rules() -> dict[str, Column]:
    """Each votes 0, 1 or null by the statistics of one text; null where these don't say."""
    c = F.col
    share = lambda a, b: F.try_divide(c(a).cast("double"), c(b))
    high = lambda x, bad, good: _vote(x > bad, x <= good)
    low = lambda x, bad, good: _vote(x < bad, x > good)
    mean = share("word_chars", "n_words")
    return {
        "symbols": high(share("n_symbols", "n_words"), 0.1, 0.05),
        "letters": low(share("n_letters", "word_chars"), 0.9, 0.95),
        "bare": high(share("n_bare", "n_words"), 0.05, 0.02),
        "marks": high(share("n_marks", "n_words"), 0.1, 0.05),
        "case": high(share("n_upper", "word_chars"), 0.2, 0.1),
        "repeats": high(share("n_repeat_words", "n_words"), 0.1, 0.02),
        "dup_lines": _vote(share("n_dup_lines", "n_lines") > 0.1, (c("n_lines") > 1) & (share("n_dup_lines", "n_lines") <= 0.02)),
        "word_length": _vote((mean < 4) | (mean > 6.5), mean.between(4.5, 6)),
        "length": low(c("n_words"), 50, 99),
        "distinct": low(share("n_distinct_words", "n_words"), 0.4, 0.5),
    }


def start_rates(rules: list[str], kinds: dict[str, tuple[str, ...]]) -> list[list[float]]:
    """Bad votes of each rule on each kind of text, where EM starts."""
    return [[LOOKED_FOR if r in own else OTHERWISE for r in rules] for own in kinds.values()]


def posteriors(voted: DataFrame, votes: str, rules: list[str], clean: dict[str, tuple[str, ...]] | None = None, kinds: dict[str, tuple[str, ...]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(votes, posterior) of every pattern in the array column ``votes``, by EM.

    All counts come from all rows; the patterns then fit one row, in which EM runs as a
    fold. The classes are the kinds of good texts, ``clean``, and of bad ones, ``kinds``
    (without any, one that no rule and one that every rule looks for); rules are taken as independent within a class, and an abstention
    tells nothing. Nothing is held in bounds: the rates that EM starts from only count as
    PRIOR votes more, so none gets to 0 or 1. No rows give no patterns.
    """
    clean, kinds = clean or {"good": ()}, kinds or {"bad": tuple(rules)}
    b0 = start_rates(rules, clean) + start_rates(rules, kinds)
    n_good, n_class, n_rule = len(clean), len(b0), len(rules)
    counts = voted.groupBy(votes).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = counts.agg(F.sort_array(F.collect_list(F.struct(F.col("n"), F.col(votes).alias("v")))).alias("p"))
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    prior = F.array(*(F.array(*map(F.lit, row)) for row in b0))

    def total(q: Column, f: Callable[[Column], Column]) -> Column:
        return F.aggregate(q, F.lit(0.0), lambda s, x: s + f(x))

    def bind(value: Column, f: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), f)[0]

    def classes(x: Column, m: Column) -> Column:
        """Posterior of each class for pattern x under the model m."""
        logs = F.transform(
            number(n_class),
            lambda c: F.aggregate(number(n_rule), F.ln(m["pi"][c]), lambda s, j: s + F.when(x["v"][j] == 0, F.ln(m["b"][c][j])).when(x["v"][j] == 1, F.ln(1 - m["b"][c][j])).otherwise(0.0)),
        )
        over = bind(logs, lambda y: F.transform(y, lambda z: F.exp(z - F.array_max(y))))
        return bind(over, lambda y: F.transform(y, lambda z: z / total(y, lambda w: w)))

    def fitted(q: Column) -> Column:
        n = total(q, lambda x: x["n"])
        weight = lambda x, c: x["n"] * x["g"][c]
        voted_as = lambda c, j, on: total(q, lambda x: F.when(on(x["v"][j]), weight(x, c)).otherwise(0.0))
        rate = lambda c, j: (voted_as(c, j, lambda v: v == 0) + PRIOR * prior[c][j]) / (voted_as(c, j, lambda v: v.isNotNull()) + PRIOR)
        return F.struct(
            F.transform(number(n_class), lambda c: (total(q, lambda x: weight(x, c)) + 1) / (n + n_class)).alias("pi"),
            F.transform(number(n_class), lambda c: F.transform(number(n_rule), lambda j: rate(c, j))).alias("b"),
        )

    def step(m: Column, _: Column) -> Column:
        return bind(F.transform("p", lambda x: F.struct(x["n"].alias("n"), x["v"].alias("v"), classes(x, m).alias("g"))), fitted)

    start = F.struct(F.array(*[F.lit(GOOD / n_good)] * n_good, *[F.lit((1 - GOOD) / len(kinds))] * len(kinds)).alias("pi"), prior.alias("b"))
    model = one.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m"))
    told = F.transform("p", lambda x: F.struct(x["v"].alias("v"), total(F.slice(classes(x, F.col("m")), 1, n_good), lambda g: g).alias("g")))
    return model.select(F.explode(told).alias("x")).select(F.col("x.v").alias(votes), F.col("x.g").alias("posterior"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Column] | None = None, clean: dict[str, tuple[str, ...]] | None = None, kinds: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, statistics, base_failed, kept, posterior, n_bad_votes.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated windows.
    ``kept``: not base_failed, and a posterior of ``threshold`` at least. Null and empty
    texts have no words and fail; null ids and repeated rows stay rows of their own, and an
    empty table gives no rows. Other columns are not looked at.
    """
    if rules is None:
        rules, clean, kinds = default_rules(), clean or CLEAN, kinds or KINDS
    voted = text_stats(docs, id_col, text_col).withColumn("votes", F.array(*(r.cast("int") for r in rules.values())))
    voted = materialise(voted.withColumn("pattern", F.concat_ws("", F.transform("votes", lambda v: F.coalesce(v.cast("string"), F.lit("-"))))), "quality-votes")
    known = posteriors(voted, "votes", list(rules), clean, kinds).select(F.concat_ws("", F.transform("votes", lambda v: F.coalesce(v.cast("string"), F.lit("-")))).alias("pattern"), "posterior")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # the patterns are 3 ** len(rules) rows at most
    return (
        voted.join(F.broadcast(known), "pattern")
        .withColumn("base_failed", failed)
        .select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior", F.size(F.filter("votes", lambda v: v == 0)).alias("n_bad_votes"))
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
