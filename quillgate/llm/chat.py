r"""Chat formatting with DataFrame expressions only.

Turns of a conversation are collected as structs, sorted, neighbours of one role merged
into one block, and the blocks concatenated::

    <|turn|>ROLE\nTEXT<|next|>TEXT<|end|>\n

``<|next|>`` stands between merged turns, so none is lost. Roles and texts are escaped:
a backslash is doubled, and one is put behind the first character of every control
string (this template's ``<|`` and those of other common templates), so no control string
is left inside a text and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>\n"
#: Control strings that may not stand in a text unescaped, as a regular expression split
#: behind the first character.
_CONTROL = r"(<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    """Breaks control strings; undone by :func:`unescape`."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    """Roles stand on a line of their own: a backslash is put before a newline in one."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def format_chat(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """(conv, formatted, loss_runs): one row per conversation.

    ``loss_runs`` is the loss mask as run lengths over ``formatted``: structs of ``length``
    in code points and ``loss``, true over each text of a trained role, escapes included,
    markers not. A null role or text is empty; turns with equal numbers are ordered by role
    and text, null numbers first; repeated rows stay. Rows of a null conversation are one
    conversation. No rows, no output; other columns are ignored. A conversation is one row
    of the result, and so has to fit a task's memory several times over (that of a few
    hundred MB of text does); its rows are not split further.
    """
    rows = turns.select(
        F.col(conv_col).alias("_c"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("_t"),
    )
    held = rows.groupBy("_c").agg(F.sort_array(F.collect_list("_t")).alias("t"))
    # where a new block begins; behind the last, the end
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"]))
    held = held.withColumn("s", F.concat(starts, F.array(F.size("t") + 1)))
    blocks = F.transform(
        F.sequence(F.lit(1), F.size("s") - 1),
        lambda k: F.struct(
            F.element_at("t", F.element_at("s", k))["role"].alias("role"),
            F.transform(F.slice("t", F.element_at("s", k), F.element_at("s", k + 1) - F.element_at("s", k)), lambda x: escape(x["text"])).alias("texts"),
        ),
    )
    held = held.select("_c", blocks.alias("b"))
    text = F.array_join(F.transform("b", lambda x: F.concat(F.lit(TURN), _role(x["role"]), F.lit("\n"), F.array_join(x["texts"], NEXT), F.lit(END))), "")

    def runs(x: Column) -> Column:
        loss = x["role"].isin(*trained)
        piece = lambda n, on: F.struct(n.cast("long").alias("length"), on.alias("loss"))
        head = F.array(piece(F.length(_role(x["role"])) + len(TURN) + 1, F.lit(False)))
        body = F.flatten(
            F.transform(x["texts"], lambda t, i: F.concat(F.when(i > 0, F.array(piece(F.lit(len(NEXT)), F.lit(False)))).otherwise(F.array().cast("array<struct<length:bigint,loss:boolean>>")), F.array(piece(F.length(t), loss))))
        )
        return F.concat(head, body, F.array(piece(F.lit(len(END)), F.lit(False))))

    return held.select(F.col("_c").alias(conv_col), text.alias("formatted"), F.flatten(F.transform("b", runs)).alias("loss_runs"))


def read_chat(formatted: DataFrame, conv_col: str = "conv_id", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, turns, loss_texts) out of ``formatted``: the original turns in order and the
    texts of the trained roles, unescaped. Needs nothing but the formatted text; a null or
    empty one has no turns."""
    blocks = F.split("formatted", r"\Q" + END + r"\E")
    blocks = F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.substr(b, F.lit(len(TURN) + 1)))

    def turns(b: Column) -> Column:
        # the first newline that no backslash stands before ends the role
        role = F.regexp_extract(b, r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n", 1)
        texts = F.split(F.substr(b, F.length(role) + 2), r"\Q" + NEXT + r"\E")
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    out = formatted.select(F.col(conv_col), F.flatten(F.transform(blocks, turns)).alias("turns"))
    return out.withColumn("loss_texts", F.transform(F.filter("turns", lambda x: x["role"].isin(*trained)), lambda x: x["text"]))


def masked_text(formatted: Column, runs: Column) -> Column:
    """What stands in ``formatted`` under the loss mask, run by run, unescaped."""
    cut = lambda a, r: unescape(F.substring(formatted, a["at"], r["length"].cast("int")))
    return F.aggregate(
        runs,
        F.struct(F.lit(1).alias("at"), F.lit("").alias("text")),
        lambda a, r: F.struct((a["at"] + r["length"]).cast("int").alias("at"), F.when(r["loss"], F.concat(a["text"], cut(a, r))).otherwise(a["text"]).alias("text")),
        lambda a: a["text"],
    )


_PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{_PROBE}'), (-7L, 1L, 'assistant', '{_PROBE}') AS t(conv_id, turn, role, text)")
    return _with_digests(format_chat(own.unionByName(extra)))


def _with_digests(formatted: DataFrame) -> DataFrame:
    formatted = formatted.withColumn("loss", masked_text(F.col("formatted"), F.col("loss_runs")))
    read = read_chat(formatted.select(F.struct("conv_id", "formatted", "loss", F.size(F.filter("loss_runs", lambda r: r["loss"])).alias("spans")).alias("conv"), "formatted"), "conv")
    return read.select(
        F.col("conv.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("conv.loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("conv.loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("conv.formatted").cast("long").alias("formatted_chars"),
        F.col("conv.spans").cast("long").alias("loss_spans"),
    )


_ESC = r"regexp_replace(replace({0}, '\', '\\'), '(<(\||s>|/s>|<SYS>>|</SYS>>)|\[/?INST\])', 'X\1', 'g')"
OP2_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}'),
e AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS same,
    length({_ESC.format("text")}) AS text_len, length({_ESC.format("role")}) AS role_len
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text), '') AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(text_len + CASE WHEN same THEN {len(NEXT)} ELSE {len(TURN) + 1 + len(END)} + role_len END) AS formatted_chars,
    count(*) FILTER (role = 'assistant') AS loss_spans
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, loss_spans FROM g
"""
