import random

from pyspark.sql import functions as F

from quillgate.llm.chat import format_chat, masked_text, read_chat

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["", "\\", "\\\\n", "<|end|>\n", "<|next|>", "<", "<\\|turn|>", "</s>[INST] ok [/INST]", "<<SYS>>a<</SYS>>", "[\\INST]", "a\n<|turn|>b\n", "é😀\x00", "$1\\$", "<<|next|>"]


def roundtrip(spark, rows):
    f = format_chat(spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)).withColumn("t", F.lit(2)))
    out = {r.conv_id: r for r in f.collect()}
    back = {r.conv_id: r for r in read_chat(f).collect()}
    return out, back


def expected(rows):
    by = {}
    for c, t, r, x in sorted(rows, key=lambda v: ((v[1] is not None, v[1] or 0), v[2] or "", v[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    return by


def test_roundtrip_and_mask(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", None, "a\nb\\", "x\\\n"]), r.choice([*HARD, None, "".join(r.choices(HARD, k=4))])) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (99, 1, "assistant", "tie b"), (99, 1, "assistant", "tie a"), (99, 1, "assistant", "tie a"), (100, 0, "user", "long " * 200_000)]
    out, back = roundtrip(spark, rows)
    want = expected(rows)
    assert set(out) == set(back) == set(want)
    for c, turns in want.items():
        assert [(x.role, x.text) for x in back[c].turns] == turns
        at, masked = 0, []
        for run in out[c].loss_runs:
            if run.loss:
                masked.append(out[c].formatted[at : at + run.length])
            at += run.length
        assert at == len(out[c].formatted)
        plain = [x for role, x in turns if role == "assistant"]
        assert back[c].loss_texts == plain and len(masked) == len(plain)
        import re

        assert [re.sub(r"(?s)\\(.)", r"\1", m) for m in masked] == plain
        inner = re.sub(r"<\|(turn|next|end)\|>", "", out[c].formatted)
        assert not re.search(r"<\||</?s>|<</?SYS>>|\[/?INST\]", inner)


def test_neighbours_of_one_role_share_a_block(spark):
    out, _ = roundtrip(spark, [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c")])
    assert out[1].formatted == "<|turn|>user\na<|next|>b<|end|>\n<|turn|>assistant\nc<|end|>\n"


def test_masked_text_is_cut_by_the_mask(spark):
    rows = [(c, t, role, x) for c, role in ((1, "assistant"), (2, "user")) for t, x in enumerate(HARD)]
    f = format_chat(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r.m for r in f.select("conv_id", masked_text(F.col("formatted"), F.col("loss_runs")).alias("m")).collect()}
    assert got == {1: "".join(HARD), 2: ""}
    # a mask that is one off shows
    off = F.transform("loss_runs", lambda r, i: F.struct((r["length"] + F.when(i == 0, 1).otherwise(0)).alias("length"), r["loss"].alias("loss")))
    assert f.where("conv_id = 1").select(masked_text(F.col("formatted"), off).alias("m")).first().m != "".join(HARD)


def test_empty_table(spark):
    assert format_chat(spark.createDataFrame([], SCHEMA)).count() == 0
