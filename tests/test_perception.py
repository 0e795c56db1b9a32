import json

from pyspark.sql import functions as F

from quillgate.functions import patterns as P
from quillgate.functions.decisions import retry_class, status_title
from quillgate.functions.fields import sanitize_dom_field, sanitize_snapshot, strip_local_only
from quillgate.functions.perception import dom_only, parse_perception, settings_of
from quillgate.functions.text import ocr_regions
from quillgate.operators.payloads import payload_gate, payload_leaks, send_gated, walk

BOX = "struct<x:double,y:double,width:double,height:double>"


def test_walk_keeps_the_order_of_the_text(spark):
    text = '{"b":[1,{"z":"x","a":null}],"a":"y"}'
    p = spark.createDataFrame([(1, text), (None, '"s"'), (2, None), (2, "{")], "payload_id long, payload string").selectExpr("*", "1 as id", "2 as ord", "3 as kind")
    got = walk(p, "payload_id", "payload").orderBy("id", "ord").collect()
    assert [(r.path, r.kind, r.s) for r in got if r.id == 1] == [
        ("$", "object", None), ("$.b", "array", None), ("$.b[0]", "other", None), ("$.b[1]", "object", None), ("$.b[1].z", "string", "x"), ("$.b[1].a", "other", None), ("$.a", "string", "y"),
    ]
    assert [(r.path, r.s) for r in got if r.id is None] == [("$", "s")] and [r.s for r in got if r.id == 2] == ["{"]
    assert walk(p.limit(0), "payload_id", "payload").count() == 0


def test_depth_is_bounded_only_where_asked(spark):
    deep = "[" * 30 + '"quiet"' + "]" * 30
    p = spark.createDataFrame([(1, deep), (2, "[" * 200_000)], "payload_id long, payload string")
    assert {r.payload_id: r.safe for r in payload_gate(p, depth=None).collect()} == {1: True, 2: False}
    assert [r.category for r in payload_leaks(p.where("payload_id = 1"), depth=5).collect()] == ["unverified"]


def test_blocked_payloads_go_to_quarantine(spark, tmp_path):
    rows = [(1, "quiet", "x"), (2, "mail a@b.co", "y"), (3, None, "z"), (None, json.dumps({"password": "p"}), "w"), (2, "quiet", "v")]
    p = spark.createDataFrame(rows, "payload_id long, payload string, safe string")
    for _ in range(2):
        send_gated(p, f"{tmp_path}/out", f"{tmp_path}/held")
    out, held = spark.read.parquet(f"{tmp_path}/out"), spark.read.parquet(f"{tmp_path}/held")
    assert sorted((r.payload_id, r.safe) for r in out.collect()) == [(1, "x"), (1, "x"), (3, "z"), (3, "z")]
    assert "payload" not in held.columns and {(r.payload_id, tuple(r.findings)) for r in held.collect()} == {(2, ("email@$",)), (None, ("sensitive_key@$.password",))}


def test_dom_only_and_unread_answers(spark):
    fields = f"array<struct<role:string,tag:string,label:string,name:string,placeholder:string,bbox:{BOX}>>"
    rows = [([("", "input", None, "mail", "your mail", (1.0, 2.0, 3.0, 4.0)), (None, None, "L", None, None, None)], "T", None), (None, None, "u")]
    got = spark.createDataFrame(rows, f"f {fields}, title string, url string").select(dom_only(F.col("f"), F.col("title"), F.col("url")).alias("p")).collect()
    a, b = got[0].p.elements
    assert (a.type, a.label, a.text, a.sensitive, a.confidence, a.bbox.width) == ("input", "mail", "your mail", False, 0.8, 3.0)
    assert (b.type, b.label, b.text, b.bbox) == ("element", "L", "L", None) and got[0].p.page_description == "Page: T ()"
    assert got[1].p.elements == [] and got[1].p.page_description == "Page:  (u)"
    empty = spark.createDataFrame([], "raw string").select(parse_perception(F.col("raw"), F.lit(1), F.lit(1)).alias("p"))
    assert empty.count() == 0


def test_settings(spark):
    got = spark.createDataFrame([({"MAX_STEPS": "3", "OWN": "x"},), (None,)], "s map<string,string>").select(settings_of(F.col("s")).alias("s")).collect()
    assert got[0].s == P.DEFAULT_SETTINGS | {"MAX_STEPS": "3", "OWN": "x"} and got[1].s == P.DEFAULT_SETTINGS


def test_snapshots(spark):
    names = ["label", "value", "innerText", "href", "selectorPath", "ariaLabel", "tag"]
    field = "struct<" + ",".join(f"{n}:string" for n in names) + ">"
    f = ("a@b.co", "secret", None, "/x", "#a", "quiet", "input")
    s = spark.createDataFrame([([f], None, "http://x/?m=a@b.co", "Hello")], f"f array<{field}>, m array<{field}>, url string, title string")
    got = s.select(sanitize_snapshot(F.col("f"), F.col("m"), F.col("url"), F.col("title"), names, names).alias("s"), sanitize_dom_field(F.col("f")[0], names).alias("one"), strip_local_only(F.col("f")[0], names).alias("bare")).first()
    assert got.s.fields[0].asDict() == {"label": "[REDACTED]", "innerText": None, "href": "[REDACTED]", "ariaLabel": "quiet", "tag": "input"}
    assert got.s.media_candidates == [] and got.s.url == "[REDACTED]" and got.s.title == "Hello"
    assert got.one.value == "[REDACTED]" and got.one.selectorPath == "#a" and got.bare.label == "a@b.co" and "value" not in got.bare.asDict()


def test_ocr_page(spark):
    lines = f"array<struct<text:string,confidence:double,bbox:{BOX}>>"
    b = (0.0, 0.0, 5.0, 5.0)
    rows = [([("mail a@b.co", 0.0, b), ("quiet", 0.9, b), ("ABCDE1234F", 0.7, b), ("x@y.org", 0.9, None)],), ([],)]
    got = spark.createDataFrame(rows, f"l {lines}").select(ocr_regions(F.col("l")).alias("r")).collect()
    assert [(r.category, r.confidence) for r in got[0].r] == [("email", 0.8), ("pan", 0.7)] and got[1].r == []


def test_any_part_of_a_target_can_be_harmful(spark):
    a = spark.createDataFrame([("mouse:click", '{"text":"Pay"}'), ("mouse:click", '{"text":"Next"}'), ("mouse:click", None)], "v string, j string")
    none = F.lit(None).cast("string")
    assert [r.c.retryable for r in a.select(retry_class(F.col("v"), none, none, none, F.col("j")).alias("c")).collect()] == [False, True, True]


def test_status_titles(spark):
    rows = [("leak", True, "ready", True), (None, True, None, None), ("", False, "loading", None), (None, None, "unavailable", None), (None, None, "ready", False), (None, None, "ready", None), (None, None, None, None)]
    s = spark.createDataFrame(rows, "b string, r boolean, m string, o boolean")
    assert [r.t for r in s.select(status_title(F.col("b"), F.col("r"), F.col("m"), F.col("o")).alias("t")).collect()] == list(P.STATUS.values())
