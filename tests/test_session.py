import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgate.functions import patterns as P
from quillgate.functions.decisions import retry_class, status_detail
from quillgate.functions.perception import host_of, settings_of, visible
from quillgate.operators import gate, pixels, session
from quillgate.sources.html import page_elements
from quillgate.streaming import changes


@pytest.mark.parametrize(
    "text,want",
    [
        (None, None), ("", '"[REDACTED]"'), ("no json", '"[REDACTED]"'), ("3", "3"), ('{"Text":"a","text":{"b":1},"c":[{"file":null},[{"password":2,"x":"é"}]]}', '{"Text":"a","text":"[REDACTED]","c":[{"file":"[REDACTED]"},[{"password":"[REDACTED]","x":"é"}]]}'),
        ("[" * 200_000, '"[REDACTED]"'),
    ],
)
def test_logs_hold_no_values(text, want):
    assert session.marked_json(text) == want


def test_log_column(spark):
    rows = [('{"content":"' + "x" * 300_000 + '","n":1}', 1), (None, 2), ('{"k":"\\ud800"}', 3)]
    got = dict(spark.createDataFrame(rows, "e string, i int").select("i", session.redact_log(F.col("e"))).collect())
    assert json.loads(got[1]) == {"content": "[REDACTED]", "n": 1} and got[2] is None and got[3] == '{"k":"?"}'
    assert spark.createDataFrame([], "e string").select(session.redact_log(F.col("e"))).count() == 0


def test_attempts_end_with_the_first_that_is_not_tried_again(spark):
    rows = [("a", 1, False, False, "x"), ("a", 2, None, None, "x"), ("a", 3, False, False, "x"), ("a", 4, True, False, "x"), ("b", 1, False, False, "local:fill_credential"), ("b", 2, True, False, "x"),
            ("c", 1, True, True, "x"), (None, 1, False, False, "x"), (None, 2, False, True, "x")]
    t = spark.createDataFrame(rows, "id string, attempt int, ok boolean, succeeded boolean, v string").repartition(3)
    none = F.lit(None).cast("string")
    t = t.withColumn("retry", retry_class(F.col("v"), none, none, none))
    got = session.attempts(t, "id").select("id", "attempt", "next", "wait_ms").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 1, "retry", 1000), ("a", 2, "retry", 2000), ("a", 3, "stop", None), ("b", 1, "confirm", None), ("c", 1, "done", None), (None, 1, "retry", 1000), (None, 2, "stop", None)], key=str)
    assert session.attempts(t.limit(0), "id").count() == 0


def test_report(spark):
    items = spark.createDataFrame([("b", "2"), ("a", None), (None, "x"), ("b", "1")], "k string, v string")
    assert json.loads(session.diagnostics(items).first().report) == {"safe": True, "diagnostics": {"a": "", "b": "2"}}
    assert json.loads(session.diagnostics(items.limit(0)).first().report) == {"safe": True, "diagnostics": {}}


def test_visible_and_hosts(spark):
    rows = [(None, None, None, 1.0, 1.0, True), ("none", None, 1.0, 1.0, 1.0, False), ("block", "hidden", 1.0, 1.0, 1.0, False), ("block", "visible", 0.0, 1.0, 1.0, False), ("block", "visible", 0.5, 0.0, 1.0, False), (None, None, None, None, None, False), (None, "hidden", None, 1.0, 1.0, False)]
    v = spark.createDataFrame(rows, "d string, v string, o double, w double, h double, want boolean")
    assert all(a == b for a, b in v.select(visible(*(F.col(c) for c in "dvowh")), "want").collect())
    urls = {"https://Api.X.org:443/v1": "api.x.org", "http://u:p@h:80": "h", "http://h:443/a@b": "h:443", "https://h:8443?q": "h:8443", "nothing": "", "": ""}
    u = spark.createDataFrame([*urls.items(), (None, "")], "u string, want string")
    assert all(a == b for a, b in u.select(host_of(F.col("u")), "want").collect())


def test_layers_of_nothing(spark):
    box = "bbox struct<x:double,y:double,width:double,height:double>"
    media = spark.createDataFrame([], f"page_id int, ord int, visible boolean, {box}, ocr_text string, file_name string, alt string, title string, mime string")
    seen = spark.createDataFrame([(None, "face", 0.6, None), (1, "barcode", 0.5, None)], f"page_id int, category string, score double, {box}")
    own = gate.visual_regions(seen, settings_of(F.create_map(F.lit("ENABLE_QR_BARCODE"), F.lit("false"))))
    assert [(r.page_id, r.mode) for r in own.collect()] == [(None, "blur")]
    totals = gate.region_totals(gate.document_regions(media).unionByName(own, True)).collect()
    assert [(r.page_id, r.regions, r.visual, r.uncertain) for r in totals] == [(None, 1, 1, False)]
    assert gate.region_totals(gate.document_regions(media)).count() == 0


def test_blur_spreads_what_it_covers():
    image = np.zeros((80, 90, 4), np.uint8)
    image[..., 3] = 255
    image[:, 45:, :3] = 255
    out = np.frombuffer(pixels.redact(image.tobytes(), 90, 80, [(10, 10, 70, 60, "blur"), (-50, -50, 10, 10, None)]), np.uint8).reshape(80, 90, 4)
    row = out[40, 8:82, 0].astype(int)
    assert (np.diff(row) >= 0).all() and len(set(row)) > 40 and np.diff(row).max() < 10
    untouched = np.ones((80, 90), bool)
    untouched[8:72, 8:82] = False
    assert (out[untouched] == image[untouched]).all() and (out[..., 3] == 255).all()


def test_own_columns_stay(spark):
    d = spark.createDataFrame([("a", 1, [0, 1], "mine", 7)], "k string, o int, bits array<int>, _before string, __before int")
    assert changes.changed(d, "k", "o", "bits").first().asDict() == {"k": "a", "o": 1, "bits": [0, 1], "_before": "mine", "__before": 7, "changed": True}
    none = F.lit(None).cast("string")
    t = spark.createDataFrame([("a", 1, True, False, "mine")], "id string, attempt int, ok boolean, succeeded boolean, _ended string").withColumn("retry", retry_class(none, none, none, none))
    assert session.attempts(t, "id").first()["_ended"] == "mine"


def test_empty_tables_of_all_views(spark):
    d = spark.createDataFrame([], "k string, ts timestamp, seq long, event string, props map<string,string>, v int")
    assert changes.activity_view(d, "k").count() == changes.last_known(d, "k", "seq", "v").count() == changes.running_counters(d, "k", "seq", ["v"]).count() == 0
    pages = spark.createDataFrame([], "page_id long, html string, description string, instruction string")
    assert page_elements(pages).count() == 0
    e = pages.selectExpr("page_id", "1 as ord", "html as label", "html as type", "html as text", "true as flagged", "html as kind", "0.5D as confidence")
    assert gate.context(gate.element_verdicts(e), pages).count() == gate.regions(gate.element_verdicts(e)).count() == 0
    assert pixels.image_regions(spark.createDataFrame([], "image_id int, width int, height int, rgba binary")).count() == 0


def test_status_details(spark):
    rows = [("leak", True, "ready", True, True), (None, True, None, None, None), ("", False, "loading", None, None), (None, None, "unavailable", None, None), (None, None, "ready", False, True), (None, None, "ready", None, True), (None, None, "ready", None, None), (None, None, None, None, True)]
    s = spark.createDataFrame(rows, "b string, r boolean, m string, o boolean, a boolean")
    got = [x.t for x in s.select(status_detail(*(F.col(c) for c in "brmoa")).alias("t")).collect()]
    assert got == ["leak", *(P.STATUS_DETAIL[k] for k in ("running", "loading", "unavailable", "no_ocr", "ready_remote", "ready", "other"))]
