"""Cases of each detector and decision, on small tables."""

import base64
import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgate.functions import decisions as D
from quillgate.functions.documents import classify
from quillgate.functions.fields import sanitize_field
from quillgate.functions.leaks import scan_base64, scan_text
from quillgate.functions.regex import java, re2
from quillgate.functions.text import findings, ocr_decision, safe_descriptive, sanitize_text
from quillgate.operators import pixels, vault
from quillgate.operators.payloads import payload_gate, payload_leaks
from quillgate.plans import fixtures as X
from quillgate.sources.html import page_elements
from quillgate.streaming import changes


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("Aadhaar Number: 1234 5678 9012",), ("Order id 123456789012 shipped today",), ("ABCDE1234F",), ("IFSC: SBIN0001234",), ("PIN Code: 560001",), ("Account Number: 12345678901234",),
        ("Name: Vishal Agrawal",), ("Address: 12 MG Road, Bengaluru 560001",), ("éABCDE1234F",), ("plain words",), ("",), (None,), ("mobile 9876543210",), ("x " * 50_000 + "a@b.co",),
    ]
    t = spark.createDataFrame(rows, "text string").withColumn("f", findings(F.col("text")))
    return {r.text: {(x.category, x.confidence): x for x in r.f} for r in t.collect()}


@pytest.mark.parametrize(
    "text, category, confidence",
    [
        ("Aadhaar Number: 1234 5678 9012", "aadhaar", 0.95), ("Order id 123456789012 shipped today", "aadhaar", 0.35), ("ABCDE1234F", "pan", 0.8), ("IFSC: SBIN0001234", "ifsc", 0.8),
        ("PIN Code: 560001", "pincode", 0.95), ("Account Number: 12345678901234", "bankAccount", 0.95), ("Name: Vishal Agrawal", "name", 0.9), ("Address: 12 MG Road, Bengaluru 560001", "address", 0.85),
        ("éABCDE1234F", "pan", 0.8), ("mobile 9876543210", "phone", 0.95), ("x " * 50_000 + "a@b.co", "email", 0.8),
    ],
)
def test_text_findings(found, text, category, confidence):
    f = found[text][(category, confidence)]
    assert text[f.start : f.end].startswith(f.match[:20]) and f.requires_context == (confidence == 0.35)


def test_texts_without_findings(found):
    assert not found["plain words"] and not found[""] and not found[None]


def test_sanitizing(spark):
    t = spark.createDataFrame([("a@b.co",), ("otp 12", ), ("room 1234",), (None,), ("w" * 130,), ("",)], "t string")
    out = t.select(sanitize_text(F.col("t")).alias("s"), safe_descriptive(F.col("t")).alias("d")).collect()
    assert [x.s for x in out] == ["[REDACTED]", "otp 12", "room 1234", None, "w" * 130, ""]
    assert [x.d for x in out] == ["[REDACTED]", "otp 12", "[REDACTED]", None, "w" * 120 + "…", None]
    f = spark.createDataFrame([(("q=1", "a@b.co", "#x", "text"),)], "f struct<value:string,label:string,selector_path:string,tag:string>")
    assert f.select(sanitize_field(F.col("f"), ["value", "label", "selector_path", "tag"]).alias("f")).first().f.asDict() == {"label": "[REDACTED]", "tag": "text"}
    o = spark.createDataFrame([("ABCDE1234F", 0.0), ("hello", 0.9), ("a@b.co", 0.7), (None, 0.1)], "t string, c double").select(ocr_decision(F.col("t"), F.col("c")).alias("o")).collect()
    assert [(x.o.sensitive, x.o.category, x.o.confidence) for x in o] == [(True, "pan", 0.8), (False, None, None), (True, "email", 0.7), (False, None, None)]


def test_documents(spark):
    rows = [
        (0, "INCOME TAX DEPARTMENT PAN ABCDE1234F", "pan-card-scan.png", None, None, 1011, 638, False), (1, None, "holiday.jpg", "beach photo", None, 800, 600, False), (2, None, None, None, None, 1011, 638, False),
        (3, "Salary slip — net pay", "payslip.pdf", None, None, None, None, False), (4, None, None, None, None, None, None, True), (5, None, None, None, "Application/PDF", 0, 0, False),
    ]
    t = spark.createDataFrame(rows, "id int, ocr string, file string, alt string, mime string, w int, h int, force boolean")
    out = {r.id: r.c for r in t.select("id", classify(*(F.col(c) for c in ("ocr", "file", "alt", "mime", "w", "h", "force"))).alias("c")).collect()}
    assert [out[i].decision for i in range(6)] == ["redact", "safe", "confirm", "redact", "redact", "redact"]
    assert out[0].category == "pan" and out[0].confidence == 1.0 and len(out[0].methods) >= 3 and out[0].label == "[IDENTITY DOCUMENT REDACTED]"
    assert out[1].category is None and out[1].label is None and out[1].redact == "field"
    assert out[3].label == "[FINANCIAL DOCUMENT REDACTED]"
    assert (out[4].category, out[4].confidence) == ("generic_identity", -0.05)
    assert (out[5].category, out[5].label) == ("document", "[DOCUMENT REDACTED]")


def test_payloads(spark):
    p = spark.createDataFrame([(i, t) for i, t, _ in X.PAYLOADS], "payload_id int, payload string")
    leaks = payload_leaks(p, depth=12).collect()
    assert {i: e for i, _, e in X.PAYLOADS} == {r.payload_id: r.safe for r in payload_gate(p, depth=12).collect()}
    paths = {(r.payload_id, r.path, r.category) for r in leaks}
    assert {(3, "$.a[0].b", "email"), (4, "$.form.password", "sensitive_key"), (7, "$.d (base64)", "pan"), (11, "$" + "[0]" * 12, "unverified")} <= paths


def test_scan_length_is_a_parameter(spark):
    t = spark.createDataFrame([("x " * 400 + "ABCDE1234F",)], "t string")
    assert t.select(F.size(scan_text(F.col("t"), 512)).alias("n"), F.size(scan_text(F.col("t"), None)).alias("m")).first() == (0, 1)


def test_patterns_are_translated():
    assert java(r"\d[\s-]") == "[0-9][\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff-]"
    assert r"\x{2028}" in re2(r".")


def test_decisions(spark):
    t = spark.createDataFrame([(None, None, None), (True, True, False), (True, False, True)], "a boolean, b boolean, c boolean")
    out = t.select(D.outcome(F.col("a"), F.col("b"))["verdict"].alias("v"), D.actionable(F.col("a"), F.col("b"), F.col("c"), F.col("c")).alias("x"), D.ocr_fail_closed(F.col("a"), F.col("b")).alias("o")).collect()
    assert [tuple(r) for r in out] == [("no_observable_change", True, "SAFE"), ("state_changed", False, "SAFE"), ("state_changed", False, "SAFE")]
    errors = {r.id: r.error for r in entry.queries()["validate_actions"](spark, "").collect()}
    assert errors[0] is None and errors[1] == "Action.x must be a number" and errors[2] == "Action.url must be a string" and errors[3] == "Unknown action variant: nope"
    assert errors[5] == "Action.target must include a selectorPath or bbox" and errors[6] is None and errors[7] is None


def test_page_elements(spark):
    html = '<form><label for="a">Card no</label><input id="a" type="text" name="n"><input type="file" aria-label="Scan"><p>Mail</p><input type="email"></form><img alt="x" src="data:image/png;base64,AA"><a href="/b">Go</a><div style="background:url(\'bg.png\')">'
    rows = page_elements(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(r.tag, r.element, r.label) for r in rows][:4] == [("input", "field", "Card no"), ("input", "field", "Scan"), ("input", "media", "Scan"), ("input", "field", "Mail")]
    assert [r.src for r in rows if r.tag == "img"] == ["data:[inline]"] and [r.label for r in rows if r.tag == "a"] == ["Go"] and rows[-1].src == "bg.png"


def test_vault(spark):
    rows = spark.createDataFrame([("otp", "1"), ("otp2", "1")], "role string, value string")
    sealed = spark.createDataFrame(vault.encrypt_vault(rows, F.lit("right")).collect())
    assert {r.value for r in vault.decrypt_vault(sealed, F.lit("right")).collect()} == {"1"}
    assert not any(r.opened for r in vault.decrypt_vault(sealed, F.lit("wrong")).collect())
    assert len({bytes(r.salt) for r in sealed.collect()}) == 2
    changed = sealed.withColumn("sealed", F.concat("sealed", F.lit(b"x")))
    assert not any(r.opened for r in vault.decrypt_vault(changed, F.lit("right")).collect())
    asked = vault.resolve(spark.createDataFrame([("otp",), ("none",)], "role string"), vault.decrypt_vault(sealed, F.lit("right"))).collect()
    assert {r.role: r.missing for r in asked} == {"otp": False, "none": True}


def test_images():
    white, black = b"\xff\xff\xff\xff", b"\0\0\0\xff"
    qr = b"".join((black if (x // 4) % 7 in (0, 2, 3, 4, 6) and x < 28 else white) for x in range(60)) * 60
    assert {r[0] for r in pixels.detect(qr, 60, 60)} >= {"qr_code"}
    bars = b"".join(black if x // 4 % 2 else white for x in range(80)) * 40
    assert pixels.detect(bars, 80, 40)[0][:5] == ("barcode", 0, 0, 80, 40)
    assert pixels.detect(b"\xd2\xaa\x8c\xff" * 3600, 60, 60) == [("face", 0, 0, 60, 60, 0.6)]
    ink = b"".join(black if 20 <= y < 30 and 10 <= x < 100 and (x + y) % 7 == 0 else white for y in range(60) for x in range(120))
    assert [r[0] for r in pixels.detect(ink, 120, 60)] == ["barcode", "signature"]
    assert pixels.detect(white * 1600, 40, 40) == []
    out = pixels.redact(white * 20_000, 200, 100, [(50, 50, 100, 20, None), (None, 1, 1, 1, None)])
    at = lambda x, y: out[(y * 200 + x) * 4 : (y * 200 + x) * 4 + 3]
    assert at(100, 60) == b"\0\0\0" and at(10, 10) == b"\xff\xff\xff"


def test_changes_over_a_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("a", t0, [0, 0, 0, 0]), ("a", t0 + datetime.timedelta(1), [0, 0, 0, 0]), ("a", t0 + datetime.timedelta(2), [0, 1, 0, 0]), ("b", t0, [1, 1, 1, 1])]
    d = spark.createDataFrame(rows, "k string, ts timestamp, bits array<int>")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changes.changed_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "k")
    q = stream.writeStream.format("memory").queryName("changes_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "log")).start()
    q.awaitTermination()
    want = [("a", True), ("a", False), ("a", True), ("b", True)]
    assert [(r.k, r.changed) for r in spark.table("changes_out").orderBy("k", "ts").collect()] == want
    assert [(r.k, r.changed) for r in changes.changed(d, "k", "ts", "bits").orderBy("k", "ts").collect()] == want
    h = spark.createDataFrame([([1.0, 2.0, 9.0, 0.0],)], "v array<double>").select(changes.average_hash(F.col("v")).alias("h")).first().h
    assert h == [0, 0, 1, 0]


def test_entry_has_rows(spark):
    got = entry.entry(spark)
    assert got.count() == 200 and got.columns[0] == "doc_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_leaks_behind_the_first_512_characters(spark, tmp_path):
    late = "x " * 400 + "mail a@b.co, key sk-abcdefghijklmnop1234"
    spark.createDataFrame([(1, late)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, late)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    q = entry.queries()
    assert {(r.category, r.match) for r in q["leak_scan_documents"](spark, str(tmp_path)).collect()} == {("email", "a@b.co"), ("api_key", "sk-abcdefghijklmnop1234")}
    for name in ("leak_patterns_whole_documents", "leak_patterns_whole_pages"):
        assert [(r.id, r.category, r.match) for r in q[name](spark, str(tmp_path)).collect()] == [(1, "api_key", "sk-abcdefghijklmnop1234")]
    payload = spark.createDataFrame([(1, '{"a":"' + late + '"}')], "payload_id int, payload string")
    assert {(r.path, r.category) for r in payload_leaks(payload).collect()} == {("$.a", "email"), ("$.a", "api_key")}


def test_conversations_are_gated_by_their_turns(spark, tmp_path):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", 'my "mail" is a@b.co'), (2, 0, "user", "nothing here"), (3, 0, "user", None), (4, 0, "system", "x " * 400 + "ABCDE1234F"), (4, 1, "user", "a@b.co")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    q = entry.queries()
    # by hand: the turns with a finding, and the planted key in every third conversation
    assert {tuple(r) for r in q["payload_gate_conversations"](spark, str(tmp_path)).collect()} == {(1, False, 1), (2, True, 0), (3, False, 1), (4, False, 2)}
    assert [tuple(r) for r in q["leak_nested_keys"](spark, str(tmp_path)).collect()] == [(3, "$.messages[1].auth.Token")]


def test_base64_is_scanned_whole(spark, tmp_path):
    code = lambda t: base64.b64encode(t.encode()).decode()
    rows = [(1, code("word " * 80 + "a@b.co end")), (2, code("plain run\n" * 230 + "mail a@b.co now")), (3, code("nothing to be found here, " * 20))]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.f for r in t.select("doc_id", F.transform(scan_base64(F.col("text")), lambda x: x["match"]).alias("f")).collect()} == {1: ["a@b.co"], 2: ["a@b.co"], 3: []}
    t.write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.doc_id, r.category) for r in entry.queries()["leak_scan_documents"](spark, str(tmp_path)).collect()} == {(1, "email"), (2, "email")}
