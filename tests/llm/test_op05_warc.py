import gzip

from pyspark.sql import functions as F

from quillgate.llm.warc import MALFORMED, Capture, assemble, base32_sha1, capture_text, page_ids, parse_warc, read_warc, write_warc

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a.example/x?y=1", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "http://a.example/", "same"), (3, "http://b.example/ü%20\r\nX: y", "same"), (4, None, None), (5, "nonsense[", ""),
    (None, "http://c.example", "same"), (6, "u", "long " * 200_000), (2, "http://a.example/", "same"),
]


def test_archives_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "1 as sha", "2 as keep", "3 as n", "4 as maybe"), path, per_file=2)
    got = page_ids(assemble(read_warc(spark, path))).collect()
    want = [(p, u, h or "") for p, u, h in PAGES]
    uri = lambda u: u and u.replace("\r", "%0D").replace("\n", "%0A")
    assert sorted((str(r.page_id), str(r.response.target_uri), r.response.payload_digest) for r in got) == sorted((str(p), str(uri(u)), base32_sha1(h.encode())) for p, u, h in want)
    by_id = {r.capture_id: r for r in got}
    assert len(by_id) == len(PAGES)
    for _, _, html in want:
        same = [r for r in got if r.response.payload_digest == base32_sha1(html.encode())]
        (origin,) = (r for r in same if r.response.warc_type == "response")
        assert bytes(origin.response.payload) == html.encode()
        assert origin.page_id == max((p for p, _, h in want if h == html and p is not None), default=None)
        for r in same:
            assert r.request.concurrent_to == r.metadata.concurrent_to == r.capture_id
            if r is not origin:
                assert r.response.warc_type == "revisit" and r.response.refers_to == origin.capture_id and r.response.payload is None


def test_small_payloads_are_no_revisits(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], SCHEMA), path, least=4)
    assert {r.warc_type for r in read_warc(spark, path).collect()} == {"request", "response", "metadata"}
    rows = [(1, "u", "abc"), (1, "u", "abc"), (2, "u", "abc"), (3, None, "abcd"), (3, None, "abcd")]
    write_warc(spark.createDataFrame(rows, SCHEMA), path + "2", least=4)
    got = page_ids(assemble(read_warc(spark, path + "2"))).collect()
    assert sorted((r.page_id, r.response.warc_type) for r in got) == [(1, "response"), (1, "response"), (2, "response"), (3, "response"), (3, "revisit")]


def test_members_orphans_and_either_direction(spark):
    def rec(kind, rid, to=None):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n" + (f"WARC-Concurrent-To: {to}\r\n" if to else "")
        return (head + "Content-Length: 2\r\n\r\nok\r\n\r\n").encode()

    # each record a gzip member of its own
    content = b"".join(gzip.compress(x) for x in (rec("response", "r1", "q1"), rec("request", "q1"), rec("metadata", "m1", "r1"), rec("request", "q2", "gone"), rec("metadata", "m3"), rec("request", "q1")))
    rows = list(parse_warc(content))
    assert [r[1] for r in rows] == ["r1", "q1", "m1", "q2", "m3", "q1"]
    from quillgate.llm.warc import RECORD

    # records read twice, and a second metadata record and request of one capture
    more = list(parse_warc(rec("metadata", "m9", "r1") + rec("request", "q9", "r1")))
    got = assemble(spark.createDataFrame([*rows, *rows, *more], RECORD).withColumn("capture", F.lit(1)).withColumn("of_", F.lit(2))).collect()
    out = {r.capture_id: r for r in got}
    assert len(got) == 3 and set(out) == {"r1", "gone", "m3"}
    assert (out["r1"].request.record_id, out["r1"].metadata.record_id) == ("q1", "m1")
    assert out["gone"].response is None and out["gone"].request.record_id == "q2" and out["m3"].response is None


def test_malformed_records(spark):
    def rec(rid, length=2, block="ok"):
        return f"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: {rid}\r\nContent-Length: {length}\r\n\r\n{block}\r\n\r\n".encode()

    kinds = lambda x: [(r[0], r[1]) for r in parse_warc(x)]
    bad, ok = (MALFORMED, None), lambda i: ("metadata", i)
    assert kinds(rec("a") + b"junk\r\n\r\n" + rec("b")) == [ok("a"), bad, ok("b")]
    assert kinds(rec("a") + rec("b", "x") + rec("c")) == [ok("a"), bad, ok("c")]
    assert kinds(rec("a") + rec("b", 9999) + rec("c")) == [ok("a"), bad, ok("c")]
    assert kinds(b"WARC/1.1\r\nWARC-Type: metadata\r\n\r\n" + rec("b")) == [bad, ok("b")]
    assert kinds(rec("a")[:-20]) == [bad] and kinds(b"\x1f\x8bnone") == [bad] and kinds(b"") == []
    assert kinds(gzip.compress(rec("a") + rec("b"))[:-12])[:1] in ([ok("a")], [bad])
    from quillgate.llm.warc import RECORD

    rows = list(parse_warc(rec("a") + b"junk\r\n\r\n"))
    assert [r.capture_id for r in assemble(spark.createDataFrame(rows, RECORD)).collect()] == ["a"]


def test_target_uris_are_kept_as_they_are():
    for url in ("http://a/x%20y", "http://a/100%2525", "http://a/ü"):
        text = capture_text(Capture(1, url, "s", 1, "00" * 20, 0, ""))
        assert [r[4] for r in parse_warc((text + "\r\n\r\n").replace("sha1:" + "A" * 32, "").encode())] == [url] * 3


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame([], SCHEMA), path)
    assert page_ids(assemble(read_warc(spark, path))).count() == 0


def _http(rid, body=b"body", digest=None, status=b"200", end=b"\r\n", kind=b"response"):
    block = end.join([b"HTTP/1.1 " + status + b" OK", b"X: y", b"", b""]) + body
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + rid, b"Content-Type: application/http; msgtype=response", b"Content-Length: " + str(len(block)).encode()]
    return end.join([*head, *([b"WARC-Payload-Digest: " + digest] if digest else []), b"", b""]) + block + end + end


def test_digests_of_other_algorithms():
    import base64
    import hashlib

    body = b"body"
    sha1, sha256, md5 = (hashlib.new(n, body).digest() for n in ("sha1", "sha256", "md5"))
    b32 = lambda d: base64.b32encode(d)
    good = [b"sha1:" + b32(sha1), b"sha1:" + b32(sha1).lower(), b"sha1:" + sha1.hex().encode(), b32(sha1), b"sha256:" + b32(sha256), b"SHA-256:" + sha256.hex().upper().encode(), b"md5:" + md5.hex().encode(), b"blake3:whatever", b"sha1:short"]
    for d in good:
        assert [r[0] for r in parse_warc(_http(b"a", digest=d))] == ["response"], d
    other = hashlib.sha256(b"other").digest()
    for d in (b"sha256:" + b32(other), b"sha256:" + other.hex().encode(), b"sha1:" + b32(hashlib.sha1(b"x").digest()).lower()):
        assert [r[0] for r in parse_warc(_http(b"a", digest=d))] == [MALFORMED], d


def test_statuses_and_line_ends():
    status = lambda s: [r[6] for r in parse_warc(_http(b"a", status=s))]
    assert status(b"200") == [200] and status(b"99999999999") == [None] and status(b"xx") == [None] and status(b"") == [None]
    rows = list(parse_warc(_http(b"a", end=b"\n") + _http(b"b") + _http(b"c", end=b"\n", body=b"") + b"\n\n" + _http(b"d")))
    assert [(r[0], r[1], r[7]) for r in rows if r[0] != MALFORMED] == [("response", "a", b"body"), ("response", "b", b"body"), ("response", "c", b""), ("response", "d", b"body")]


def test_blocks_that_are_no_text(spark, tmp_path):
    from quillgate.llm.warc import RECORD

    block = bytes(range(256))
    raw = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: r\r\nContent-Type: image/png\r\nContent-Length: 256\r\n\r\n" + block + b"\r\n\r\n"
    rows = list(parse_warc(raw + _http(b"a", status=b"12345678901")))
    assert [(r[0], r[7], r[8], r[10]) for r in rows] == [("resource", block, 256, None), ("response", b"body", 4, None)]
    (tmp_path / "x.warc").write_bytes(raw + _http(b"a", status=b"12345678901"))
    got = read_warc(spark, f"file://{tmp_path}/x.warc").collect()
    assert [(r.warc_type, bytes(r.payload), r.http_status) for r in got] == [("resource", block, None), ("response", b"body", None)]
    assert [r.capture_id for r in assemble(spark.createDataFrame(got, RECORD)).collect()] == ["a"]


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"{i} " + "z" * n) for i, n in enumerate([10] * 60 + [3000] * 9 + [50_000] * 3 + [50_000] * 2)]
    rows += [(1000 + i, None, "q" * 60_000) for i in range(4)]
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, per_file=16, file_bytes=16_000)
    held = []
    for f in (tmp_path / "w").glob("*.gz"):
        sizes = [r[8] for r in parse_warc(f.read_bytes()) if r[0] == "response"]
        held += sizes
        assert sum(sizes) <= 16_000 or len(sizes) == 1
    assert len(held) == 75 and page_ids(assemble(read_warc(spark, path))).count() == len(rows)
