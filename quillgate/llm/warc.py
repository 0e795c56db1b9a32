"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response or revisit, and a metadata record; request and metadata
name the response by WARC-Concurrent-To. Archives are written by Spark's text writer, whose
line separator is the record terminator, so they are committed like any other table and
land wherever the path points. Reading takes whole archive files (kept small by a number
of captures a file), cuts records by Content-Length, and assembly joins the records of a
capture through their concurrent-to identifiers.

Which of equal payloads is the response is told by digests; payloads themselves move only
where several pages share one, and then only the one that becomes the response.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm._sketch import marked, sketch
from quillgate.llm._store import CLEANUP, materialise, settings, shared_path

#: Captures of an archive file, and bytes of their payloads.
PER_FILE, FILE_BYTES = 1000, 128 << 20
#: Parts that the pages of a common payload are joined in.
SALTS = 16
MALFORMED = "malformed"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("8e3c1e0a-7c57-4d0e-9b53-1f6d1f9a2b11")
_END = "\r\n\r\n"
_BLANK, _LINES, _STATUS = re.compile(rb"\r?\n\r?\n"), re.compile(rb"(?:\r?\n){0,2}"), re.compile(rb"[0-9]{3}")
_DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, warc_date string, http_status int, payload binary, payload_bytes long, payload_digest string, fields string"


def _id(kind: str, page: int | None, url: str | None, sha: str, copy: int) -> str:
    """The same for the same row; ``copy`` counts rows that repeat page, url and payload."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}/{page}/{copy}/{sha}/{url}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: str) -> str:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), *headers, ("Content-Length", str(len(block.encode())))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n" + block


class Capture(NamedTuple):
    """A page to archive. ``html`` is None for a revisit, which refers to the page ``keep``."""

    page: int | None
    url: str | None
    sha: str
    copy: int
    sha1: str
    size: int
    html: str | None
    keep: int | None = None
    keep_url: str | None = None


def capture_text(c: Capture, date: str = DATE) -> str:
    """The three records of one capture, without the terminator of the last. A target URI is
    written as it is; only CR and LF, which no URI has and a header can't hold, as %0D, %0A."""
    own_id = lambda kind: _id(kind, c.page, c.url, c.sha, c.copy)
    digest = base64.b32encode(bytes.fromhex(c.sha1)).decode()
    uri = None if c.url is None else c.url.replace("\r", "%0D").replace("\n", "%0A")
    where = [("WARC-Date", date), *([("WARC-Target-URI", uri)] if uri else [])]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {c.size}\r\n\r\n"
    own = [*where, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if c.html is None:
        main = _record("revisit", own_id("response"), [*own, ("WARC-Profile", _IDENTICAL), ("WARC-Refers-To", _id("response", c.keep, c.keep_url, c.sha, 1))], head)
    else:
        main = _record("response", own_id("response"), own, head + c.html)
    try:
        to = urlsplit(uri or "")
        path, host = (to.path or "/") + (f"?{to.query}" if to.query else ""), to.netloc
    except ValueError:
        path, host = "/", ""
    path = path.replace(" ", "%20")
    joined = [*where, ("WARC-Concurrent-To", own_id("response"))]
    request = _record("request", own_id("request"), [*joined, ("Content-Type", "application/http; msgtype=request")], f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n")
    fields = ("" if c.page is None else f"page-id: {c.page}\r\n") + ("" if c.url is None else f"has-url: {len(c.url)}\r\n")
    metadata = _record("metadata", own_id("metadata"), [*joined, ("Content-Type", "application/warc-fields")], fields)
    return _END.join((request, main, metadata))


def _captures(p: DataFrame, least: int) -> DataFrame:
    """Rows of :class:`Capture`, one for each of ``p`` (page, url, html)."""
    p = p.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256))
    size = F.octet_length("html").cast("long")
    narrow = ("page", "url", "sha", "sha1", "size")
    d = p.withColumns({"sha1": F.sha1("html"), "size": size})
    # rows that repeat page, url and payload are one here, with their number; small payloads are kept
    told = d.groupBy(*narrow).agg(F.count(F.lit(1)).alias("n"), F.first(F.when(size < least, F.col("html"))).alias("small"))
    told = materialise(told, "warc-manifest")
    of_sha = told.groupBy("sha").agg(F.max(F.struct("page", "url")).alias("k"), F.sum("n").alias("total"))
    key = lambda *c: F.xxhash64(*c)
    shared = sketch(of_sha.where("total > 1").select("sha"), key("sha"))
    # payloads of one page each are responses, where they are
    alone = marked(d, key("sha"), shared, "maybe").where("not maybe").select(*narrow, "html")
    # of the others (some by chance) the manifest tells which revisit which; a common payload is salted
    some = marked(told, key("sha"), shared, "maybe").where("maybe").withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)))
    keep = marked(of_sha, key("sha"), shared, "maybe").where("maybe").select("sha", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    some = materialise(some.join(keep, ["sha", "salt"]).select(*narrow, "n", "small", F.col("k.page").alias("keep"), F.col("k.url").alias("keep_url")), "warc-shared")
    stays = F.col("page").eqNullSafe(F.col("keep")) & F.col("url").eqNullSafe(F.col("keep_url")) & F.col("small").isNull()
    copies = some.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    copies = copies.where(~(stays & (F.col("copy") == 1))).select(*narrow, "copy", F.col("small").alias("html"), "keep", "keep_url")
    origins = some.where(stays).select("sha", F.col("page").alias("o_page"), F.col("url").alias("o_url"))
    row = ("page", "url", "sha")
    found = marked(d, key(*row), sketch(origins, key("o_page", "o_url", "sha")), "maybe").where("maybe").groupBy(*narrow).agg(F.first("html").alias("html"))
    o = origins.withColumnRenamed("sha", "o_sha")
    kept = found.join(o, (F.col("sha") == F.col("o_sha")) & F.col("page").eqNullSafe(F.col("o_page")) & F.col("url").eqNullSafe(F.col("o_url"))).select(*narrow, "html")
    first = alone.unionByName(kept).select(*narrow, F.lit(1).cast("long").alias("copy"), "html", F.lit(None).cast("long").alias("keep"), F.lit(None).cast("string").alias("keep_url"))
    return first.unionByName(copies).select("page", "url", "sha", "copy", "sha1", "size", "html", "keep", "keep_url")


def write_warc(pages: DataFrame, path: str, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, per_file: int = PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Writes every row of ``pages`` as a capture to gzipped archives under ``path``.

    Of rows with equal payloads of ``least`` bytes or more, that of the largest id, then url,
    is the response (nulls are the smallest), the others revisit it; so do rows that repeat
    all of it. A file has ``per_file`` captures and payloads of ``file_bytes`` at most, but
    where one payload alone is larger: captures are written by classes of size, the larger
    with fewer to a file. A null html is an empty payload; a null url or id is left out of the records.
    No rows, no records; extra columns are not looked at, whatever their names.
    """
    p = pages.select(F.col(page_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = zip(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array([capture_text(Capture(*r)) for r in rows], pa.string())], names=["value"])

    # class k: up to file_bytes / per_file * 4 ** k
    usual = max(1, file_bytes // per_file)
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    last = math.ceil(math.log(per_file, 4)) if per_file > 1 else 0
    kind = sum((F.when(size > usual * 4**k, 1).otherwise(0) for k in range(last)), F.lit(0))
    # revisits have no payload, so they are of class 0
    classes = sorted({0} | {r.k for r in p.select(kind.alias("k")).distinct().collect()})
    captures = _captures(p, least)
    for k in classes:
        own = captures if classes == [0] else captures.where(kind == k)
        with settings(pages.sparkSession, {CLEANUP: "true"}):
            own.mapInArrow(run, "value string").write.mode("append").option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", max(1, per_file // 4**k)).text(path)


def _unpacked(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:  # one member a record, or one for all
        z = zlib.decompressobj(31)
        try:
            out.append(z.decompress(content) + z.flush())
        except zlib.error:
            out.append(b"\r\n")  # no gzip: a malformed record of its own
            break
        content = z.unused_data
    return b"".join(out)


def _digest_holds(told: str, payload: bytes) -> bool:
    """Whether a payload has the digest told as algorithm:value, in hexadecimal or base32 of
    either case. One of an algorithm or a form that isn't known can't be denied."""
    name, _, value = told.rpartition(":")
    name = name.lower().replace("-", "") or "sha1"
    if name not in _DIGESTS:
        return True
    own = hashlib.new(name, payload).digest()
    if len(value) == 2 * len(own):
        return value.lower() == own.hex()
    base32 = base64.b32encode(own).decode().rstrip("=")
    return value.upper().rstrip("=") == base32 if len(value.rstrip("=")) == len(base32) else True


def _parsed(data: bytes, at: int, payloads: bool) -> tuple[tuple, int]:
    """The row of the record at byte ``at``, and where the next one begins."""
    if not data.startswith(b"WARC/", at):
        raise ValueError("no record begins here")
    end = _BLANK.search(data, at)
    if end is None:
        raise ValueError("its header doesn't end")
    h = {}
    for x in data[at : end.start()].splitlines()[1:]:
        k, _, v = x.partition(b":")
        h[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    start = end.end()
    stop = start + int(h["content-length"])
    if stop < start or stop > len(data):
        raise ValueError("its content is cut off")
    block = data[start:stop]
    kind, fields, status, payload, size = h["warc-type"], None, None, None, None
    digest = h.get("warc-payload-digest") or None
    if h.get("content-type", "").lower().startswith("application/http"):
        blank = _BLANK.search(block)
        head, body = (block[: blank.start()], block[blank.end() :]) if blank else (block, b"")
        first = head.split(None, 2)
        if kind != "request" and len(first) > 1 and _STATUS.fullmatch(first[1]):
            status = int(first[1])
        if kind == "response":
            payload, size = body, len(body)
            if digest and not _digest_holds(digest, body):
                raise ValueError("its payload doesn't match its digest")
    else:
        try:
            fields = block.decode()
        except UnicodeDecodeError:  # no text: the block is the payload
            payload, size = block, len(block)
    row = (kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), status, payload if payloads else None, size, digest and digest.removeprefix("sha1:"), fields)
    return row, _LINES.match(data, stop).end()


def parse_warc(content: bytes, payloads: bool = True) -> Iterator[tuple]:
    """Rows of RECORD; blocks are cut by Content-Length, and lines may end with a line feed
    alone. A status that isn't three digits is null; a block that is neither HTTP nor text is
    the payload. Bytes that are no whole record give
    one row of type MALFORMED, ``fields`` saying why, and reading goes on at the next line
    that a record can begin with. A gzip member that is cut off gives what can be read."""
    data, at = _unpacked(content), 0
    while at < len(data):
        try:
            row, at = _parsed(data, at, payloads)
            yield row
        except (ValueError, KeyError) as e:
            yield (MALFORMED, *[None] * 9, f"byte {at}: {type(e).__name__}: {e}")
            at = data.find(b"\nWARC/", at + 1)
            at = at + 1 if at >= 0 else len(data)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORD rows of all archives under ``path``, gzipped or plain. Payload digests are
    checked against the payloads; without ``payloads`` these are then left out. Malformed
    records as in :func:`parse_warc`; no archives, no rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in it:
            for content in b.column("content"):
                rows = list(parse_warc(content.as_py(), payloads))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, and response, request, metadata structs.

    A capture is a response or revisit; requests and metadata are joined to it through the
    concurrent-to identifier of either side. A request or metadata record whose response is
    missing belongs to a capture with a null response. Records read twice (the same type
    and identifier) count once; of several requests or metadata records of a capture, that
    with the smallest identifier is taken. Records without an identifier, malformed ones
    among them, are left out.
    """
    kept = records.where("record_id is not null")
    names = [F.col(c) for c in records.columns]
    role = F.when(F.col("warc_type").isin("response", "revisit"), "response").when(F.col("warc_type").isin("request", "metadata"), F.col("warc_type"))
    # what a response names belongs to it
    turned = kept.where(role == "response").where("concurrent_to is not null").groupBy(F.col("concurrent_to").alias("named")).agg(F.min("record_id").alias("of"))
    members = kept.where(role.isin("request", "metadata")).join(turned, F.col("record_id") == F.col("named"), "left").withColumn("capture_id", F.coalesce("of", "concurrent_to", "record_id"))
    rows = kept.where(role == "response").withColumn("capture_id", F.col("record_id")).unionByName(members.drop("named", "of"))
    taken = [F.min_by(F.when(role == r, F.struct(*names)), F.when(role == r, F.col("record_id"))).alias(r) for r in ("response", "request", "metadata")]
    return rows.groupBy("capture_id").agg(*taken)


def page_ids(captures: DataFrame) -> DataFrame:
    """Adds page_id, as the metadata record has it; null where that is missing or has none."""
    page = F.regexp_extract("metadata.fields", r"(?m)^page-id: (-?\d+)", 1)
    return captures.withColumn("page_id", F.when(page != "", page).cast("long"))


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, repeats and empty tables as in :func:`write_warc`: a row per row of ``pages``."""
    path = shared_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = page_ids(assemble(read_warc(spark, path, payloads=False)))
    c = materialise(
        captures.select("page_id", "capture_id", *(F.col(f"response.{x}").alias(x) for x in ("warc_type", "refers_to", "payload_bytes", "payload_digest"))), "warc-captures"
    )
    responses, revisits = c.where("warc_type = 'response'"), c.where("warc_type = 'revisit'")
    # revisits of one payload refer to one response: both sides are salted
    at = F.pmod(F.xxhash64("capture_id"), F.lit(SALTS))
    origin = responses.join(revisits.select(F.col("refers_to").alias("r")).distinct(), F.col("capture_id") == F.col("r"), "left_semi")
    origin = origin.select(F.col("capture_id").alias("o"), F.col("page_id").alias("o_page"), F.col("payload_bytes").alias("o_bytes"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("o_salt"))
    again = revisits.withColumn("salt", at).join(origin, (F.col("refers_to") == F.col("o")) & (F.col("salt") == F.col("o_salt")), "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = responses.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return first.union(again.select("page_id", "o_bytes", "payload_digest", "warc_type", "o_page")).toDF(*names)


OP5_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS keep FROM p GROUP BY html),
k AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place FROM p),
b AS (SELECT page_id, keep, place, html, list_transform(string_split(sha1(html), ''), lambda x: instr('0123456789abcdef', x) - 1) AS x FROM k JOIN g USING (html)),
n AS (SELECT *, list_transform(range(0, 160), lambda i: (x[i // 4 + 1] >> (3 - i % 4)) & 1) AS bit FROM b)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + bit[5*i+1] * 16 + bit[5*i+2] * 8 + bit[5*i+3] * 4 + bit[5*i+4] * 2 + bit[5*i+5], 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN keep END AS refers_to
FROM n
"""
