import json

import pytest

from quillgate.operators.payloads import payload_gate, payload_leaks, send_gated
from quillgate.sources.files import Folder
from quillgate.streaming import egress

KINDS = "payload_id long, payload string, own string, held int"


def plain_walk(text):
    """(path, key, value) of every member of a JSON text, repeated keys and all."""
    out = []

    class Members(list):
        pass

    def go(path, key, v):
        out.append((path, key, v))
        if isinstance(v, Members):
            for k, x in v:
                go(f"{path}.{k}", k, x)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(f"{path}[{i}]", None, x)

    go("$", None, json.loads(text, object_pairs_hook=Members))
    return out


REPEATED = [
    '{"t":"write to a@b.co","t":"quiet"}', '{"t":"quiet","t":"write to a@b.co"}', '{"a":{"password":1},"a":{}}', '{"password":"abcdefgh12345678","password":null}',
    '[{"x":{"y":"a@b.co","y":["c@d.org"]},"x":1}]', '{"t":"quiet","t":"still"}', '{"rawScreenshot":"zz","rawScreenshot":2}', '{"A":1,"a":2,"Token":3,"token":4}',
]


def test_every_member_of_a_repeated_key_is_scanned(spark):
    p = spark.createDataFrame(list(enumerate(REPEATED)), "payload_id int, payload string")
    got = {}
    for r in payload_leaks(p).collect():
        got.setdefault(r.payload_id, []).append((r.ord, r.path, r.category))
    for i, text in enumerate(REPEATED):
        want = []
        for path, key, v in plain_walk(text):
            k = (key or "").lower()
            want += [(path, "original_image_data")] * (k == "rawscreenshot" and isinstance(v, str)) + [(path, "sensitive_key")] * (k in ("password", "token"))
            want += [(path, "credential_value")] * (k == "password" and isinstance(v, str) and len(v) >= 16)
            want += [(path, "email")] * (isinstance(v, str) and "@" in v)
        assert [x[1:] for x in sorted(got.get(i, []))] == want, text
    gate = {r.payload_id: (r.safe, r.n_findings) for r in payload_gate(p).collect()}
    assert [gate[i][0] for i in range(len(REPEATED))] == [False, False, False, False, False, True, False, False] and gate[4] == (False, 2)


def test_a_leak_behind_a_repeated_key_is_not_sent(spark, tmp_path):
    p = spark.createDataFrame([(1, REPEATED[0]), (2, REPEATED[5])], "payload_id int, payload string")
    send_gated(p, f"{tmp_path}/out", f"{tmp_path}/held")
    assert [r.payload_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [2]
    assert [(r.payload_id, r.findings) for r in spark.read.parquet(f"{tmp_path}/held").collect()] == [(1, ["email@$.t"])]
    assert not any(f.name.startswith("_judged") for f in (tmp_path / "held").iterdir())


def test_the_gate_is_one_pass(spark):
    p = spark.range(10).selectExpr("id as payload_id", "cast(id as string) as payload")
    plan = payload_gate(p)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Range") == 1 and plan.count("ArrowEvalPython") == 1


ROWS = [(1, "quiet", "a", 0), (2, "mail a@b.co", "b", 1), (3, None, "c", None), (None, '{"password":"p"}', None, 2), (2, "quiet", "d", 3), (2, "quiet", "d", 3), (5, '{"t":"x","t":"a@b.co"}', "e", 4), (6, "x" * 200_000, "f", 5), (7, "", "g", 6)]


def test_a_batch_is_committed_once(spark, tmp_path):
    d = spark.createDataFrame(ROWS, KINDS)
    root = str(tmp_path / "out")
    parts = [d.where("payload_id <= 2"), d.where("payload_id > 2 or payload_id is null"), d.limit(0)]
    assert [egress.write_batch(x, n, root) for n, x in enumerate(parts)] == [True, True, True]
    want = (egress.sent(spark, root, d.schema).collect(), egress.quarantined(spark, root, d.schema).collect())
    # the same numbers again, whatever is in them
    assert [egress.write_batch(d, n, root) for n in range(3)] == [False, False, False]
    assert want == (egress.sent(spark, root, d.schema).collect(), egress.quarantined(spark, root, d.schema).collect())
    safe = {(r.payload_id, r.safe) for r in payload_gate(d).collect()}
    assert sorted(map(str, want[0])) == sorted(str(r) for r in d.collect() if r.payload is None or r.payload in ("quiet", "", "x" * 200_000))
    assert sorted(str(r.payload_id) for r in want[1]) == sorted(str(i) for i, s in safe if not s)


def test_what_is_not_committed_is_not_there(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame(ROWS, KINDS)
    root = str(tmp_path / "out")

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Folder, "create", fail)
    with pytest.raises(RuntimeError):
        egress.write_batch(d, 0, root)
    monkeypatch.undo()
    assert egress.sent(spark, root, d.schema).count() == egress.quarantined(spark, root, d.schema).count() == 0
    # the same batch once more, with other rows in it than those left behind
    assert egress.write_batch(d.where("payload_id = 1"), 0, root)
    assert [r.payload_id for r in egress.sent(spark, root, d.schema).collect()] == [1] and egress.quarantined(spark, root, d.schema).count() == 0


def test_a_stream_that_begins_again(spark, tmp_path):
    d = spark.createDataFrame(ROWS, KINDS)
    for k in range(3):
        d.where(f"held % 3 = {k}" + (" or held is null" if k == 0 else "")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root, rows = str(tmp_path / "out"), lambda: spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    egress.gated_stream(rows(), root, str(tmp_path / "log")).awaitTermination()
    once = sorted(map(str, egress.sent(spark, root, d.schema).collect())), sorted(map(str, egress.quarantined(spark, root, d.schema).collect()))
    # the log of what was done is lost: all three batches come again
    egress.gated_stream(rows(), root, str(tmp_path / "another log")).awaitTermination()
    assert once == (sorted(map(str, egress.sent(spark, root, d.schema).collect())), sorted(map(str, egress.quarantined(spark, root, d.schema).collect())))
    assert len(once[0]) + len(once[1]) == len(ROWS) and len(once[1]) == 3


def test_a_file_is_created_once(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "files"))
    assert f.names() == [] and f.create("a", "1é") and not f.create("a", "2") and f.read("a") == "1é" and f.names() == ["a"]
    assert [x.name for x in (tmp_path / "files").iterdir() if not x.name.endswith(".crc")] == ["a"]
