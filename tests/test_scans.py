"""Whole scans: hostile files, targets and errors, remote targets from a stub server, streams, reports."""

import http.server
import json
import os
import threading

import pytest
from pyspark.sql import SparkSession, functions as F

from bracken.functions import messages
from bracken.operators import documents, inspect, reports, scans
from bracken.plans import scans as plans
from bracken.sources import encoders as e, remote
from bracken.streaming import failures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def test_one_hostile_file_does_not_stop_the_others(spark, tmp_path):
    for name, body, _ in plans._hostile():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "requirements.txt").write_text("torch==2.1.0\nnumpy\n")
    got = scans.scan(spark, str(tmp_path))
    assert {r.name: r.risk_level for r in got.artifacts.collect()} == {name: risk for name, _, risk in plans._hostile()}
    assert {(r.name, r.version) for r in got.dependencies.collect()} == {("torch", "2.1.0"), ("numpy", "unknown")}
    assert got.errors.count() == 0 and all(r.lint == [] for r in got.artifacts.select("lint").collect())
    assert scans.exit_code(got.artifacts, got.errors).first().exit_code == 2
    kept = scans.scan(spark, str(tmp_path / "good.pkl"), lint=True)
    assert [x.severity for x in kept.artifacts.first().lint] == ["ERROR", "WARNING"] and all(x.hint for x in kept.artifacts.first().lint)


def test_an_inspector_that_fails_gives_an_error_row(monkeypatch):
    def fail(*_):
        raise RecursionError

    monkeypatch.setattr(inspect, "_gguf", fail)
    got = inspect.look("x.gguf", b"GGUF")
    assert got["error"] == "RecursionError" and got["incomplete"]


def test_targets_that_cannot_be_scanned(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("nothing")
    for target, kind in ((tmp_path / "gone", "target"), (tmp_path / "notes.txt", "unclaimed")):
        got = scans.scan(spark, str(target))
        assert [r.kind for r in got.errors.collect()] == [kind] and got.artifacts.count() == 0
        assert scans.exit_code(got.artifacts, got.errors).first().exit_code == 1
    os.symlink(tmp_path / "nowhere", tmp_path / "link.pt")
    assert "not a regular file" in scans.scan(spark, str(tmp_path / "link.pt")).errors.first().error
    assert scans.scan(spark, str(tmp_path)).errors.count() == 0  # a folder's unclaimed files say nothing


FILES = {
    "model.pkl": e.global_pickle("os", "system"),
    "big.pt": e.zipped({"archive/data/0": bytes(3 << 20), "archive/data.pkl": e.global_pickle("os", "system")}),
    "far.gguf": e.gguf([("tokens", 9, (8, ["x" * 1000] * 1500)), ("tokenizer.chat_template", 8, "{{ x.__class__ }}")]),
    "big.onnx": e.onnx([("Relu", "")]) + e.field(99, bytes(3 << 20)),
    "README.md": b"text",
}


@pytest.fixture(scope="module")
def hub():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers.get("Range"), self.headers.get("Authorization")))
            if self.path.startswith("/api/models/"):
                status, body = (200, json.dumps([{"path": n, "type": "file"} for n in [*FILES, "gone.pkl"]]).encode()) if "org/m" in self.path else (401, b"")
                total = None
            else:
                body = FILES.get(self.path.rsplit("/", 1)[-1])
                status, total = (404, None) if body is None else (206, len(body))
                if body is not None:
                    a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
                    body, first = body[a : b + 1], a
            self.send_response(status)
            if total is not None:
                self.send_header("Content-Range", f"bytes {first}-{first + len(body) - 1}/{total}")
            self.send_header("Content-Length", str(len(body or b"")))
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_remote_repository(spark, hub):
    url, seen = hub
    got = scans.scan(spark, "hf://org/m", hub=url)
    risks = {r.name: r.risk_level for r in got.artifacts.collect()}
    assert risks == {"model.pkl": "CRITICAL (RCE Detected: os.system)", "big.pt": "CRITICAL (RCE Detected: os.system)", "far.gguf": "CRITICAL (Chat Template Code Execution: __class__)", "big.onnx": "MEDIUM (Scan Incomplete)"}
    assert ["not found" in r.error for r in got.errors.collect()] == [True] and not any(p.endswith("README.md") for p, _, _ in seen)
    one = scans.scan(spark, f"{url}/x/model.pkl", hub=url)
    assert one.artifacts.count() == 1 and one.artifacts.first().license is None
    refused = scans.scan(spark, "hf://other/m", hub=url).errors.collect()
    assert len(refused) == 1 and refused[0].error.startswith("Authentication failed for other/m") and refused[0].kind == "fetch"


def test_range_file(hub):
    url, _ = hub
    f = remote.RangeFile(f"{url}/x/model.pkl", url)
    body = FILES["model.pkl"]
    assert f.size == len(body) and f.read(4) == body[:4] and f.tell() == 4
    assert f.seek(-3, 2) == len(body) - 3 and f.read() == body[-3:] and f.read(1) == b"" and f.seek(9 << 20) == f.size and f.seek(-1) == 0
    assert remote.status(TimeoutError()) == "timeout" and remote.status(ConnectionError()) == "connection_error" and remote.status(ValueError()) == "other"


def test_token_goes_to_the_hub_alone(monkeypatch):
    monkeypatch.delenv("HUGGING_FACE_HUB_TOKEN", raising=False)
    monkeypatch.setenv("HF_TOKEN", "secret")
    assert remote.headers("https://huggingface.co/x") == {"Authorization": "Bearer secret"}
    for url in ("https://huggingface.co.evil.test/x", "https://evil.test/huggingface.co", "https://cdn.huggingface.co/x"):
        assert remote.headers(url) == {}
    monkeypatch.setenv("HF_TOKEN", "")
    monkeypatch.setenv("HUGGING_FACE_HUB_TOKEN", "other")
    assert remote.token() == "other"


def test_stream_counts_like_the_table(spark, tmp_path):
    log = plans._log(spark, SF).withColumn("user_id", F.col("user_id") % 7)
    for i in range(3):  # three files, each later than the one before
        cut = log.orderBy("ts", "event_id").offset(i * 334).limit(334)
        cut.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = failures.stream(source, "user_id", ["ts", "event_id"]).writeStream.format("memory").queryName("streaks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r.event_id, r.streak) for r in spark.table("streaks").collect()}
    want = {(r.event_id, r.streak) for r in failures.streaks(log, "user_id", ["ts", "event_id"]).select("event_id", "streak").collect()}
    assert got == want and max(n for _, n in want) >= failures.WARN_FROM


def test_success_clears_its_own_class_only(spark):
    rows = [(1, 1, True, "E", "401", "hub"), (1, 2, True, "E", "401", "hub"), (1, 3, False, None, None, "local"), (1, 4, True, "E", "401", "hub"), (1, 5, False, None, None, "hub"), (1, 6, True, "E", "401", "hub"), (1, 7, True, "E", "404", "hub"), (2, 1, False, None, None, "hub")]
    log = spark.createDataFrame(rows, "k int, t int, failed boolean, error_type string, http_status string, target_type string")
    got = failures.streaks(log, "k", ["t"])
    assert {r.t: r.streak for r in got.collect()} == {1: 1, 2: 2, 4: 3, 6: 1, 7: 1}
    assert [(r.t, "HF_TOKEN" in r.warning) for r in failures.warnings(got).collect()] == [(4, True)]


def test_review_views(spark):
    rows = [(i, f"m{i}", s, "", "PyTorch", "PASS", "MIT") for i, s in enumerate(["LOW", "HIGH", "CRITICAL", "HIGH", "MEDIUM"])]
    found = spark.createDataFrame(rows, "pos int, name string, severity string, issue string, framework string, legal string, license string")
    body = reports.text(reports.review(found, "models", 5, 3, "https://x.test/?h=1"))
    assert body.startswith(reports.MARKER) and "1 CRITICAL, 2 HIGH, 1 MEDIUM, 1 LOW across 5" in body and "+ 2 more findings" in body
    assert [line.split("`")[1] for line in body.split("\n") if line.startswith("| 🔴") or line.startswith("| 🟠")] == ["m2", "m1", "m3"]
    assert "No CRITICAL or HIGH risks in 1 " in reports.text(reports.review(found.where("severity = 'LOW'"), "models", 1))
    assert reports.text(reports.review(found, "models", 5), 50).endswith(reports.CUT)


def test_scorecard_is_sound(spark):
    cases = plans.corpus.table(spark)
    matrix = plans.corpus.score(cases)
    shown = reports.text(reports.scorecard(cases, matrix))
    assert "**9 of 11** evasion cases" in shown and shown.count("Current limitation") == 2
    assert len(json.loads(reports.matrix_json(matrix))["cases"]) == 13
    assert messages.STAMP in shown and messages.STAMP not in spark.createDataFrame([(shown,)], "t string").select(messages.without_stamp(F.col("t"))).first()[0]


def test_diff_and_documents(spark, tmp_path):
    def bom(*rows):
        return json.dumps({"components": [{"name": n, "version": v, "description": d, "hashes": [{"alg": "SHA-256", "content": h}] if h else []} for n, v, d, h in rows]})

    (tmp_path / "a.json").write_text(bom(("x", "1", "Risk: LOW | Framework: F | Legal: PASS | License: MIT", "aa"), ("gone", None, "", None)))
    (tmp_path / "b.json").write_text(bom(("x", "2", "Risk: CRITICAL (y) | Framework: F | Legal: PASS | License: MIT", "bb"), ("new", None, "", None)))
    rows, flags = scans.diff(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert {r.name: r.kind for r in rows.collect()} == {"x": "changed", "gone": "removed", "new": "added"}
    assert flags.first().risk_increased and flags.first().hash_drifted
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "v.npz").write_bytes(e.zipped({"a.npy": e.npy("'<f8'", "(1,)"), "b.npy": e.npy("'<f8'", "(1,)")}))
    (tmp_path / "m" / "d.dill").write_bytes(e.stack_global_pickle("dill._dill", "_create_code"))
    props = {(r.path.rsplit("/", 1)[-1], r.name, r.value) for r in documents.properties(scans.scan(spark, str(tmp_path / "m")).artifacts).collect()}
    assert {("v.npz", "bracken:numpy:member_count", "2"), ("d.dill", "bracken:pickle:dill_code_objects", "true"), ("v.npz", "bracken:pickle:container", "zip")} <= props


def test_large_onnx_is_read_to_its_end(tmp_path):
    weights = e.field(7, e.field(5, e.field(9, bytes(17 << 20))))
    path = tmp_path / "w.onnx"
    path.write_bytes(e.field(1, 8) + weights + e.onnx([("Own", "own")]))
    got = inspect.look(str(path), path.read_bytes()[: 16 << 20], cut=True, sha256="x")
    assert got["custom_ops"] == ["own.Own"] and not got["incomplete"] and got["sha256"] == "x"
