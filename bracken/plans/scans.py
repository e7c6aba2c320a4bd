"""Queries over model files that are written from table rows, read back and judged, and over reports and logs."""

from __future__ import annotations


import bz2
import gzip
import hashlib
import lzma
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bracken.functions import messages
from bracken.operators import corpus, documents, inspect, ranking, reports, scans
from bracken.plans.artifacts import IMPORTS, _pick, _pick_sql
from bracken.plans.boms import artifacts
from bracken.sources import encoders as e, remote
from bracken.streaming import failures


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _written(rows: DataFrame, encode: Callable[[dict], tuple[str, bytes]]) -> DataFrame:
    """(path, content) of the file that `encode` makes of each row."""

    def run(batches):
        for b in batches:
            got = [encode(r) for r in b.to_pylist()]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _parts(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")


#: Files that once stopped a scan, beside a good one: name, bytes, risk.
def _hostile() -> list[tuple[str, bytes, str]]:
    deep = b"[" * 100_000
    return [
        ("good.pkl", e.global_pickle("os", "system"), "CRITICAL (RCE Detected: os.system)"),
        ("deep.keras", e.zipped({"config.json": deep}), "MEDIUM (Keras config incomplete: read limit reached)"),
        ("deep.h5", b"\x89HDF\r\n\x1a\nmodel_config{\"a\":" + deep, "MEDIUM (Keras config incomplete: read limit reached)"),
        ("deep.safetensors", len(deep).to_bytes(8, "little") + deep, "UNKNOWN (Invalid Header)"),
        ("number.safetensors", b"\x1e\0\0\0\0\0\0\0" + b'{"__metadata__":{"license":7}}', "LOW"),
        ("many.gguf", b"GGUF" + b"\3\0\0\0" + b"\0" * 8 + b"\xff" * 8, "MEDIUM (GGUF metadata incomplete: 0/9223372036854775807 keys read)"),
        ("surrogate.pkl", b"\x80\x04\x8c\x02os\x94\x8c\x09a\xed\xa0\x80syst\x94\x93.", "LOW"),
        ("nested.onnx", e.onnx([("Own", "own.domain")], inside=14), "MEDIUM (ONNX: 1 custom operator(s))"),
        ("deeper.onnx", e.onnx([("Own", "own.domain")], inside=250), "MEDIUM (ONNX graph incomplete: depth limit reached)"),
        ("cut.npy", b"\x93NUMPY\x01\x00\xff\xff{", "LOW"),
    ]


def hostile_files(spark, sf_dir: str) -> DataFrame:
    """Every file of a folder of hostile ones has a row; none stops the others."""
    files = _hostile()
    rows = _written(_parts(spark, sf_dir), lambda r: (f"{r['p_partkey']}/{files[r['p_partkey'] % len(files)][0]}", files[r["p_partkey"] % len(files)][1]))
    return inspect.scan(rows).groupBy("name", "risk_level").agg(F.count("*").alias("n"))


def gguf_facts(spark, sf_dir: str) -> DataFrame:
    def encode(r: dict) -> tuple[str, bytes]:
        entries = [("general.architecture", 8, r["p_brand"]), ("general.file_type", 4, r["p_size"]), ("tokens", 9, (8, [r["p_type"], "b"])), ("general.license", 8, "mit"), ("scale", 6, 0.5)]
        return f"{r['p_partkey']}.gguf", e.gguf(entries, 5 + (r["p_partkey"] % 3 == 0))

    return inspect.scan(_written(_parts(spark, sf_dir), encode)).select("name", "architecture", "quantization", "license", "keys_read", F.array_join("metadata_keys", ",").alias("keys"), "risk_level")


def onnx_facts(spark, sf_dir: str) -> DataFrame:
    def encode(r: dict) -> tuple[str, bytes]:
        k = r["p_partkey"]
        domain, outside = ("own" if k % 3 == 0 else ""), ([f"{'../' * (k % 2)}{r['p_size']}.bin"] if k % 5 == 0 else [])
        return f"{k}.onnx", e.onnx([("Relu", ""), ("Add", domain), ("Relu", "ai.onnx")], r["p_brand"], outside, r["p_type"], {"": 17, "ai.onnx.ml": 3}, k % 4)

    rows = inspect.scan(_written(_parts(spark, sf_dir), encode))
    shown = rows.select("name", "onnx.*", "risk_level", F.array_join("threats", ";").alias("threats"))
    return shown.select("name", "ir_version", "producer_name", "producer_version", "graph_name", F.array_join("opsets", ",").alias("opsets"), "nodes", "subgraphs", F.array_join(F.array_sort("op_types"), ",").alias("op_types"), "risk_level", "threats")


def numpy_headers(spark, sf_dir: str) -> DataFrame:
    kinds = ["'<f8'", "'|O'", "[('O', '<i4'), ('b', '<f4')]", "[('a', '|O')]"]

    def encode(r: dict) -> tuple[str, bytes]:
        return f"{r['p_partkey']}.npy", e.npy(kinds[r["p_partkey"] % 4], f"({r['p_size']}, 2)")

    return inspect.scan(_written(_parts(spark, sf_dir), encode)).select("name", "npy.object_dtype", "npy.shape", "npy.version", "risk_level")


def zip_imports(spark, sf_dir: str) -> DataFrame:
    """Imports in zip files, some of them tampered with, packed or cut."""

    def encode(r: dict) -> tuple[str, bytes]:
        k = r["p_partkey"]
        data = e.torch_zip(e.global_pickle(*IMPORTS[k % len(IMPORTS)][:2]), k % 2 == 0)
        tampered = [lambda x: x, lambda x: e.other_local_name(x, "archive/data.pkl", "archive/data_pkl"), lambda x: e.local_flags(x, 8), e.wrong_crc][k // 2 % 4]
        return f"{k}.pt", tampered(data)

    return inspect.scan(_written(_parts(spark, sf_dir), encode)).groupBy("risk_level").agg(F.count("*").alias("n"))


def joblib_codecs(spark, sf_dir: str) -> DataFrame:
    codecs: list[tuple[str | None, Callable[[bytes], bytes]]] = [(None, lambda x: x), ("gzip", gzip.compress), ("bz2", bz2.compress), ("xz", lzma.compress), ("zlib", zlib.compress), ("zstd", lambda x: b"\x28\xb5\x2f\xfd" + x)]

    def encode(r: dict) -> tuple[str, bytes]:
        return f"{r['p_partkey']}.joblib", codecs[r["p_partkey"] % 6][1](e.stack_global_pickle("os", "system", r["p_brand"]))

    return inspect.scan(_written(_parts(spark, sf_dir), encode)).groupBy("packed", "unpacked_bytes", "risk_level").agg(F.count("*").alias("n"))


def salvaged_imports(spark, sf_dir: str) -> DataFrame:
    """Imports after bytes that are no pickle, in both spellings, in both modes."""

    def encode(r: dict) -> tuple[str, bytes]:
        write = e.global_pickle if r["p_partkey"] % 2 else e.stack_global_pickle
        return f"{r['p_partkey']}.pkl", b"\xff\xfe" + r["p_brand"].encode() + b"\x00" + write(*IMPORTS[r["p_partkey"] % len(IMPORTS)][:2])

    facts = inspect.facts(_written(_parts(spark, sf_dir), encode))
    both = [inspect.judge(facts, strict).groupBy("risk_level").agg(F.count("*").alias("n")).withColumn("strict", F.lit(strict)) for strict in (False, True)]
    return both[0].unionByName(both[1])


ARGUMENTS = ["name", "upper", "a.__class__.b", "system", "subsystem", "x.__globals__", "popen.x"]
_BAD = [False, False, True, True, False, True, True]


def dual_use_arguments(spark, sf_dir: str) -> DataFrame:
    def encode(r: dict) -> tuple[str, bytes]:
        k = r["p_partkey"]
        return f"{k}.pkl", e.stack_global_pickle("operator", ("attrgetter", "methodcaller")[k % 2], ARGUMENTS[k % len(ARGUMENTS)])

    return inspect.scan(_written(_parts(spark, sf_dir), encode)).select("name", F.array_join("threats", ";").alias("threats"))


def format_properties(spark, sf_dir: str) -> DataFrame:
    """Properties of a GGUF, a Keras, an ONNX, a NumPy, a joblib and a SafeTensors file, made of each part."""

    def encode(r: dict) -> tuple[str, bytes]:
        k, brand = r["p_partkey"], r["p_brand"]
        return [
            (f"{k}.gguf", e.gguf([("general.architecture", 8, brand), ("general.file_type", 4, 7), ("tokenizer.chat_template", 8, "{{ x.__class__ }}")])),
            (f"{k}.keras", e.keras_zip({"class_name": "Sequential", "config": {"layers": [{"class_name": "Lambda", "config": {"name": brand}}, {}]}}, "3.1.0")),
            (f"{k}.onnx", e.onnx([("Relu", ""), ("Own", "own")], brand, ["w.bin"])),
            (f"{k}.npy", e.npy("'<f8'", "(3,)")),
            (f"{k}.joblib", zlib.compress(e.global_pickle("os", "system"))),
            (f"{k}.safetensors", e.safetensors({"w": "F32", "v": "F16"}, {"license": "mit"})),
        ][k % 6]

    rows = documents.properties(inspect.scan(_written(_parts(spark, sf_dir), encode)))
    return rows.groupBy("name", "value").agg(F.count("*").alias("n"))


def evasion_scorecard(spark, sf_dir: str) -> DataFrame:
    return scans.scorecard(spark)


def evasions_caught(spark, sf_dir: str) -> DataFrame:
    cases = corpus.table(spark)
    return reports.caught(reports.wide(cases, corpus.score(cases)))


def markdown_report(spark, sf_dir: str) -> DataFrame:
    rows = artifacts(spark, sf_dir).withColumn("sha256", F.sha2("name", 256))
    return reports.markdown(rows, 3, ["name"]).where("part = 1").select("pos", "line")


def review_comment(spark, sf_dir: str) -> DataFrame:
    """The comment for an inventory whose descriptions are read back."""
    rows = artifacts(spark, sf_dir).withColumn("sha256", F.lit(None).cast("string"))
    parts = documents.components(rows).withColumn("pos", F.regexp_extract("name", r"(\d+)$", 1).cast("long"))
    n = rows.count()
    return reports.review(reports.findings(parts), "models", n, 5)


def report_findings(spark, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    text = F.when(k % 5 == 0, "Risk: CRITICAL (Legacy Binary) | Framework: PyTorch | Legal: PASS | License: MIT").when(k % 5 == 1, "Risk: LOW").when(k % 5 == 2, "no such fields").when(k % 5 == 3, "Risk: odd | Framework: ONNX").otherwise(None)
    kind = F.when(k % 7 == 0, "library").otherwise("machine-learning-model")
    rows = s.select(k.alias("pos"), F.col("s_name").alias("name"), kind.alias("type"), text.alias("description"))
    return reports.findings(rows)


def _fetches(spark, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    status = _pick("page_id", ["401", "403", "404", "500", "timeout", "connection_error", "other"])
    url = F.when(k % 4 == 0, F.concat(F.lit("hf://org/model-"), k.cast("string"))).otherwise(F.concat(F.lit("https://files.test/m/"), k.cast("string"), F.lit(".pt?x=1")))
    return _table(spark, sf_dir, "pages").select("page_id", status.alias("status"), url.alias("url"), (k % 2 == 0).alias("token"))


def fetch_messages(spark, sf_dir: str) -> DataFrame:
    rows = _fetches(spark, sf_dir)
    return rows.select("page_id", messages.fetch_failure(F.col("status"), F.col("url"), F.col("token")).alias("message"))


def error_records(spark, sf_dir: str) -> DataFrame:
    rows = _fetches(spark, sf_dir).select(messages.error_record(F.lit("HTTPError"), F.col("status"), F.col("token"), F.col("url")).alias("r"))
    return rows.groupBy("r.command", "r.error_type", "r.http_status", "r.token_present", "r.target_type").agg(F.count("*").alias("n"))


def upload_fields(spark, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, "  ").otherwise(F.concat(F.lit(" https://p.test/"), k.cast("string"), F.lit("// ")))
    number = F.when(k % 2 == 0, k.cast("string")).otherwise("")
    return _table(spark, sf_dir, "supplier").select(
        k.alias("k"), messages.platform_url(url, "https://platform.test").alias("url"), messages.run_id(number, F.when(k % 5 == 0, "2")).alias("run"),
        messages.scanned_ref(F.when(k % 4 == 0, " main ").otherwise(" ")).alias("ref"), messages.response(k % 600, F.repeat("s_name", 40)).alias("response"), messages.with_reference(F.concat(F.lit("https://x.test/"), F.when(k % 2 == 0, "?a=1").otherwise("")), k % 7 == 0).alias("link"),
    )


def report_icons(spark, sf_dir: str) -> DataFrame:
    rows = artifacts(spark, sf_dir)
    found = F.regexp_extract("risk_level", r"^([A-Z]+)", 1)
    return rows.groupBy(messages.risk_icon(F.col("risk_level")).alias("risk"), messages.legal_icon(F.col("legal_status")).alias("legal"), messages.severity_icon(found).alias("severity")).agg(F.count("*").alias("n"))


def unstamped_texts(spark, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("\n\n# T\n_Generated by x_\n"), "role", F.lit("\n_Generated by y_\nend\n "))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", messages.without_stamp(text).alias("text"))


def claimed_extensions(spark, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in remote.extensions()], "extension string")


def requirement_lines(spark, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("# needs\nalpha=="), k, F.lit(".1\r\nbeta>=2,<3 # why\n\n-r other.txt\ngamma"))
    rows = _table(spark, sf_dir, "supplier").select(F.concat(k, F.lit("/requirements.txt")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    return inspect.dependencies(rows).groupBy("name", "version").agg(F.count("*").alias("n"))


def scan_exit(spark, sf_dir: str) -> DataFrame:
    """Exit codes of scans with a risk, with errors alone, and without both."""
    rows = artifacts(spark, sf_dir)
    low = rows.where("risk_level = 'LOW'")
    wrong = _fetches(spark, sf_dir).select(F.col("url").alias("file"))
    out = None
    for name, a, errors, fails in (("risk", rows, wrong, True), ("errors", low, wrong, True), ("neither", low, wrong.limit(0), True), ("allowed", rows, wrong.limit(0), False)):
        one = scans.exit_code(a, errors, fails).select(F.lit(name).alias("scan"), "exit_code")
        out = one if out is None else out.unionByName(one)
    return out


def _log(spark, sf_dir: str) -> DataFrame:
    """Events as a log of scans: a machine a user; purchases are successes."""
    target = F.when(F.col("event_id") % 3 == 0, "local").otherwise("huggingface")
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "purchase").alias("failed"), F.lit("HTTPError").alias("error_type"), F.when(F.col("event_type") == "view", "401").otherwise("404").alias("http_status"), target.alias("target_type"))


def scan_streaks(spark, sf_dir: str) -> DataFrame:
    return failures.streaks(_log(spark, sf_dir), "user_id", ["ts", "event_id"]).select("event_id", "streak")


def repeated_failures(spark, sf_dir: str) -> DataFrame:
    rows = failures.warnings(failures.streaks(_log(spark, sf_dir), "user_id", ["ts", "event_id"]))
    return rows.select("event_id", "warning")


def ranked_findings(spark, sf_dir: str) -> DataFrame:
    """Rows of the findings table and the row that counts the others."""
    return ranking.top_with_overflow(ranking.findings(artifacts(spark, sf_dir)), 7).withColumn("pos", F.col("pos").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        hostile_files, gguf_facts, onnx_facts, numpy_headers, zip_imports, joblib_codecs, salvaged_imports, dual_use_arguments, format_properties, evasion_scorecard, evasions_caught, markdown_report,
        review_comment, report_findings, fetch_messages, error_records, upload_fields, report_icons, unstamped_texts, claimed_extensions, requirement_lines, scan_exit, scan_streaks, repeated_failures, ranked_findings,
    )
}

_NAMES, _RISKS = [x[0] for x in _hostile()], [x[2] for x in _hostile()]
_BLOCK = [f"CRITICAL (RCE Detected: {m}.{n})" if bad else "MEDIUM (Pickle Present)" for m, n, bad, _ in IMPORTS]
_FOUND = [f"CRITICAL (RCE Detected: {{0}}{m}.{n})" if bad else "MEDIUM (Pickle Present)" for m, n, bad, _ in IMPORTS]
_SIZE = len(e.stack_global_pickle("os", "system", ""))
_KINDS = "CASE p_partkey % 6 WHEN 0 THEN 'gguf' WHEN 1 THEN 'keras' WHEN 2 THEN 'onnx' WHEN 3 THEN 'numpy' WHEN 4 THEN 'joblib' ELSE 'safetensors' END"
_DIGEST = hashlib.sha256(b"{{ x.__class__ }}").hexdigest()
_FIXED = {
    "gguf": [("risk", "CRITICAL (Chat Template Code Execution: __class__)"), ("legal", "UNKNOWN"), ("gguf:quantization", "7"), ("gguf:metadata_keys", "general.architecture,general.file_type,tokenizer.chat_template"), ("gguf:chat_template", "present"), ("gguf:chat_template_length", "17"), ("gguf:chat_template_sha256", _DIGEST), ("gguf:chat_template_threat", "JINJA_SANDBOX_ESCAPE: __class__"), ("gguf:chat_template_threat_count", "1")],
    "keras": [("legal", "UNKNOWN"), ("keras:container", "zip"), ("keras:threat_count", "1"), ("keras:layer_count", "2"), ("keras:version", "3.1.0")],
    "onnx": [("risk", "MEDIUM (ONNX: 1 custom operator(s); 1 external tensor(s))"), ("legal", "UNKNOWN"), ("onnx:ir_version", "8"), ("onnx:producer_version", "1.0"), ("onnx:graph_name", "g"), ("onnx:opsets", "ai.onnx:17"), ("onnx:node_count", "2"), ("onnx:op_types", "Relu,Own"), ("onnx:custom_ops", "own.Own"), ("onnx:custom_op_count", "1"), ("onnx:external_data_location", "w.bin"), ("onnx:external_data_count", "1"), ("onnx:threat", "ONNX_EXTERNAL_DATA: w.bin"), ("onnx:threat", "ONNX_CUSTOM_OP: own.Own")],
    "numpy": [("risk", "LOW"), ("legal", "UNKNOWN"), ("pickle:opcode_count", "0"), ("pickle:container", "npy"), ("numpy:dtype", "<f8"), ("numpy:object_dtype", "false"), ("numpy:shape", "(3,)"), ("numpy:npy_version", "1.0")],
    "joblib": [("risk", "CRITICAL (RCE Detected: os.system)"), ("legal", "UNKNOWN"), ("pickle:opcode", "os.system"), ("pickle:opcode_count", "1"), ("pickle:container", "zlib"), ("joblib:compression", "zlib"), ("joblib:decompressed_bytes", str(len(e.global_pickle("os", "system"))))],
    "safetensors": [("risk", "LOW"), ("legal", "PASS"), ("safetensors:tensor_count", "2"), ("safetensors:dtypes", "F16,F32"), ("safetensors:header_keys", "__metadata__,w,v")],
}
_PROPERTIES = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{n}' AS name, '{v}' AS value" for k, pairs in _FIXED.items() for n, v in [*pairs, ("format", k)])
# The published verdict matrix.
MATRIX = {"benign-allowlisted-globals": "clean", "nullifai-7z-container": "partial", "shadowpickle-allowlist-overwrite": "partial"}
_MATRIX = ", ".join(f"('{c.case_id}', '{m}', '{MATRIX.get(c.case_id, 'detected')}')" for c in corpus.cases() for m in ("blocklist", "strict"))
_ART = """
WITH a AS (SELECT concat_ws('_', p_name, p_partkey) AS name, p_partkey AS k, p_brand AS framework, CASE p_partkey % 7 WHEN 0 THEN 'CRITICAL (RCE Detected: os.system)' WHEN 1 THEN 'MEDIUM (Pickle Present)' WHEN 2 THEN 'UNKNOWN' ELSE 'LOW' END AS risk,
  CASE p_size % 5 WHEN 0 THEN 'LEGAL RISK (cc-by-nc-4.0)' WHEN 1 THEN 'LEGAL RISK (AGPL-3.0)' WHEN 2 THEN 'UNKNOWN' ELSE 'PASS' END AS legal, CASE p_size % 5 WHEN 0 THEN 'cc-by-nc-4.0' WHEN 1 THEN 'AGPL-3.0' WHEN 2 THEN 'Unknown' ELSE 'MIT' END AS license FROM part)
"""
_FETCH = """
WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '401' WHEN 1 THEN '403' WHEN 2 THEN '404' WHEN 3 THEN '500' WHEN 4 THEN 'timeout' WHEN 5 THEN 'connection_error' ELSE 'other' END AS s,
  page_id % 4 = 0 AS hub, page_id % 2 = 0 AS token FROM pages), q AS (SELECT *, CASE WHEN hub THEN 'org/model-' || page_id ELSE page_id || '.pt' END AS name FROM p)
"""
_STREAK = """
WITH l AS (SELECT event_id, user_id, ts, event_type <> 'purchase' AS failed, CASE event_type WHEN 'view' THEN '401' ELSE '404' END AS status, CASE WHEN event_id % 3 = 0 THEN 'local' ELSE 'huggingface' END AS target FROM events),
m AS (SELECT *, last_value(CASE WHEN failed THEN target END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS known FROM l),
t AS (SELECT *, CASE WHEN failed THEN status || ' ' || target ELSE 'cleared' END AS shape FROM m WHERE failed OR known = target),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, shape ORDER BY ts, event_id) AS run FROM t),
s AS (SELECT event_id, status, failed, row_number() OVER (PARTITION BY user_id, shape, run ORDER BY ts, event_id) AS streak FROM r)
"""

ORACLE_SQL = {
    "hostile_files": f"SELECT {_pick_sql('p_partkey', _NAMES)} AS name, {_pick_sql('p_partkey', _RISKS)} AS risk_level, count(*) AS n FROM part GROUP BY ALL",
    "gguf_facts": """SELECT p_partkey || '.gguf' AS name, p_brand AS architecture, CAST(p_size AS BIGINT) AS quantization, 'mit' AS license, CAST(5 AS BIGINT) AS keys_read, 'general.architecture,general.file_type,tokens,general.license,scale' AS keys,
  CASE WHEN p_partkey % 3 = 0 THEN 'MEDIUM (GGUF metadata incomplete: 5/6 keys read)' ELSE 'LOW' END AS risk_level FROM part""",
    "onnx_facts": """SELECT p_partkey || '.onnx' AS name, CAST(8 AS BIGINT) AS ir_version, p_brand AS producer_name, '1.0' AS producer_version, p_type AS graph_name, 'ai.onnx:17,ai.onnx.ml:3' AS opsets, CAST(3 + p_partkey % 4 AS BIGINT) AS nodes, CAST(p_partkey % 4 AS BIGINT) AS subgraphs,
  CASE WHEN p_partkey % 4 = 0 THEN 'Add,Relu' ELSE 'Add,If,Relu' END AS op_types,
  CASE WHEN p_partkey % 10 = 5 THEN 'CRITICAL (ONNX External Data Escapes Model Directory: ../' || p_size || '.bin)' WHEN p_partkey % 15 = 0 THEN 'MEDIUM (ONNX: 1 custom operator(s); 1 external tensor(s))' WHEN p_partkey % 3 = 0 THEN 'MEDIUM (ONNX: 1 custom operator(s))' WHEN p_partkey % 5 = 0 THEN 'MEDIUM (ONNX: 1 external tensor(s))' ELSE 'LOW' END AS risk_level,
  concat_ws(';', CASE WHEN p_partkey % 10 = 5 THEN 'ONNX_EXTERNAL_DATA_ESCAPE: ../' || p_size || '.bin' WHEN p_partkey % 5 = 0 THEN 'ONNX_EXTERNAL_DATA: ' || p_size || '.bin' END, CASE WHEN p_partkey % 3 = 0 THEN 'ONNX_CUSTOM_OP: own.Add' END) AS threats FROM part""",
    "numpy_headers": "SELECT p_partkey || '.npy' AS name, p_partkey % 4 IN (1, 3) AS object_dtype, '(' || p_size || ', 2)' AS shape, '1.0' AS version, CASE WHEN p_partkey % 4 IN (1, 3) THEN 'MEDIUM (Pickle Present)' ELSE 'LOW' END AS risk_level FROM part",
    "zip_imports": f"SELECT {_pick_sql('p_partkey', _BLOCK)} AS risk_level, count(*) AS n FROM part GROUP BY 1",
    "joblib_codecs": f"""SELECT CASE p_partkey % 6 WHEN 1 THEN 'gzip' WHEN 2 THEN 'bz2' WHEN 3 THEN 'xz' WHEN 4 THEN 'zlib' WHEN 5 THEN 'zstd' END AS packed, CASE WHEN p_partkey % 6 BETWEEN 1 AND 4 THEN CAST({_SIZE} + strlen(p_brand) AS BIGINT) END AS unpacked_bytes,
  CASE WHEN p_partkey % 6 = 5 THEN 'MEDIUM (Unscanned Container: zstd)' ELSE 'CRITICAL (RCE Detected: os.system)' END AS risk_level, count(*) AS n FROM part GROUP BY ALL""",
    "salvaged_imports": f"""WITH b AS (SELECT unnest([false, true]) AS strict), p AS (SELECT strict, {_pick_sql('p_partkey', _FOUND)} AS risk FROM part CROSS JOIN b)
SELECT replace(risk, '{{0}}', CASE WHEN strict THEN 'UNSAFE_IMPORT: ' ELSE '' END) AS risk_level, strict, count(*) AS n FROM p GROUP BY ALL""",
    "dual_use_arguments": f"SELECT p_partkey || '.pkl' AS name, CASE WHEN {_pick_sql('p_partkey', _BAD)} THEN 'operator.' || CASE WHEN p_partkey % 2 = 0 THEN 'attrgetter' ELSE 'methodcaller' END || '(''' || {_pick_sql('p_partkey', ARGUMENTS)} || ''')' ELSE '' END AS threats FROM part",
    "artifact_properties": f"""WITH i AS (SELECT {_pick_sql('p_partkey', [f'{m}.{n}' for m, n, *_ in IMPORTS])} AS f, {_pick_sql('p_partkey', [x[2] for x in IMPORTS])} AS bad FROM part),
r AS (SELECT 'risk' AS name, CASE WHEN bad THEN 'CRITICAL (RCE Detected: ' || f || ')' ELSE 'MEDIUM (Pickle Present)' END AS value FROM i UNION ALL SELECT 'legal', 'UNKNOWN' FROM i UNION ALL SELECT 'format', 'pickle' FROM i
  UNION ALL SELECT 'pickle:opcode', f FROM i WHERE bad UNION ALL SELECT 'pickle:opcode_count', CASE WHEN bad THEN '1' ELSE '0' END FROM i UNION ALL SELECT 'pickle:container', 'bare' FROM i)
SELECT 'bracken:' || name AS name, value, count(*) AS n FROM r GROUP BY ALL""",
    "format_properties": f"""WITH p AS (SELECT {_KINDS} AS kind, p_brand FROM part), f AS ({_PROPERTIES}),
r AS (SELECT f.name, f.value FROM p JOIN f USING (kind) UNION ALL SELECT 'gguf:architecture', p_brand FROM p WHERE kind = 'gguf' UNION ALL SELECT 'onnx:producer_name', p_brand FROM p WHERE kind = 'onnx'
  UNION ALL SELECT 'keras:threat', 'KERAS_LAMBDA: ' || p_brand FROM p WHERE kind = 'keras' UNION ALL SELECT 'keras:lambda_layers', p_brand FROM p WHERE kind = 'keras' UNION ALL SELECT 'risk', 'CRITICAL (Keras Lambda Code Execution — Lambda layer(s): ' || p_brand || ')' FROM p WHERE kind = 'keras')
SELECT 'bracken:' || name AS name, value, count(*) AS n FROM r GROUP BY ALL""",
    "evasion_scorecard": f"SELECT * FROM (VALUES {_MATRIX}) t(case_id, mode, verdict)",
    "evasions_caught": f"SELECT count(DISTINCT case_id) FILTER (verdict = 'detected') AS n_caught, count(DISTINCT case_id) AS n_evasions FROM (VALUES {_MATRIX}) t(case_id, mode, verdict) WHERE case_id NOT IN ('control-os-system-zip', 'benign-allowlisted-globals')",
    "markdown_report": _ART + """SELECT row_number() OVER (ORDER BY name) AS pos, '| ' || name || ' | ' || framework || ' | ' || CASE WHEN risk LIKE 'CRITICAL%' THEN '🔴' WHEN risk LIKE 'MEDIUM%' THEN '🟡' ELSE '🟢' END || ' ' || risk || ' | ' ||
  CASE WHEN legal LIKE '%RISK%' THEN '🔴' ELSE '🟢' END || ' ' || legal || ' | ' || substr(sha256(name), 1, 8) || ' |' AS line FROM a""",
    "review_comment": _ART + f""", n AS (SELECT count(*) FILTER (risk LIKE 'CRITICAL%') AS c, count(*) FILTER (risk LIKE 'MEDIUM%') AS m, count(*) FILTER (risk = 'LOW') AS l, count(*) AS total FROM a),
w AS (SELECT 1 AS part, row_number() OVER (ORDER BY k) AS pos, '| 🔴 CRITICAL | `' || name || '` | ' || framework || ' | ' || license || ' | RCE Detected: os.system |' AS line FROM a WHERE risk LIKE 'CRITICAL%' ORDER BY k LIMIT 5)
SELECT 0 AS part, CAST(i AS BIGINT) AS pos, CASE i WHEN 0 THEN '{reports.MARKER}' WHEN 1 THEN '## Model artifact scan' WHEN 3 THEN '**Summary:** ' || c || ' CRITICAL, ' || m || ' MEDIUM, ' || l || ' LOW across ' || total || ' model artifact(s).' WHEN 5 THEN '### Findings'
  WHEN 7 THEN '| Risk | Artifact | Format | License | Issue |' WHEN 8 THEN '|------|----------|--------|---------|-------|' ELSE '' END AS line FROM n, range(9) t(i)
UNION ALL SELECT * FROM w UNION ALL SELECT 2, CAST(i AS BIGINT), CASE i WHEN 0 THEN '| … | _+ ' || (total - 5) || ' more findings: see the inventory_ | | | |' WHEN 1 THEN '' ELSE '<sub>scanned `models`: ' || total || ' artifact(s)</sub>' END FROM n, range(3) t(i)""",
    "report_findings": """SELECT s_suppkey AS pos, s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'LOW' ELSE 'UNKNOWN' END AS severity, CASE s_suppkey % 5 WHEN 0 THEN 'Legacy Binary' WHEN 3 THEN 'odd' ELSE '' END AS issue,
  CASE s_suppkey % 5 WHEN 0 THEN 'PyTorch' WHEN 3 THEN 'ONNX' ELSE '?' END AS framework, CASE s_suppkey % 5 WHEN 0 THEN 'PASS' ELSE '?' END AS legal, CASE s_suppkey % 5 WHEN 0 THEN 'MIT' ELSE 'Unknown' END AS license FROM supplier WHERE s_suppkey % 7 <> 0""",
    "fetch_messages": _FETCH + """SELECT page_id, CASE WHEN s IN ('401', '403') THEN 'Authentication failed for ' || name || CASE WHEN token THEN ' despite a token being set. Check that it is valid, may read, and that the model''s licence is accepted.' ELSE '; the model seems to be private or gated. Set HF_TOKEN to a token that may read it.' END
  WHEN s IN ('timeout', 'connection_error') THEN 'Network error reaching ' || CASE WHEN hub THEN 'huggingface.co' ELSE 'files.test' END || '. In CI, check that the firewall lets HTTPS out to the hub and its file store.'
  WHEN s = '404' THEN name || ' not found (HTTP 404); check the repository or the URL.' WHEN s = '500' THEN 'Failed to fetch ' || name || ' (HTTP 500).' ELSE 'Failed to fetch ' || name || '.' END AS message FROM q""",
    "error_records": _FETCH + "SELECT 'scan' AS command, 'HTTPError' AS error_type, s AS http_status, CASE WHEN token THEN 'true' ELSE 'false' END AS token_present, CASE WHEN hub THEN 'huggingface' ELSE 'https' END AS target_type, count(*) AS n FROM q GROUP BY ALL",
    "upload_fields": """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 2 THEN 'https://p.test/' || s_suppkey ELSE 'https://platform.test' END AS url, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'unknown' END || '-' || CASE WHEN s_suppkey % 5 = 0 THEN '2' ELSE '1' END AS run,
  CASE WHEN s_suppkey % 4 = 0 THEN 'main' END AS ref, 'status=' || (s_suppkey % 600) || ' body=''' || left(repeat(s_name, 40), 400) || '''' AS response, 'https://x.test/' || CASE WHEN s_suppkey % 2 = 0 THEN '?a=1' ELSE '' END || CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN '&ref=cli' ELSE '?ref=cli' END AS link FROM supplier""",
    "report_icons": _ART + "SELECT CASE WHEN risk LIKE 'CRITICAL%' THEN '🔴' WHEN risk LIKE 'MEDIUM%' THEN '🟡' ELSE '🟢' END AS risk, CASE WHEN legal LIKE '%RISK%' THEN '🔴' ELSE '🟢' END AS legal, CASE WHEN risk LIKE 'CRITICAL%' THEN '🔴' WHEN risk LIKE 'MEDIUM%' THEN '🟡' WHEN risk = 'LOW' THEN '🟢' ELSE '⚪' END AS severity, count(*) AS n FROM a GROUP BY ALL",
    "unstamped_texts": "SELECT conv_id, turn, '# T' || chr(10) || role || chr(10) || 'end' AS text FROM conversations",
    "claimed_extensions": "SELECT unnest(['.bin', '.dill', '.gguf', '.h5', '.hdf5', '.joblib', '.keras', '.npy', '.npz', '.onnx', '.pickle', '.pkl', '.pt', '.pth', '.safetensors']) AS extension",
    "requirement_lines": "SELECT 'alpha' AS name, s_suppkey || '.1' AS version, count(*) AS n FROM supplier GROUP BY ALL UNION ALL SELECT 'beta', '2', count(*) FROM supplier UNION ALL SELECT 'gamma', 'unknown', count(*) FROM supplier",
    "scan_exit": "SELECT * FROM (VALUES ('risk', 2), ('errors', 1), ('neither', 0), ('allowed', 0)) t(scan, exit_code)",
    "scan_streaks": _STREAK + "SELECT event_id, streak FROM s WHERE failed",
    "repeated_failures": _STREAK + "SELECT event_id, 'Your scans have hit the same error ' || streak || ' times in a row.' || CASE WHEN status = '401' THEN ' If the repository is private or gated, check HF_TOKEN and that its licence is accepted.' ELSE '' END AS warning FROM s WHERE failed AND streak >= 3",
    "ranked_findings": _ART + """, w AS (SELECT row_number() OVER (ORDER BY name) AS pos, '| CRITICAL | `' || name || '` | ' || framework || ' | RCE Detected: os.system |' AS line FROM a WHERE risk LIKE 'CRITICAL%')
SELECT * FROM w WHERE pos <= 7 UNION ALL SELECT CAST(8 AS BIGINT), '| … | + ' || (count(*) - 7) || ' more findings | | |' FROM a""",
}
