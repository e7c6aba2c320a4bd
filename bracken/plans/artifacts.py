"""Queries over model files made of table rows: encoded in columns, read back by the decoders, judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bracken.functions import containers, rules, templates
from bracken.operators import documents, inspect, ranking

# module, name, sink, safe in strict mode
IMPORTS = [
    ("os", "system", True, False), ("torch._utils", "_rebuild_tensor_v2", False, True), ("asyncio.unix_events", "run", True, False), ("collections", "OrderedDict", False, True),
    ("ctypes.util", "CDLL", True, False), ("builtins", "len", False, False), ("builtins", "dict", False, True), ("mylib.models", "Net", False, False),
    ("numpy.core", "run", False, False), ("_codecs", "encode", False, True), ("dill", "loads", True, False), ("pip._internal.cli.main", "main", True, False), ("joblib.parallel", "Parallel", False, False),
]


def _pick(key: str, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(key: str, values: list) -> str:
    shown = [f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).lower() for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)) + " END"


def _part(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _pickle_files(spark, sf_dir: str) -> DataFrame:
    module, name = _pick("p_partkey", [i[0] for i in IMPORTS]), _pick("p_partkey", [i[1] for i in IMPORTS])
    text = F.concat(F.lit("c"), module, F.lit("\n"), name, F.lit("\n(S'"), F.regexp_replace("p_name", r"['\\]", ""), F.lit("'\ntR."))
    return _part(spark, sf_dir).select(F.concat(F.col("p_partkey").cast("string"), F.lit(".pkl")).alias("path"), F.encode(text, "UTF-8").alias("content"))


def _scan_imports(spark, sf_dir: str, strict: bool) -> DataFrame:
    return inspect.scan(_pickle_files(spark, sf_dir), strict).groupBy("risk_level").agg(F.count("*").alias("n"))


def pickle_blocklist(spark, sf_dir: str) -> DataFrame:
    return _scan_imports(spark, sf_dir, False)


def pickle_strict(spark, sf_dir: str) -> DataFrame:
    return _scan_imports(spark, sf_dir, True)


def pickle_lint(spark, sf_dir: str) -> DataFrame:
    rows = inspect.facts(_pickle_files(spark, sf_dir)).select("path", F.explode("lint").alias("l"))
    return rows.select("path", "l.severity", "l.message")


def import_rules(spark, sf_dir: str) -> DataFrame:
    """The judgement of each import alone."""
    rows = _part(spark, sf_dir).select("p_partkey", _pick("p_partkey", [i[0] for i in IMPORTS]).alias("m"), _pick("p_partkey", [i[1] for i in IMPORTS]).alias("n"))
    return rows.select("p_partkey", rules.dangerous(F.col("m"), F.col("n")).alias("dangerous"), rules.safe(F.col("m"), F.col("n")).alias("safe"))


NAMES = ["a.pt", "b.PTH", "c.bin", "d.safetensors", "e.gguf", "f.keras", "g.h5", "h.onnx", "i.npz", "requirements.txt", "j.txt", "noext"]
ROUTED = ["pytorch", "pytorch", "pytorch", "safetensors", "gguf", "keras", "keras", "onnx", "variant", "requirements", "none", "none"]


def routed_files(spark, sf_dir: str) -> DataFrame:
    kind = F.coalesce(containers.route(_pick("p_partkey", NAMES)), F.lit("none"))
    return _part(spark, sf_dir).groupBy(kind.alias("inspector")).agg(F.count("*").alias("n"))


MAGICS = ["377ABCAF271C00", "526172211A0700", "FD377A585A0000", "28B52FFD00", "425A6839", "1F8B0800", "04224D1800", "894C5A4F00", "789C0000", "504B0304", "5D0000800000"]
MAGIC_NAMES = ["7z", "rar", "xz", "zstd", "bzip2", "gzip", "lz4", "lzo", "none", "none", "none"]
PACKED = ["none", "none", "xz", "zstd", "bz2", "gzip", "lz4", "none", "zlib", "none", "lzma"]


def container_magics(spark, sf_dir: str) -> DataFrame:
    head = F.unhex(_pick("p_partkey", MAGICS))
    none = F.lit("none")
    return _part(spark, sf_dir).select("p_partkey", F.coalesce(containers.container(head), none).alias("container"), F.coalesce(containers.compression(head)["label"], none).alias("compression"))


def safetensors_headers(spark, sf_dir: str) -> DataFrame:
    """License and legal status of SafeTensors files with one tensor a part."""
    head = F.concat(F.lit('{"__metadata__":{"license":"'), _pick("p_size", ["mit", "cc-by-nc-4.0", "apache-2.0"]), F.lit('"},"'), F.col("p_brand"), F.lit('":{"dtype":"'), _pick("p_partkey", ["F32", "F16"]), F.lit('","shape":[1],"data_offsets":[0,0]}}'))
    size = F.unhex(F.rpad(F.lpad(F.hex(F.length(head)), 2, "0"), 16, "0"))
    files = _part(spark, sf_dir).select(F.concat(F.col("p_partkey").cast("string"), F.lit(".safetensors")).alias("path"), F.concat(size, F.encode(head, "UTF-8")).alias("content"))
    rows = inspect.scan(files)
    return rows.select("name", "license", "legal_status", "tensors", F.array_join("dtypes", ",").alias("dtypes"), "risk_level")


SNIPPETS = ["{{ bos_token }}", "{{ x.__class__ }}", "{% if message['role'] == 'system' %}", "{{ os.system('x') }}", "{{ x|attr('y') }}", "{% include 'f' %}", "{{ lipsum }}", "{# eval( #}", "{{ ''.__class__.__mro__ }}"]
SNIPPET_THREATS = ["", templates.ESCAPE + "__class__", "", templates.CALL + "system", templates.ATTR, templates.INCLUDES + "include", templates.LEAK + "lipsum", "", templates.ESCAPE + "__class__;" + templates.ESCAPE + "__mro__"]
SNIPPET_CRITICAL = [False, True, False, True, True, False, True, False, True]


def template_threats(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("k", F.col("conv_id") + F.col("turn"))
    found = templates.threats(F.concat_ws(" ", _pick("k", SNIPPETS), F.concat(F.lit("{# "), "role", F.lit(" #}"))))
    return turns.select("conv_id", "turn", F.array_join(found, ";").alias("threats"), templates.critical(found).alias("critical"))


CONFIGS = ['{"class_name":"Sequential","config":{"layers":[]}}', '{"class_name":"Lambda","config":{"name":"L"}}', '{"config":{"layers":[{"class_name":" LAMBDA "}]}}', '{"a":{"class_name":"__lambda__"}}', '{"a":["4wAAAAAAAAAAAAAAAAAAAAAAAAAA"]}']
CONFIG_THREATS = ["", "KERAS_LAMBDA: L", "KERAS_LAMBDA: config.layers[0]", "KERAS_SERIALIZED_LAMBDA: a", "KERAS_MARSHALLED_CODE: a[0]"]


def keras_configs(spark, sf_dir: str) -> DataFrame:
    """Findings in configurations that are stored as attributes of HDF5 files."""
    content = F.concat(F.unhex(F.lit("894844460D0A1A0A")), F.encode(F.concat(F.lit("model_config"), _pick("p_partkey", CONFIGS)), "UTF-8"))
    files = _part(spark, sf_dir).select(F.concat(F.col("p_partkey").cast("string"), F.lit(".h5")).alias("path"), content.alias("content"))
    return inspect.scan(files).select("name", F.array_join("threats", ";").alias("threats"))


BASE64 = ["4wAAAAAAAAAAAAAAAAAAAAAAAAAA", "YwAAAAAAAAAAAAAAAAAAAAAAAAAA", "AAAAAAAAAAAAAAAAAAAAAAAAAAAA", "4wAAAAAAAAAAAAAAAAAAAAAAAAA", "4wAA", "not base64 at all, not at all"]


def marshalled_code(spark, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", containers.marshalled(_pick("p_partkey", BASE64)).alias("marshalled"))


def failed_fetches(spark, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    kind = F.when(n < 2, "http").when(n == 2, "timeout").when(n == 3, "connection").otherwise("parse")
    status = containers.fetch_status(kind, F.when(n == 0, 404).when((n == 1) & (F.col("user_id") % 2 == 0), 401))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(status.alias("status"), F.concat(F.lit("failed "), F.col("event_id").cast("string")).alias("message"), F.col("event_id").alias("pos"))
    return ranking.failure_groups(rows)


def severity_totals(spark, sf_dir: str) -> DataFrame:
    from bracken.plans.boms import artifacts

    return ranking.severity_counts(ranking.findings(artifacts(spark, sf_dir)))


def case_verdicts(spark, sf_dir: str) -> DataFrame:
    """Verdicts of cases of several artifacts."""
    n = F.col("l_partkey") % 3
    risk = F.when(n == 0, "LOW").when(n == 1, "MEDIUM (Pickle Present)").otherwise(F.when(F.col("l_suppkey") % 2 == 0, "CRITICAL (RCE Detected: os.system)").otherwise("LOW"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("case_id"), risk.alias("risk_level"), (F.col("l_orderkey") % 2 == 0).alias("malicious"))
    return inspect.classify(rows, "case_id", "malicious")


def artifact_properties(spark, sf_dir: str) -> DataFrame:
    rows = documents.properties(inspect.scan(_pickle_files(spark, sf_dir)))
    return rows.groupBy("name", "value").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        pickle_blocklist, pickle_strict, pickle_lint, import_rules, routed_files, container_magics, safetensors_headers, template_threats,
        keras_configs, marshalled_code, failed_fetches, severity_totals, case_verdicts, artifact_properties,
    )
}

_BLOCK = [f"CRITICAL (RCE Detected: {m}.{n})" if bad else "MEDIUM (Pickle Present)" for m, n, bad, _ in IMPORTS]
_STRICT = ["MEDIUM (Pickle Present)" if ok else f"CRITICAL (RCE Detected: UNSAFE_IMPORT: {m}.{n})" for m, n, _, ok in IMPORTS]
_FOREIGN = [m.split(".")[0] not in ("torch", "numpy", "collections", "builtins", "copyreg", "datetime", "_codecs") for m, *_ in IMPORTS]

ORACLE_SQL = {
    "pickle_blocklist": f"SELECT {_pick_sql('p_partkey', _BLOCK)} AS risk_level, count(*) AS n FROM part GROUP BY 1",
    "pickle_strict": f"SELECT {_pick_sql('p_partkey', _STRICT)} AS risk_level, count(*) AS n FROM part GROUP BY 1",
    "pickle_lint": f"""
SELECT p_partkey || '.pkl' AS path, 'WARNING' AS severity, 'Arbitrary Execution Risk: Found REDUCE opcode.' AS message FROM part
UNION ALL SELECT p_partkey || '.pkl', 'ERROR', 'Custom Class Import Detected: ' || {_pick_sql('p_partkey', [f'{i[0]}.{i[1]}' for i in IMPORTS])} FROM part WHERE {_pick_sql('p_partkey', _FOREIGN)}""",
    "import_rules": f"SELECT p_partkey, {_pick_sql('p_partkey', [i[2] for i in IMPORTS])} AS dangerous, {_pick_sql('p_partkey', [i[3] for i in IMPORTS])} AS safe FROM part",
    "routed_files": f"SELECT {_pick_sql('p_partkey', ROUTED)} AS inspector, count(*) AS n FROM part GROUP BY 1",
    "container_magics": f"SELECT p_partkey, {_pick_sql('p_partkey', MAGIC_NAMES)} AS container, {_pick_sql('p_partkey', PACKED)} AS compression FROM part",
    "safetensors_headers": f"""SELECT p_partkey || '.safetensors' AS name, {_pick_sql('p_size', ['mit', 'cc-by-nc-4.0', 'apache-2.0'])} AS license,
  {_pick_sql('p_size', ['PASS', 'LEGAL RISK (cc-by-nc-4.0)', 'PASS'])} AS legal_status, CAST(1 AS BIGINT) AS tensors, {_pick_sql('p_partkey', ['F32', 'F16'])} AS dtypes, 'LOW' AS risk_level FROM part""",
    "template_threats": f"SELECT conv_id, turn, {_pick_sql('(conv_id + turn)', SNIPPET_THREATS)} AS threats, {_pick_sql('(conv_id + turn)', SNIPPET_CRITICAL)} AS critical FROM conversations",
    "keras_configs": f"SELECT p_partkey || '.h5' AS name, {_pick_sql('p_partkey', CONFIG_THREATS)} AS threats FROM part",
    "marshalled_code": f"SELECT p_partkey, p_partkey % {len(BASE64)} < 2 AS marshalled FROM part",
    "failed_fetches": """
WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '404' WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN '401' ELSE 'other' END WHEN 2 THEN 'timeout' WHEN 3 THEN 'connection_error' ELSE 'other' END AS status FROM events)
SELECT status, 'failed ' || min(event_id) || CASE count(*) WHEN 1 THEN '' WHEN 2 THEN ' (+1 more file with the same error)' ELSE ' (+' || (count(*) - 1) || ' more files with the same error)' END AS message, count(*) AS n FROM e GROUP BY status""",
    "severity_totals": """
WITH s AS (SELECT CASE p_partkey % 7 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE 1 END AS r FROM part),
c AS (SELECT count(*) FILTER (r = 4) AS a, count(*) FILTER (r = 2) AS b, count(*) FILTER (r = 1) AS d, max(r) AS m FROM s)
SELECT a AS n_critical, CAST(0 AS BIGINT) AS n_high, b AS n_medium, d AS n_low, CASE m WHEN 4 THEN 'CRITICAL' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' WHEN -1 THEN 'UNKNOWN' ELSE 'CLEAN' END AS max_severity,
  concat_ws(', ', CASE WHEN a > 0 THEN a || ' CRITICAL' END, CASE WHEN b > 0 THEN b || ' MEDIUM' END, CASE WHEN d > 0 THEN d || ' LOW' END) AS summary FROM c""",
    "case_verdicts": """
WITH a AS (SELECT l_orderkey AS case_id, l_partkey % 3 = 2 AND l_suppkey % 2 = 0 AS named, l_partkey % 3 = 1 AS warned FROM lineitem)
SELECT case_id, CASE WHEN case_id % 2 <> 0 THEN CASE WHEN bool_or(named) THEN 'false-positive' ELSE 'clean' END
  WHEN bool_or(named) THEN 'detected' WHEN bool_or(warned) THEN 'partial' ELSE 'missed' END AS verdict FROM a GROUP BY case_id""",
}
