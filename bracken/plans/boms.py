"""Queries over inventories: artifacts are made from `part` rows, one artifact a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bracken.functions import descriptions, targets, verdicts
from bracken.operators import drift, ranking, ratchet
from bracken.streaming import failures


def artifacts(spark, sf_dir: str) -> DataFrame:
    """name, framework, risk_level, license and legal_status of each synthetic artifact."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = F.col("p_partkey") % 7
    risk = F.when(n == 0, "CRITICAL (RCE Detected: os.system)").when(n == 1, "MEDIUM (Pickle Present)").when(n == 2, "UNKNOWN").otherwise("LOW")
    licence = F.when(F.col("p_size") % 5 == 0, "cc-by-nc-4.0").when(F.col("p_size") % 5 == 1, "AGPL-3.0").when(F.col("p_size") % 5 == 2, "Unknown").otherwise("MIT")
    rows = part.select(F.concat_ws("_", "p_name", "p_partkey").alias("name"), F.col("p_brand").alias("framework"), risk.alias("risk_level"), licence.alias("license"))
    return rows.withColumn("legal_status", verdicts.legal_status("license"))


def severity_summary(spark, sf_dir: str) -> DataFrame:
    """Artifacts by severity and legal status."""
    return artifacts(spark, sf_dir).groupBy(verdicts.severity("risk_level").alias("severity"), "legal_status").agg(F.count("*").alias("n"))


QUERIES = {"severity_summary": severity_summary}
ORACLE_SQL = {
    "severity_summary": """
WITH a AS (SELECT CASE p_partkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS severity,
  CASE p_size % 5 WHEN 0 THEN 'LEGAL RISK (cc-by-nc-4.0)' WHEN 1 THEN 'LEGAL RISK (AGPL-3.0)' WHEN 2 THEN 'UNKNOWN' ELSE 'PASS' END AS legal_status FROM part)
SELECT severity, legal_status, count(*) AS n FROM a GROUP BY ALL
"""
}


def _bom(spark, sf_dir: str, new: bool) -> DataFrame:
    """Two inventories of the suppliers: some changed, some gone, some new."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").where(F.col("s_suppkey") % 11 != (3 if new else 5))
    k, moved = F.col("s_suppkey"), F.lit(new)
    version = F.when(k % 4 == 0, None).otherwise(F.concat(F.lit("1.0."), F.when(moved & (k % 3 == 0), 1).otherwise(0).cast("string")))
    risk = F.when(moved & (k % 5 == 0), "CRITICAL (Legacy Binary)").otherwise("LOW")
    licence = F.when(moved & (k % 7 == 0), "agpl-3.0").otherwise("MIT")
    text = descriptions.build(risk, F.lit("PyTorch"), verdicts.legal_status(licence), licence)
    digest = F.when(k % 6 == 0, None).otherwise(F.sha2(F.concat_ws("-", "s_name", F.when(moved & (k % 2 == 0), "b").otherwise("a")), 256))
    return s.select(k.alias("pos"), F.col("s_name").alias("name"), version.alias("version"), text.alias("description"), digest.alias("sha256"))


def bom_drift(spark, sf_dir: str) -> DataFrame:
    return drift.drift(_bom(spark, sf_dir, False), _bom(spark, sf_dir, True))


def bom_drift_flags(spark, sf_dir: str) -> DataFrame:
    return drift.flags(bom_drift(spark, sf_dir))


def report_top(spark, sf_dir: str) -> DataFrame:
    return ranking.top(ranking.findings(artifacts(spark, sf_dir)))


def scan_gate(spark, sf_dir: str) -> DataFrame:
    return ranking.gate(artifacts(spark, sf_dir))


def unique_identifiers(spark, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("name"))
    return ranking.identifiers(part, ["p_partkey"]).select("p_partkey", "spdx_id")


def target_classes(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.groupBy(targets.target_class(F.col("url")).alias("target_class")).agg(F.count("*").alias("n"))


def escaping_paths(spark, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    shown = F.when(k % 4 == 0, F.concat(F.lit("a/../../"), path)).when(k % 4 == 1, F.concat(F.lit("a/../"), path)).when(k % 4 == 2, F.concat(F.lit("/"), path)).otherwise(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", targets.path_escapes(shown).alias("escapes"))


def failure_streaks(spark, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    rows = failures.consecutive(events, "user_id", "event_type", ["ts", "event_id"])
    return rows.select("event_id", F.col("streak").cast("long").alias("streak"), targets.bucket_count(F.col("streak")).alias("bucket"))


def _matrix(spark, sf_dir: str, shift: int) -> DataFrame:
    n = (F.col("o_orderkey") + shift * (F.col("o_orderkey") % 3)) % 5
    verdict = F.when(n == 0, "missed").when(n == 1, "partial").when(n == 2, "clean").when(n == 3, "false-positive").otherwise("detected")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.lit(shift == 0) | (F.col("o_orderkey") % 13 != 0))
    return orders.select(F.col("o_orderkey").cast("string").alias("case_id"), F.when(F.col("o_orderkey") % 2 == 0, "strict").otherwise("blocklist").alias("mode"), verdict.alias("verdict"))


def ratchet_below(spark, sf_dir: str) -> DataFrame:
    return ratchet.below(_matrix(spark, sf_dir, 0), _matrix(spark, sf_dir, 1))


def ratchet_raised(spark, sf_dir: str) -> DataFrame:
    return ratchet.raised(_matrix(spark, sf_dir, 0), _matrix(spark, sf_dir, 1))


QUERIES |= {f.__name__: f for f in (bom_drift, bom_drift_flags, report_top, scan_gate, unique_identifiers, target_classes, escaping_paths, failure_streaks, ratchet_below, ratchet_raised)}

_DRIFT = """
WITH o AS (SELECT s_name AS name, s_suppkey AS k FROM supplier WHERE s_suppkey % 11 <> 5),
n AS (SELECT s_name AS name, s_suppkey AS k FROM supplier WHERE s_suppkey % 11 <> 3),
j AS (SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS kind,
  CASE WHEN n.k IS NULL THEN NULL WHEN n.k % 5 = 0 THEN 'CRITICAL' ELSE 'LOW' END AS new_risk, coalesce(o.k, n.k) AS k FROM o FULL JOIN n ON o.name = n.name),
d AS (SELECT name, kind, new_risk, kind = 'changed' AND k % 4 <> 0 AND k % 3 = 0 AS version_changed, kind = 'changed' AND k % 5 = 0 AS risk_changed,
  kind = 'changed' AND k % 7 = 0 AS legal_changed, kind = 'changed' AND k % 7 = 0 AS license_changed, kind = 'changed' AND k % 2 = 0 AND k % 6 <> 0 AS hash_changed FROM j),
r AS (SELECT * FROM d WHERE kind <> 'changed' OR version_changed OR risk_changed OR legal_changed OR license_changed OR hash_changed)
"""
_ARTIFACTS = """
WITH a AS (SELECT concat_ws('_', p_name, p_partkey) AS name, p_brand AS framework, CASE p_partkey % 7 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'UNKNOWN' ELSE 'LOW' END AS severity,
  CASE p_partkey % 7 WHEN 0 THEN 'RCE Detected: os.system' WHEN 1 THEN 'Pickle Present' ELSE '' END AS issue, CASE p_partkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS score FROM part)
"""


def _matrix_sql(name: str, shift: int) -> str:
    keep = "" if shift == 0 else " WHERE o_orderkey % 13 <> 0"
    return f"""{name} AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'strict' ELSE 'blocklist' END AS mode,
  CASE (o_orderkey + {shift} * (o_orderkey % 3)) % 5 WHEN 0 THEN 'missed' WHEN 1 THEN 'partial' WHEN 2 THEN 'clean' WHEN 3 THEN 'false-positive' ELSE 'detected' END AS verdict FROM orders{keep})"""


_RANK = "CASE WHEN {0} IN ('detected', 'clean') THEN 2 WHEN {0} = 'partial' THEN 1 ELSE 0 END"
ORACLE_SQL |= {
    "bom_drift": _DRIFT + "SELECT * FROM r",
    "bom_drift_flags": _DRIFT + "SELECT coalesce(bool_or(new_risk = 'CRITICAL' AND (kind = 'added' OR risk_changed)), false) AS risk_increased, coalesce(bool_or(hash_changed), false) AS hash_drifted, count(*) AS n_rows FROM r",
    "report_top": _ARTIFACTS + "SELECT name, severity, issue, framework FROM a ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 WHEN 'CLEAN' THEN 0 ELSE -1 END DESC, name LIMIT 10",
    "scan_gate": _ARTIFACTS + "SELECT coalesce(max(score), 0) AS highest_risk, count(*) FILTER (score = 3) AS n_critical, CASE WHEN max(score) >= 3 THEN 2 ELSE 0 END AS exit_code, CASE count(DISTINCT lower(framework)) WHEN 0 THEN 'none' WHEN 1 THEN min(lower(framework)) ELSE 'mixed' END AS model_format FROM a",
    "unique_identifiers": "SELECT p_partkey, CASE WHEN nth = 1 THEN base ELSE base || '-' || nth END AS spdx_id FROM (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS nth FROM (SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9.-]', '-', 'g') AS base FROM part))",
    "target_classes": "SELECT CASE WHEN url LIKE 'hf://%' THEN 'huggingface' WHEN url LIKE 'https://%' THEN 'https' WHEN url LIKE 'http://%' THEN 'http' ELSE 'local' END AS target_class, count(*) AS n FROM pages GROUP BY 1",
    "escaping_paths": "SELECT page_id, page_id % 4 <> 1 AS escapes FROM pages",
    "failure_streaks": """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY ts, event_id) AS streak FROM e)
SELECT event_id, streak, CASE WHEN streak < 10 THEN CAST(streak AS VARCHAR) ELSE '10+' END AS bucket FROM s""",
    "ratchet_below": f"WITH {_matrix_sql('f', 0)}, {_matrix_sql('c', 1)} SELECT f.case_id, f.mode, f.verdict AS required, coalesce(c.verdict, 'missed') AS got FROM f LEFT JOIN c USING (case_id, mode) WHERE {_RANK.format('coalesce(c.verdict, ' + chr(39) + 'missed' + chr(39) + ')')} < {_RANK.format('f.verdict')}",
    "ratchet_raised": f"WITH {_matrix_sql('f', 0)}, {_matrix_sql('c', 1)} SELECT c.case_id, c.mode, CASE WHEN f.verdict IS NOT NULL AND {_RANK.format('f.verdict')} > {_RANK.format('c.verdict')} THEN f.verdict ELSE c.verdict END AS verdict FROM c LEFT JOIN f USING (case_id, mode)",
}
