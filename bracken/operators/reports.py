"""Reports as numbered lines: a scan in Markdown, a review comment, a scorecard. `text` joins them for one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bracken.functions import descriptions, messages
from bracken.operators import ranking

MARKER = "<!-- model-artifact-scan -->"
LONGEST = 65_000
CUT = "\n\n_…comment truncated; the whole list is in the inventory._"


def _lines(spark, lines: list[str], first: int = 0) -> DataFrame:
    return spark.createDataFrame([(0, first + i, x) for i, x in enumerate(lines)], "part int, pos long, line string")


def text(lines: DataFrame, longest: int | None = None) -> str:
    """The lines as one document, cut at `longest` characters with a note. For one report, in memory."""
    body = "\n".join(r.line for r in lines.orderBy("part", "pos").toLocalIterator())
    return body if longest is None or len(body) <= longest else body[:longest] + CUT


def markdown(artifacts: DataFrame, n_dependencies: int, order: list[str]) -> DataFrame:
    """(part, pos, line) of a table with a row an artifact, in the given order."""
    spark = artifacts.sparkSession
    head = _lines(spark, ["## Model artifact report", "", f"- Dependencies found: **{n_dependencies}**", "", "| Filename | Framework | Security Risk | Legal Risk | SHA256 Hash |", "| :--- | :--- | :--- | :--- | :--- |"])
    known = lambda c, missing: F.coalesce(F.col(c), F.lit(missing))
    risk, legal = known("risk_level", "UNKNOWN"), known("legal_status", "UNKNOWN")
    short = F.coalesce(F.nullif(F.substring("sha256", 1, 8), F.lit("")), F.lit("N/A"))
    line = F.format_string("| %s | %s | %s %s | %s %s | %s |", known("name", "?"), known("framework", "?"), messages.risk_icon(risk), risk, messages.legal_icon(legal), legal, short)
    rows = artifacts.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"), line.alias("line"))
    return head.unionByName(rows)


def findings(components: DataFrame) -> DataFrame:
    """(pos, name, severity, issue, framework, legal, license) of the models in an inventory, read back from descriptions."""
    d = F.coalesce("description", F.lit(""))
    shape = r"Risk:\s*([^|]+?)(?:\s*\|\s*Framework:\s*([^|]+?))?(?:\s*\|\s*Legal:\s*([^|]+?))?(?:\s*\|\s*License:\s*([^|]+?))?\s*$"

    def part(k: int, missing: str) -> Column:
        got = F.trim(F.regexp_extract(d, shape, k))
        return F.when(got == "", missing).otherwise(got)

    risk = part(1, "UNKNOWN")
    level = F.regexp_extract(risk, r"^([A-Z]+)", 1)
    rows = components.where(F.col("type") == "machine-learning-model")
    return rows.select(
        "pos", F.coalesce("name", F.lit("?")).alias("name"), F.when(level == "", "UNKNOWN").otherwise(level).alias("severity"),
        F.when(level == "", risk).otherwise(descriptions.issue(risk)).alias("issue"), part(2, "?").alias("framework"), part(3, "?").alias("legal"), part(4, "Unknown").alias("license"),
    )


def review(found: DataFrame, directory: str, n_components: int, most: int = 20, link: str | None = None) -> DataFrame:
    """(part, pos, line) of a review comment: a table of the worst `most` findings if any is CRITICAL or HIGH, else a line.

    Equal severities stand in the order of `pos`. Only the counts and those rows are looked at together.
    """
    spark = found.sparkSession
    r = ranking.severity_counts(found).withColumn("n", F.lit(0)).first()
    total = found.count()
    tail = ([f"[View the inventory]({link})", ""] if link else []) + [f"<sub>scanned `{directory}`: {n_components} artifact(s)</sub>"]
    head = [MARKER, "## Model artifact scan", ""]
    if r.max_severity not in ("CRITICAL", "HIGH"):
        return _lines(spark, [*head, f"✅ No CRITICAL or HIGH risks in {n_components} scanned artifact(s).", "", *tail])
    head += [f"**Summary:** {r.summary} across {total} model artifact(s).", "", "### Findings", "", "| Risk | Artifact | Format | License | Issue |", "|------|----------|--------|---------|-------|"]
    rank = ranking.report_rank(F.col("severity")).desc()
    worst = found.orderBy(rank, "pos").limit(most)
    issue = F.when(F.col("issue") != "", F.col("issue")).otherwise(F.col("legal"))
    line = F.format_string("| %s %s | `%s` | %s | %s | %s |", messages.severity_icon(F.col("severity")), "severity", "name", "framework", "license", issue)
    rows = worst.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(rank, "pos")).cast("long").alias("pos"), line.alias("line"))
    more = [f"| … | _+ {total - most} more findings: see the inventory_ | | | |"] if total > most else []
    end = _lines(spark, [*more, "", *tail]).withColumn("part", F.lit(2))
    return _lines(spark, head).unionByName(rows).unionByName(end)


# How a verdict is shown.
VERDICTS = {"detected": "✅ detected", "partial": "⚠️ partial", "missed": "❌ missed", "clean": "✅ clean", "false-positive": "❌ false positive"}


def caught(wide: DataFrame) -> DataFrame:
    """(n_caught, n_evasions) of cases that are no controls: named in at least one mode."""
    hit = (F.col("blocklist") == "detected") | (F.col("strict") == "detected")
    return wide.where("evasion_class <> 'control'").agg(F.count_if(hit).alias("n_caught"), F.count("*").alias("n_evasions"))


def wide(cases: DataFrame, matrix: DataFrame) -> DataFrame:
    """A case a row, with the verdict of each mode."""
    by = matrix.groupBy("case_id").agg(*[F.max(F.when(F.col("mode") == m, F.col("verdict"))).alias(m) for m in ("blocklist", "strict")])
    return cases.join(by, "case_id", "left")


def scorecard(cases: DataFrame, matrix: DataFrame) -> DataFrame:
    """(part, pos, line) of the scorecard; a case's limitation is told while neither mode catches it."""
    spark = cases.sparkSession
    rows = wide(cases, matrix)
    n = caught(rows).first()
    shown = lambda c: F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])[F.col(c)]
    head = _lines(spark, ["# Pickle evasion scorecard", "", f"{messages.STAMP} the scorecard; do not edit by hand._", "", f"**{n.n_caught} of {n.n_evasions}** evasion cases are caught in at least one mode.", "", "| Case | Evasion class | Blocklist | Strict |", "| --- | --- | --- | --- |"])
    line = F.format_string("| `%s`<br>%s | %s | %s | %s |", "case_id", "title", "evasion_class", shown("blocklist"), shown("strict"))
    control = F.col("evasion_class") == "control"
    table = rows.where(~control).select(F.lit(1).alias("part"), F.col("pos").cast("long").alias("pos"), line.alias("line"))
    middle = _lines(spark, ["", "## Controls", "", "| Case | Evasion class | Blocklist | Strict |", "| --- | --- | --- | --- |"]).withColumn("part", F.lit(2))
    controls = rows.where(control).select(F.lit(3).alias("part"), F.col("pos").cast("long").alias("pos"), line.alias("line"))
    missed = (F.col("blocklist") != "detected") & (F.col("strict") != "detected") & F.col("limitation").isNotNull()
    notes = rows.where(missed).select(F.lit(4).alias("part"), F.col("pos").cast("long").alias("pos"), F.format_string("\n### `%s`\n\n**Current limitation:** %s", "case_id", "limitation").alias("line"))
    return head.unionByName(table).unionByName(middle).unionByName(controls).unionByName(notes)


def matrix_json(matrix: DataFrame) -> str:
    """The matrix as JSON with sorted keys, for a baseline or a floor file."""
    import json

    out: dict = {}
    for r in matrix.toLocalIterator():
        out.setdefault(r.case_id, {})[r.mode] = r.verdict
    return json.dumps({"cases": out}, indent=2, sort_keys=True) + "\n"
