"""Reports over an inventory: ranked findings, gates, model formats, unique identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bracken.functions import descriptions, verdicts


def report_rank(severity: Column) -> Column:
    """CRITICAL 4 to CLEAN 0, -1 for anything else."""
    out = F.lit(-1)
    for rank, name in enumerate(("CLEAN", "LOW", "MEDIUM", "HIGH", "CRITICAL")):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def findings(artifacts: DataFrame) -> DataFrame:
    severity = F.regexp_extract("risk_level", r"^\s*([A-Z]+)", 1)
    return artifacts.select("name", severity.alias("severity"), descriptions.issue(F.col("risk_level")).alias("issue"), "framework")


def top(found: DataFrame, n: int = 10) -> DataFrame:
    """The n worst findings; equal ones by name."""
    return found.orderBy(report_rank(F.col("severity")).desc(), "name").limit(n)


def gate(artifacts: DataFrame) -> DataFrame:
    """highest risk, critical count, exit code of a gate that fails on risk, and the model format."""
    score = verdicts.severity("risk_level")
    formats = F.countDistinct(F.lower(F.coalesce("framework", F.lit("unknown"))))
    one = F.min(F.lower(F.coalesce("framework", F.lit("unknown"))))
    return artifacts.agg(
        F.coalesce(F.max(score), F.lit(0)).alias("highest_risk"),
        F.count_if(score == 3).alias("n_critical"),
        F.when(F.max(score) >= 3, 2).otherwise(0).alias("exit_code"),
        F.when(formats == 0, "none").when(formats == 1, one).otherwise("mixed").alias("model_format"),
    )


def identifiers(artifacts: DataFrame, order: list[str]) -> DataFrame:
    """Adds `base` and `spdx_id`: the name with other characters than letters, digits, `.` and `-` as `-`, or the first free `base-2`, `base-3`.

    Rows of equal base are numbered by a window. Only families where a suffixed id may meet another row's own base
    (`x-2` beside two `x`) are settled one row after another, a family in one group.
    """
    clean = artifacts.withColumn("base", F.regexp_replace("name", r"[^A-Za-z0-9.\-]", "-"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy(*order))
    numbered = clean.withColumn("_n", nth).withColumn("spdx_id", F.when(F.col("_n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "_n"))).drop("_n")
    family = F.regexp_replace("base", r"(-\d+)+$", "")
    bases = clean.select(family.alias("_family"), "base").distinct()
    mixed = bases.groupBy("_family").count().where("count > 1").select("_family")
    marked = numbered.withColumn("_family", family)
    apart = marked.join(mixed, "_family", "left_anti").drop("_family")

    def settle(rows):
        rows = rows.sort_values(order, kind="stable")
        taken: set[str] = set()
        following: dict[str, int] = {}
        ids = []
        for base in rows["base"]:
            at, n = base, following.get(base, 2)
            while at in taken:
                at, n = f"{base}-{n}", n + 1
            following[base] = n
            taken.add(at)
            ids.append(at)
        return rows.assign(spdx_id=ids).drop(columns="_family")

    together = marked.join(mixed, "_family", "left_semi").groupBy("_family").applyInPandas(settle, numbered.schema)
    return apart.unionByName(together)


def severity_counts(found: DataFrame) -> DataFrame:
    """Findings of each severity, the worst one, and a line that names those that occur."""
    levels = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in levels]
    worst = F.coalesce(F.max_by("severity", report_rank(F.col("severity"))), F.lit("CLEAN")).alias("max_severity")
    rows = found.agg(*counts, worst)
    parts = [F.when(F.col(f"n_{s.lower()}") > 0, F.concat(F.col(f"n_{s.lower()}").cast("string"), F.lit(f" {s}"))) for s in levels]
    return rows.withColumn("summary", F.concat_ws(", ", *parts))


def top_with_overflow(found: DataFrame, n: int = 10) -> DataFrame:
    """(pos, line): the n worst findings as table rows, then one row that counts the others if there are any."""
    cell = F.format_string("| %s | `%s` | %s | %s |", "severity", "name", "framework", "issue")
    worst = found.orderBy(report_rank(F.col("severity")).desc(), "name").limit(n)
    ranked = worst.select(F.row_number().over(Window.orderBy(report_rank(F.col("severity")).desc(), "name")).alias("pos"), cell.alias("line"))
    rest = found.agg((F.count("*") - n).alias("more")).where("more > 0")
    return ranked.unionByName(rest.select(F.lit(n + 1).alias("pos"), F.format_string("| … | + %d more findings | | |", "more").alias("line")))


def failure_groups(errors: DataFrame) -> DataFrame:
    """(status, message, n): the first message of each status, with the number of further ones."""
    rows = errors.groupBy("status").agg(F.min_by("message", "pos").alias("first"), F.count("*").alias("n"))
    more = F.format_string(" (+%d more %s with the same error)", F.col("n") - 1, F.when(F.col("n") == 2, "file").otherwise("files"))
    return rows.select("status", F.concat("first", F.when(F.col("n") > 1, more).otherwise("")).alias("message"), "n")
