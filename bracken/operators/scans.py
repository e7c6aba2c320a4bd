"""Whole scans of a target: its artifacts, its dependencies, what went wrong, and the exit code of a gate."""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from bracken.functions import containers, messages, verdicts
from bracken.operators import corpus, drift, inspect
from bracken.sources import files, remote


class Scan(NamedTuple):
    artifacts: DataFrame
    dependencies: DataFrame
    errors: DataFrame  # file, error, kind: target, fetch, read or unclaimed


def _errors(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "file string, error string, kind string")


def scan(spark, target: str, strict: bool = False, every_member: bool = False, lint: bool = False, hub: str = remote.HUB) -> Scan:
    """Scans a folder, a file, an hf:// repository or an http(s) address.

    A target that is missing or no regular file, a named file that nothing claims, and files that cannot be read or fetched
    are rows of `errors`. lint: keep the findings of a weights-only load; else they are empty.
    """
    far = target.startswith(("hf://", "http://", "https://"))
    if not far and not os.path.isfile(target) and not os.path.isdir(target):
        empty = spark.createDataFrame([], "path string, content binary")
        why = "not a regular file or directory" if os.path.lexists(target) else "no such file or directory"
        return Scan(inspect.scan(empty), inspect.dependencies(empty), _errors(spark, [(target, why, "target")]))
    read = remote.hub_files(spark, [target], hub) if far else files.artifact_files(spark, target)
    return of_files(read, target if not far and os.path.isfile(target) else None, strict, every_member, lint, far)


def of_files(read: DataFrame, named: str | None = None, strict: bool = False, every_member: bool = False, lint: bool = False, far: bool = False) -> Scan:
    """Scans rows of path, content and perhaps cut, sha256 and error. named: one file that must be claimed."""
    spark = read.sparkSession
    sound = read.where("error IS NULL") if "error" in read.columns else read
    found = inspect.judge(inspect.facts(sound, every_member), strict)
    if not lint:
        found = found.withColumn("lint", F.array().cast(found.schema["lint"].dataType))
    errors = _errors(spark, [])
    if "error" in read.columns:
        why = messages.fetch_failure(F.col("error"), F.col("path"), F.lit(remote.token() is not None)) if far else F.col("error")
        errors = read.where("error IS NOT NULL").select(F.col("path").alias("file"), why.alias("error"), F.lit("fetch" if far else "read").alias("kind"))
    if named is not None:
        unclaimed = sound.where(~F.coalesce(containers.route(F.col("path")) == "requirements", F.lit(False))).join(found.select("path"), "path", "left_anti")
        errors = errors.unionByName(unclaimed.select(F.col("path").alias("file"), F.lit("unsupported file type").alias("error"), F.lit("unclaimed").alias("kind")))
    return Scan(found, inspect.dependencies(sound), errors)


def exit_code(artifacts: DataFrame, errors: DataFrame, fail_on_risk: bool = True) -> DataFrame:
    """exit_code: 2 if a risk is critical and that is to fail, else 1 if anything went wrong, else 0."""
    worst = artifacts.agg(F.coalesce(F.max(verdicts.severity("risk_level")), F.lit(0)).alias("worst"))
    wrong = errors.agg(F.count("*").alias("wrong"))
    code = F.when(F.lit(fail_on_risk) & (F.col("worst") >= 3), 2).when(F.col("wrong") > 0, 1).otherwise(0)
    return worst.crossJoin(wrong).select(code.alias("exit_code"))  # one row each


def diff(spark, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Drift rows and gate flags of two inventory files."""
    rows = drift.drift(files.bom(spark, old), files.bom(spark, new))
    return rows, drift.flags(rows)


def scorecard(spark) -> DataFrame:
    """(case_id, mode, verdict) of the labelled corpus."""
    return corpus.score(corpus.table(spark))
