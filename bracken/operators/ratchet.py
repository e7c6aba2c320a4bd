"""A floor under a matrix of verdicts: it can be raised, and what falls below it is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rank(verdict: Column) -> Column:
    """detected and clean 2, partial 1, anything else 0."""
    return F.when(verdict.isin("detected", "clean"), 2).when(verdict == "partial", 1).otherwise(0)


def below(floor: DataFrame, current: DataFrame) -> DataFrame:
    """(case_id, mode, required, got) of verdicts that rank below the floor; a verdict that is gone reads `missed`."""
    now = current.select("case_id", "mode", F.col("verdict").alias("got"))
    both = floor.select("case_id", "mode", F.col("verdict").alias("required")).join(now, ["case_id", "mode"], "left")
    return both.withColumn("got", F.coalesce("got", F.lit("missed"))).where(rank(F.col("got")) < rank(F.col("required")))


def raised(floor: DataFrame, current: DataFrame) -> DataFrame:
    """The new floor: the better verdict of each case and mode of the current matrix, the current one on a tie."""
    old = floor.select("case_id", "mode", F.col("verdict").alias("old"))
    both = current.join(old, ["case_id", "mode"], "left")
    keep = F.col("old").isNotNull() & (rank(F.col("old")) > rank(F.col("verdict")))
    return both.select("case_id", "mode", F.when(keep, F.col("old")).otherwise(F.col("verdict")).alias("verdict"))
