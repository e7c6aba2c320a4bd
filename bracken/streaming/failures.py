"""Counts of failures of one kind in a row, over a table or a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

#: From this many equal failures in a row on, the user is told.
WARN_FROM = 3
FINGERPRINT = ["error_type", "http_status", "target_type"]


def consecutive(log: DataFrame, key: str, fingerprint: str, order: list[str]) -> DataFrame:
    """Adds `streak`: how many rows up to here, within the key, have had the same fingerprint without a break."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.lag(fingerprint).over(w).eqNullSafe(F.col(fingerprint)), 0).otherwise(1)
    marked = log.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return marked.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order))).drop("_new", "_run")


def streaks(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The failures of a log (failed, error_type, http_status, target_type) with their `streak` within the key.

    A failure that differs from the one before starts at 1. A success clears the count if its target class is that of the
    last failure; one of another class says nothing about the failing one.
    """
    w = Window.partitionBy(key).orderBy(*order)
    last = F.last(F.when(F.col("failed"), F.col("target_type")), ignorenulls=True).over(w)
    marked = log.withColumn("_last", last)
    told = marked.where(F.col("failed") | F.col("_last").eqNullSafe(F.col("target_type")))
    shape = F.when(F.col("failed"), F.struct(*FINGERPRINT))
    new = F.when(F.col("failed") & F.lag(shape).over(w).eqNullSafe(shape), 0).otherwise(1)
    runs = told.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).where("failed")
    return runs.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order)).cast("long")).drop("_last", "_new", "_run")


def warnings(counted: DataFrame) -> DataFrame:
    """The rows whose streak reaches WARN_FROM, with what to tell."""
    text = F.format_string("Your scans have hit the same error %d times in a row.", "streak")
    hint = F.when(F.col("http_status").isin("401", "403"), " If the repository is private or gated, check HF_TOKEN and that its licence is accepted.").otherwise("")
    return counted.where(F.col("streak") >= WARN_FROM).withColumn("warning", F.concat(text, hint))


def stream(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The same counts over a stream (key, order columns, failed and the fingerprint); the state of a key is its last
    failure and its count. Rows of a key must come in order from one batch to the next; within a batch they are sorted."""
    import pandas as pd

    columns = [f for f in log.schema.fields if f.name in {key, *order, *FINGERPRINT}]
    names = [f.name for f in columns]

    def count(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = (list(state.get[:-1]), state.get[-1]) if state.exists else (None, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values(order, kind="stable").to_dict("records"):
            shape = [row[f] for f in FINGERPRINT]
            if row["failed"]:
                n = n + 1 if shape == last else 1
                last = shape
                out.append([*[row[c] for c in names], n])
            elif last and last[-1] == row["target_type"]:
                last, n = None, 0
        if last:
            state.update((*last, n))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[*names, "streak"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", streak long"
    kept = ", ".join(f"{f} string" for f in FINGERPRINT) + ", n long"
    return log.groupBy(key).applyInPandasWithState(count, schema, kept, "append", "NoTimeout")
