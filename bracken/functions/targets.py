"""Columns about scan targets and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def target_class(target: Column) -> Column:
    """huggingface, https, http or local, by the scheme."""
    return F.when(target.startswith("hf://"), "huggingface").when(target.startswith("https://"), "https").when(target.startswith("http://"), "http").otherwise("local")


def path_escapes(location: Column) -> Column:
    """Whether an external-data path leaves its directory: absolute, drive, URL, or deeper `..` than directories so far."""
    parts = F.filter(F.split(location, r"[\\/]+"), lambda p: ~p.isin("", "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(at: Column, part: Column) -> Column:
        depth = at["depth"] + F.when(part == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(at["least"], depth).alias("least"))

    outside = F.aggregate(parts, start, step, lambda at: at["least"] < 0)
    absolute = location.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*://|[A-Za-z]:|[\\/])")
    return F.when(location.isNull() | (location == ""), False).otherwise(absolute | outside)


def bucket_count(n: Column) -> Column:
    """The number below ten as text, else 10+."""
    return F.when(n < 10, n.cast("string")).otherwise("10+")
