"""Drift between two inventories: a full outer join of their components by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bracken.functions import descriptions


def _last(bom: DataFrame) -> DataFrame:
    """One component a name: the last in document order (`pos`)."""
    cols = [c for c in bom.columns if c not in ("name", "pos")]
    return bom.groupBy("name").agg(F.max_by(F.struct(*cols), "pos").alias("c")).select("name", "c.*")


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed, added and removed components of (pos, name, version, description, sha256) inventories.

    A hash counts as changed only if both sides have one; a missing version reads `unknown`. Equal components are left out.
    """

    def side(bom: DataFrame, tag: str) -> DataFrame:
        d = F.col("description")
        return _last(bom).select(
            "name",
            F.lit(True).alias(f"in_{tag}"),
            F.coalesce("version", F.lit("unknown")).alias(f"{tag}_version"),
            F.coalesce("sha256", F.lit("")).alias(f"{tag}_hash"),
            descriptions.risk(d).alias(f"{tag}_risk"),
            descriptions.legal(d).alias(f"{tag}_legal"),
            descriptions.licence(d).alias(f"{tag}_license"),
        )

    both = side(old, "old").join(side(new, "new"), "name", "full")
    differ = {k: F.col(f"old_{k}") != F.col(f"new_{k}") for k in ("version", "risk", "legal", "license")}
    differ["hash"] = (F.col("old_hash") != F.col("new_hash")) & (F.col("old_hash") != "") & (F.col("new_hash") != "")
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    changed = both.withColumn("kind", kind).select("name", "kind", "new_risk", *[(F.coalesce(v, F.lit(False)) & (F.col("kind") == "changed")).alias(f"{k}_changed") for k, v in differ.items()])
    return changed.where("kind <> 'changed' OR version_changed OR risk_changed OR legal_changed OR license_changed OR hash_changed")


def flags(rows: DataFrame) -> DataFrame:
    """risk_increased: a component that came or changed its risk is now CRITICAL; hash_drifted: any hash changed."""
    risen = (F.col("new_risk") == "CRITICAL") & ((F.col("kind") == "added") | F.col("risk_changed"))
    return rows.agg(F.coalesce(F.bool_or(risen), F.lit(False)).alias("risk_increased"), F.coalesce(F.bool_or("hash_changed"), F.lit(False)).alias("hash_drifted"), F.count("*").alias("n_rows"))
