"""Verdict columns: severity of a risk label, legal status of a licence, drift risk, hash checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The licences that restrict use, matched anywhere in the lower-cased name.
RESTRICTED = ["non-commercial", "cc-by-nc", "agpl", "commons clause"]


def severity(label: Column | str) -> Column:
    """3 critical, 2 medium, 1 low, 0 anything else: the first word found decides."""
    text = F.upper(F.coalesce(F.col(label) if isinstance(label, str) else label, F.lit("")))
    return F.when(text.contains("CRITICAL"), 3).when(text.contains("MEDIUM"), 2).when(text.contains("LOW"), 1).otherwise(0)


def legal_status(licence: Column | str) -> Column:
    """UNKNOWN, PASS or LEGAL RISK (name)."""
    name = F.col(licence) if isinstance(licence, str) else licence
    bad = F.lit(False)
    for word in RESTRICTED:
        bad = bad | F.lower(name).contains(word)
    return F.when(name.isNull() | name.isin("", "Unknown"), "UNKNOWN").when(bad, F.concat(F.lit("LEGAL RISK ("), name, F.lit(")"))).otherwise("PASS")
