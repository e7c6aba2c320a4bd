"""Component descriptions `Risk: .. | Framework: .. | Legal: .. | License: ..`: built and read back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def build(risk: Column, framework: Column, legal: Column, licence: Column) -> Column:
    return F.format_string("Risk: %s | Framework: %s | Legal: %s | License: %s", risk, framework, legal, licence)


def _field(description: Column, pattern: str, missing: str) -> Column:
    got = F.trim(F.regexp_extract(F.coalesce(description, F.lit("")), pattern, 1))
    return F.when(got == "", missing).otherwise(got)


def risk(description: Column) -> Column:
    return _field(description, r"Risk:\s*([A-Z]+)", "UNKNOWN")


def licence(description: Column) -> Column:
    return _field(description, r"License:\s*([^|]+)", "Unknown")


def legal(description: Column) -> Column:
    """The status without what follows it; other texts as they are."""
    text = _field(description, r"Legal:\s*([^|]+)", "UNKNOWN")
    out = text
    for status in ("UNKNOWN", "PASS", "LEGAL RISK"):
        out = F.when(text.startswith(status), status).otherwise(out)
    return out


def issue(risk_label: Column) -> Column:
    """What stands in brackets after the severity."""
    return F.regexp_extract(risk_label, r"^\s*[A-Z]+\s*\((.+)\)", 1)
