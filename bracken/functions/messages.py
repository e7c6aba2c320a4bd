"""Texts and small records about scans: failed fetches, icons, links, uploads. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bracken.functions import targets

STAMP = "_Generated by"


def _subject(url: Column) -> Column:
    """What a fetch was for: the repository of a hub target, else the last part of the path, else the whole."""
    repo = F.regexp_replace(url, "^hf://", "")
    last = F.regexp_extract(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"([^/]+)/*$", 1)
    name = F.when(url.startswith("hf://"), repo).otherwise(last)
    return F.when(name == "", url).otherwise(name)


def _host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(url.startswith("hf://"), "huggingface.co").when(host == "", "the remote host").otherwise(host)


def fetch_failure(status: Column, url: Column, token: Column) -> Column:
    """What to tell about a failed fetch, by its status bucket and by whether a token was set."""
    name = _subject(url)
    refused = F.when(token, F.concat(F.lit("Authentication failed for "), name, F.lit(" despite a token being set. Check that it is valid, may read, and that the model's licence is accepted."))).otherwise(
        F.concat(F.lit("Authentication failed for "), name, F.lit("; the model seems to be private or gated. Set HF_TOKEN to a token that may read it."))
    )
    network = F.concat(F.lit("Network error reaching "), _host(url), F.lit(". In CI, check that the firewall lets HTTPS out to the hub and its file store."))
    gone = F.concat(name, F.lit(" not found (HTTP 404); check the repository or the URL."))
    other = F.concat(F.lit("Failed to fetch "), name, F.when(status.rlike(r"\A[0-9]+\z"), F.concat(F.lit(" (HTTP "), status, F.lit(")"))).otherwise(""), F.lit("."))
    return F.when(status.isin("401", "403"), refused).when(status.isin("timeout", "connection_error"), network).when(status == "404", gone).otherwise(other)


def error_record(kind: Column, status: Column, token: Column, target: Column) -> Column:
    """STRUCT of few values about a failure: never a URL, a name or a body."""
    return F.struct(F.lit("scan").alias("command"), kind.alias("error_type"), status.alias("http_status"), F.when(token, "true").otherwise("false").alias("token_present"), targets.target_class(target).alias("target_type"))


def with_reference(url: Column, opted_out: Column) -> Column:
    """The link with where it was followed from, unless the user opted out."""
    return F.when(opted_out, url).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("ref=cli")))


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def platform_url(url: Column, default: str) -> Column:
    """The address without blanks around it and slashes at its end; the default if there is none."""
    return F.coalesce(F.regexp_replace(_filled(url), "/+$", ""), F.lit(default))


def run_id(run: Column, attempt: Column) -> Column:
    return F.concat_ws("-", F.coalesce(F.nullif(run, F.lit("")), F.lit("unknown")), F.coalesce(F.nullif(attempt, F.lit("")), F.lit("1")))


def scanned_ref(name: Column) -> Column:
    """The branch or tag, null if there is none."""
    return _filled(name)


def response(status: Column, body: Column) -> Column:
    """A response in one line: its status and the first 400 characters."""
    return F.concat(F.lit("status="), status.cast("string"), F.lit(" body='"), F.substring(F.coalesce(body, F.lit("")), 1, 400), F.lit("'"))


def risk_icon(label: Column) -> Column:
    text = F.upper(F.coalesce(label, F.lit("")))
    return F.when(text.contains("CRITICAL") | text.contains("HIGH"), "🔴").when(text.contains("MEDIUM"), "🟡").otherwise("🟢")


def legal_icon(status: Column) -> Column:
    return F.when(F.upper(F.coalesce(status, F.lit(""))).contains("RISK"), "🔴").otherwise("🟢")


def severity_icon(severity: Column) -> Column:
    """One icon for each level of a report; unknown levels have their own."""
    return F.when(severity == "CRITICAL", "🔴").when(severity == "HIGH", "🟠").when(severity == "MEDIUM", "🟡").when(severity.isin("LOW", "CLEAN"), "🟢").otherwise("⚪")


def without_stamp(text: Column) -> Column:
    """The text without the lines that say what generated it, and without white space around it."""
    kept = F.filter(F.split(text, r"\r\n|\r|\n"), lambda line: ~line.startswith(STAMP))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\A\s+|\s+\z", "")
