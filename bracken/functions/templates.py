"""Findings in chat templates, by patterns alone: nothing renders or parses a template."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Identifiers that lead out of a sandbox, calls that run code, objects that leak context, tags that include.
ESCAPES = "__class__ __bases__ __base__ __mro__ __subclasses__ __globals__ __builtins__ __import__ __init__ __code__ __reduce__ __getattribute__ __dict__ __loader__ __spec__".split()
CALLS = "eval exec compile getattr setattr system popen Popen check_output subprocess importlib marshal pickle breakpoint".split()
LEAKS = "self._TemplateReference__context lipsum cycler joiner".split()
INCLUSION = r"\{%-?\s*(include|extends|import|from)\b"
LONGEST = 262_144

ESCAPE, CALL, LEAK, ATTR, INCLUDES, CUT = "JINJA_SANDBOX_ESCAPE: ", "JINJA_DANGEROUS_CALL: ", "JINJA_CONTEXT_LEAK: ", "JINJA_ATTR_FILTER", "JINJA_TEMPLATE_INCLUSION: ", "JINJA_TEMPLATE_TRUNCATED: "


# What counts as a whole identifier, as a use of a name, as a comment and as a quoted text. Results follow these shapes.
def _whole(token: str) -> str:
    return rf"(?<![A-Za-z0-9_]){re.escape(token)}(?![A-Za-z0-9_])"


def _used(name: str) -> str:
    return rf"\.\s*{name}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_.]){name}\s*[(.]"


def code(template: Column) -> Column:
    """The template with comments, then quoted strings, as blanks. The loops are possessive: long literals cost no stack."""
    plain = F.regexp_replace(template, r"(?s)\{#.*?#\}", " ")
    return F.regexp_replace(plain, r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\"""", " ")


def threats(template: Column) -> Column:
    """Findings in order; null or empty: none. What lies beyond LONGEST characters is reported as not read."""
    subject = F.substring(template, 1, LONGEST)
    bare = code(subject)
    cut = F.concat(F.lit(CUT), F.char_length(template).cast("string"), F.lit(f" chars, analyzed first {LONGEST}"))
    single = [F.when(F.char_length(template) > LONGEST, cut)]
    single += [F.when(subject.rlike(_whole(t)), ESCAPE + t) for t in ESCAPES]
    single += [F.when(subject.rlike(r"\|\s*attr\s*\("), ATTR)]
    single += [F.when(bare.rlike(_used(t)), CALL + t) for t in CALLS]
    single += [F.when(bare.rlike(_whole(t.split(".")[-1])), LEAK + t) for t in LEAKS]
    tags = F.transform(F.array_distinct(F.regexp_extract_all(bare, F.lit(INCLUSION), F.lit(1))), lambda t: F.concat(F.lit(INCLUDES), t))
    return F.concat(F.array_compact(F.array(*single)), F.coalesce(tags, F.array().cast("array<string>")))


def kind(threat: Column) -> Column:
    """The finding without the `[template key] ` before it."""
    return F.when(threat.startswith("["), F.regexp_replace(threat, r"^\[.*?\] (?=.)", "")).otherwise(threat)


def critical(found: Column) -> Column:
    def bad(t: Column) -> Column:
        k = kind(t)
        return k.startswith(ESCAPE) | k.startswith(CALL) | k.startswith(LEAK) | (k == ATTR)

    return F.exists(found, bad)


def risk_label(found: Column, truncated: Column, read: Column, total: Column) -> Column:
    """The label of a GGUF file by its template findings, or by what of its keys was read."""

    def named(prefix: str) -> Column:
        return F.transform(F.filter(F.transform(found, kind), lambda k: k.startswith(prefix)), lambda k: F.substring(k, len(prefix) + 1, LONGEST))

    shown = F.array_join(F.slice(F.concat(named(ESCAPE), named(CALL)), 1, 3), ", ")
    worst = F.concat(F.lit("CRITICAL (Chat Template Code Execution: "), F.when(shown == "", "sandbox escape").otherwise(shown), F.lit(")"))
    some = F.concat(F.lit("MEDIUM (Chat Template: "), F.size(found).cast("string"), F.lit(" anomalous construct(s))"))
    part = F.format_string("MEDIUM (GGUF metadata incomplete: %d/%d keys read)", read, total)
    return F.when(critical(found), worst).when(F.size(found) > 0, some).when(truncated, part).otherwise("LOW")
