"""Column expressions shared by the extraction and complexity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Fixed value: tokens that add a path through a function of the C family.
DECISIONS = r"\b(if|for|while|case|catch)\b|&&|\|\||\?"
_NOISE = r"(?s)/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"


def normalize_signature(c):
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def doc_line(c):
    """The first line of a comment that is not empty without its marks."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[\\s\\p{Z}]", " "), "^ *(/\\*+|\\*+/|///?|\\*|#+) ?", ""), " *\\*+/ *$", ""), "^ +| +$", ""))
    return F.get(F.filter(lines, lambda x: x != ""), F.lit(0))


def symbol_hash(file, name, kind, signature, qualifier, nth):
    """16 hex digits of SHA-1 over the NUL-joined parts; a repeat of all parts gets ``#n``."""
    nul = F.char(F.lit(0))
    tail = F.concat(F.coalesce(qualifier, F.lit("")), F.when(nth > 1, F.concat(F.lit("#"), nth.cast("string"))).otherwise(""))
    base = F.concat(file, nul, name, nul, kind, nul, signature)
    return F.substring(F.sha1(F.when(tail == "", base).otherwise(F.concat(base, nul, tail))), 1, 16)


def code_slice(content, start, end):
    """Lines start..end (from 1) of a text."""
    return F.array_join(F.slice(F.split(content, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def cyclomatic(code):
    """1 + decisions, outside strings and comments; null where trivial, at most 999."""
    n = F.least(F.lit(999), 1 + F.regexp_count(F.regexp_replace(code, _NOISE, " "), F.lit(DECISIONS)))
    return F.when(n > 1, n)


def complexity_label(cyclomatic, cognitive):
    """``cyc N / cog M`` without what is not known; null where neither is."""
    label = F.concat_ws(" / ", F.concat(F.lit("cyc "), cyclomatic.cast("string")), F.concat(F.lit("cog "), cognitive.cast("string")))
    return F.when(label != "", label)
