"""Features of search queries and small text rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Question words and connectors that mark a natural-language query.
QUESTION_WORDS = ("what", "how", "why", "when", "where", "which", "who", "explain", "describe")
CONNECTORS = ("and", "or", "but", "with", "that", "also", "including")


def complexity(text: Column) -> Column:
    """0 to 1: long, many-worded questions score high, names, quotes and patterns low."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(F.trim(t))
    score = F.least(F.length(t) / 100.0, F.lit(1.0)) * 0.2 + F.least(F.regexp_count(t, F.lit(r"[A-Za-z0-9_]+")) / 10.0, F.lit(1.0)) * 0.15
    score = score + F.when(low.rlike("|".join(QUESTION_WORDS)), 0.2).otherwise(0.0)
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    joined = reduce(lambda a, b: a + b, [F.when(F.contains(padded, F.lit(f" {c} ")), 0.1).otherwise(0.0) for c in CONNECTORS])
    score = score + F.least(joined, F.lit(0.2)) - F.when(t.rlike(r"[(){}\[\]<>.:;,]"), 0.1).otherwise(0.0)
    score = score - F.when(t.rlike("[A-Z][a-z]+[A-Z]") | F.contains(t, F.lit("_")), 0.1).otherwise(0.0) - F.when(t.rlike("[\"']"), 0.15).otherwise(0.0) - F.when(t.rlike(r"[*+?\\|^$]"), 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6)))


def query_class(text: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """simple, complex, semantic or hybrid."""
    q, c = F.lower(F.trim(F.coalesce(text, F.lit("")))), complexity(text)
    short = q.rlike("^[a-z_][a-z0-9_]*$") | ((F.size(F.split(q, r"\s+")) <= 2) & ~q.rlike(r"[(){}\[\]]"))
    return F.when((c < low) & short, "simple").when(c > high, "complex").when(q.rlike("^(what|how|why|explain|describe|show me|find all)"), "semantic").otherwise("hybrid")


def token_budget(files: Column, is_complex: Column) -> Column:
    """Tokens for an answer: more for many files and half again for a complex question."""
    return F.floor((2000 + F.least(150 * files, F.lit(2000))) * F.when(is_complex, 1.5).otherwise(1.0)).cast("bigint")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")


def compressed(text: Column, lines: int = 6) -> Column:
    """The first lines of a snippet."""
    return F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, lines), "\n")


def sharpened(path: Column) -> Column:
    """A path's last part, its stem, its last two and last three parts: terms to search a file by."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")
    tail = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), "/")
    return F.array_distinct(F.array(F.element_at(parts, -1), stem, tail(2), tail(3)))


def comment_share(text: Column) -> Column:
    """The share of a text's filled lines that are whole-line comments."""
    filled = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(filled) > 0, F.round(F.size(F.filter(filled, lambda x: x.rlike(r"^\s*(?://|#|/\*|\*|<!--|--)"))) / F.size(filled), 6)).otherwise(0.0)


def comment_penalty(share: Column, top: float = 0.2, start: float = 0.6) -> Column:
    """Nothing below ``start``, rising to ``top`` for nothing but comments."""
    return F.when(share >= start, F.round(top * (share - start) / (1 - start), 6)).otherwise(0.0)


def route(text: Column) -> Column:
    """The kind of request, by ordered rules."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.rlike(r"\btests?\b"), "tests").when(t.rlike(r"\b(config|configuration|setting|settings)\b"), "config").when(t.rlike(r"\b(calls?|callers?|calling|called)\b"), "callers")
        .when(t.rlike(r"\b(imports?|importers?)\b"), "importers").when(t.rlike(r"\b(commits?|history|changed)\b"), "history").when(t.rlike(r"^(what|how|why|explain)\b"), "answer").otherwise("search")
    )
