"""Tokens, hashes and similarity as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
STOP_WORDS = ("the", "a", "an", "of", "in", "on", "for", "and", "or", "to", "with", "by", "is", "are", "be", "this", "that")
IDENT = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"


def ident_tokens(text: Column, drop_stop_words: bool = False) -> Column:
    """Lower-cased parts of snake_case and camelCase identifiers; null gives an empty array."""
    parts = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENT), 0), F.lower)
    return F.filter(parts, lambda t: ~t.isin(*STOP_WORDS)) if drop_stop_words else parts


def query_tokens(phrases: Column) -> Column:
    """Distinct tokens of an array of phrases, without stop words, in order."""
    return F.array_distinct(F.flatten(F.transform(phrases, lambda p: ident_tokens(p, True))))


def code_tokens(text: Column) -> Column:
    """Words of at least three characters that are neither numbers nor stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+")
    return F.filter(words, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~t.isin(*STOP_WORDS))


def filename_tokens(path: Column) -> Column:
    """Parts of a file's stem, its extension and leading marks taken away."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]+)$", 1), r"\.[^.]+$", "")
    return F.array_distinct(ident_tokens(F.regexp_replace(stem, r"^[_$]+", "")))


def token_hash(token: Column) -> Column:
    """The first 32 bits of a token's md5."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def point_id(path: Column, start: Column, end: Column, text: Column) -> Column:
    """16 hex digits that name a chunk by its place and content."""
    return F.substring(F.sha1(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n"), text)), 1, 16)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, unlike long or all-zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit signatures."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def highlight(text: Column, tokens: list[str], before: str = "<<", after: str = ">>") -> Column:
    """Marks tokens, the longest first, whatever their case."""
    import re

    for t in sorted(tokens, key=lambda x: (-len(x), x)):
        text = F.regexp_replace(text, f"(?i){re.escape(t)}", f"{before}$0{after}")
    return text


def symbol_variants(symbol: Column) -> Column:
    """A symbol, its base name and its container, for `.`, `::` and `->`; distinct, in order."""
    s = F.trim(F.coalesce(symbol, F.lit("")))
    dots, colons, arrows = (F.split(s, sep) for sep in (r"\.", "::", "->"))
    extra = F.concat(
        F.when(F.size(dots) > 1, F.array(F.element_at(dots, -1), F.get(dots, F.lit(0)))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(colons) > 1, F.array(F.element_at(colons, -1), F.element_at(colons, -2))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(arrows) > 1, F.array(F.element_at(arrows, -1))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.filter(F.concat(F.array(s), extra), lambda x: x != ""))
