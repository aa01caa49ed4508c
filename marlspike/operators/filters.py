"""Predicates over points: the query language, path classes, globs and array matches."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of the query language; file and path mean under, lang means language.
DSL_KEYS = ("lang", "language", "file", "path", "under", "kind", "symbol", "ext", "not", "case", "repo")
_DSL = r"\b(lang|language|file|path|under|kind|symbol|ext|not|case|repo)\s*:\s*(\S+)"

#: Path classes.
TEST_PATHS = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|_test\.\w+$|\.(test|spec)\.\w+$"
VENDOR_PARTS = ("vendor/", "third_party/", "node_modules/", "/dist/", "/build/", ".generated/", "generated/", "autogen/", "target/")
CONFIG_EXTENSIONS = ("json", "yml", "yaml", "toml", "ini")
CODE_EXTENSIONS = ("py", "ts", "tsx", "js", "jsx", "go", "java", "rs", "rb", "php", "cs", "cpp", "c", "hpp", "h")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./]+)$", 1))


def parse_dsl(query: str) -> tuple[str, dict[str, str]]:
    """(text left, filters) of one query; the last of equal keys wins."""
    found: dict[str, str] = {}
    for m in re.finditer(_DSL, query, re.I):
        key = m[1].lower()
        found[{"file": "under", "path": "under", "lang": "language"}.get(key, key)] = m[2]
    return re.sub(r"\s+", " ", re.sub(_DSL, " ", query, flags=re.I)).strip(), found


def dsl_column(query: Column, *keys: str) -> Column:
    """The last value given for any of the keys in each row's query; null without one."""
    alternatives = "|".join(keys)
    values = F.regexp_extract_all(query, F.lit(rf"(?i)\b(?:{alternatives})\s*:\s*(\S+)"), 1)
    return F.when(F.size(values) > 0, F.element_at(values, -1))


def dsl_text(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(query, f"(?i){_DSL}", " "), r"\s+", " "))


def glob_regex(glob: str) -> str:
    """A glob as an anchored expression; a star crosses slashes."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(TEST_PATHS)


def is_vendor(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(path), F.lit(p)) for p in VENDOR_PARTS])


def is_config(path: Column) -> Column:
    return extension(path).isin(*CONFIG_EXTENSIONS)


def is_document(path: Column) -> Column:
    p = F.lower(path)
    return F.contains(p, F.lit("readme")) | F.contains(p, F.lit("/docs/")) | F.contains(p, F.lit("/documentation/")) | p.endswith(".md")


def is_core(path: Column) -> Column:
    return extension(path).isin(*CODE_EXTENSIONS) & ~is_test(path) & ~is_document(path)


def where_filters(points: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows that satisfy all given filters: equality on language, kind, symbol, ext and repo (a list is any-of, ``*`` is all),
    ``under`` (the exact folder), ``not`` (substring of the path), ``path_regex``, ``path_glob``, ``not_glob``.

    Equalities reach the scan. An invalid expression is ignored, an unknown key is an error.
    """
    out = points
    for key, value in filters.items():
        if value in (None, "", []):
            continue
        if key in ("language", "kind", "symbol", "repo"):
            if value != "*":
                out = out.where(F.col(key).isin(*value) if isinstance(value, list | tuple) else F.col(key) == value)
        elif key == "ext":
            out = out.where(extension(F.col("path")) == str(value).lstrip("."))
        elif key == "under":
            out = out.where(F.regexp_extract("path", r"^(.*)/[^/]*$", 1) == str(value).strip("/"))
        elif key == "not":
            out = out.where(~F.contains(F.col("path"), F.lit(value)))
        elif key == "path_regex":
            try:
                re.compile(str(value))
            except re.error:
                continue
            out = out.where(F.col("path").rlike(str(value)))
        elif key in ("path_glob", "not_glob"):
            globs = value if isinstance(value, list | tuple) else [value]
            hit = reduce(lambda a, b: a | b, [F.col("path").rlike(glob_regex(g)) for g in globs])
            out = out.where(hit if key == "path_glob" else ~hit)
        else:
            raise ValueError(f"no such filter: {key}")
    return out


def any_contains(array: Column, part: str) -> Column:
    """Whether any element holds the substring; null arrays hold none."""
    return F.coalesce(F.exists(array, lambda x: F.contains(x, F.lit(part))), F.lit(False))
