"""Calls, imports, symbols and signals out of source texts, by expressions over lines."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import text_lines

#: Words before a bracket that are no calls.
NOT_CALLS = ("if", "for", "while", "switch", "return", "new", "catch", "func", "def", "class", "match")
MAX_NAMES = 200

#: Line patterns of imports by language; the first group is the module.
IMPORTS = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "javascript": r"^\s*(?:import\b[^'\"]*|.*\brequire\()\s*['\"]([^'\"]+)['\"]",
    "typescript": r"^\s*(?:import\b[^'\"]*|.*\brequire\()\s*['\"]([^'\"]+)['\"]",
    "go": r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;",
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    "c": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]",
    "cpp": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]",
    "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "php": r"^\s*(?:use|require_once|require|include_once|include)\s*\(?\s*['\"]?([\w./\\-]+)",
    "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]",
    "shell": r"^\s*(?:source|\.)\s+([\w./-]+)",
    "powershell": r"^\s*(?:Import-Module|using\s+module)\s+([\w./\\-]+)",
    "terraform": r"^\s*source\s*=\s*\"([^\"]+)\"",
}
#: Line patterns of symbols by language: (kind, pattern), the first group is the name.
SYMBOLS = {
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")],
    "go": [("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("method", r"^func\s+\([^)]*\)\s*(\w+)\s*\("), ("function", r"^func\s+(\w+)\s*\(")],
    "java": [("class", r"^\s*(?:public\s+|final\s+|abstract\s+)*class\s+(\w+)"), ("method", r"^\s*(?:public|protected|private)\s+(?:static\s+|final\s+)*[\w<>\[\]]+\s+(\w+)\s*\(")],
    "rust": [
        ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"),
        ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"), ("function", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
    ],
    "csharp": [
        ("class", r"^\s*(?:(?:public|internal|private|protected|static|sealed|abstract|partial)\s+)*(?:class|interface|struct|enum)\s+(\w+)"),
        ("method", r"^\s*(?:(?:public|internal|private|protected|static|virtual|override|async)\s+)+[\w<>\[\],?]+\s+(\w+)\s*\("),
    ],
    "php": [("class", r"^\s*(?:(?:abstract|final)\s+)*(?:class|interface|trait)\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|protected|static|final)\s+)*function\s+&?(\w+)\s*\(")],
    "terraform": [("resource", r"^\s*(?:resource|data)\s+\"[^\"]+\"\s+\"([^\"]+)\""), ("block", r"^\s*(?:variable|output|module|provider)\s+\"([^\"]+)\"")],
    "shell": [("function", r"^\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)\s*\{?")],
    "yaml": [("key", r"^([A-Za-z_][\w-]*)\s*:")],
    "powershell": [("function", r"^\s*function\s+([A-Za-z_][\w-]*)")],
}
#: Languages whose symbols are told by their first line alone, so they end where they begin.
ONE_LINE = ("shell", "yaml", "powershell")
#: Kinds that own the methods and functions after them.
OWNERS = ("class", "struct", "impl", "trait", "interface")
SYMBOLS["typescript"] = [*SYMBOLS["javascript"], ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)")]


def calls(text: Column) -> Column:
    """Distinct names before an opening bracket, in order, at most MAX_NAMES."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)
    return F.slice(F.array_distinct(F.filter(names, lambda n: ~n.isin(*NOT_CALLS))), 1, MAX_NAMES)


def imports(files: DataFrame, id_col: str, language_col: str, text_col: str) -> DataFrame:
    """(id, module): distinct modules that a file imports, by the patterns of its language."""
    lines = files.select(F.col(id_col).alias("id"), F.lower(F.col(language_col)).alias("_g"), F.explode(text_lines(F.col(text_col))).alias("_l"))
    module: Column = F.lit("")
    for language, pattern in IMPORTS.items():
        groups = 2 if language == "python" else 1
        found = F.coalesce(*[F.nullif(F.regexp_extract("_l", pattern, g), F.lit("")) for g in range(1, groups + 1)])
        module = F.when(F.col("_g") == language, found).otherwise(module)
    return lines.select("id", module.alias("module")).where("module <> ''").distinct()


def line_symbols(files: DataFrame, id_col: str, language_col: str, text_col: str) -> DataFrame:
    """(id, kind, name, start_line, end_line): declarations by line patterns; each ends before the next begins."""
    lines = files.select(F.col(id_col).alias("id"), F.lower(F.col(language_col)).alias("_g"), text_lines(F.col(text_col)).alias("_all")).select("id", "_g", F.size("_all").alias("_n"), F.posexplode("_all").alias("_i", "_l"))
    hit: Column = F.lit(None).cast("struct<kind:string,name:string>")
    for language, patterns in SYMBOLS.items():
        for kind, pattern in reversed(patterns):
            name = F.regexp_extract("_l", pattern, 1)
            hit = F.when((F.col("_g") == language) & (name != ""), F.struct(F.lit(kind).alias("kind"), name.alias("name"))).otherwise(hit)
    found = lines.select("id", "_g", "_n", (F.col("_i") + 1).alias("start_line"), hit.alias("h")).where("h is not null")
    w = Window.partitionBy("id").orderBy("start_line")
    end = F.when(F.col("_g").isin(*ONE_LINE), F.col("start_line")).otherwise(F.greatest(F.col("start_line"), F.coalesce(F.lead("start_line").over(w) - 1, F.col("_n"))))
    return found.select("id", F.col("h.kind").alias("kind"), F.col("h.name").alias("name"), "start_line", end.alias("end_line"))


def owned_symbols(symbols: DataFrame, joint: str = ".") -> DataFrame:
    """``line_symbols`` with ``path``: methods and functions behind the class, struct or impl that was declared last before them."""
    w = Window.partitionBy("id").orderBy("start_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("kind").isin(*OWNERS), F.col("name")), ignorenulls=True).over(w)
    inside = F.col("kind").isin("method", "function") & F.col("_o").isNotNull()
    return symbols.withColumn("_o", owner).withColumn("path", F.when(inside, F.concat("_o", F.lit(joint), "name")).otherwise(F.col("name"))).drop("_o")


def go_block_imports(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, module) of the modules in the import blocks of Go files: what is quoted between ``import (`` and its ``)``."""
    block = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"(?m)^import\s*\(([^)]*)\)"), 1)
    module = F.explode(F.flatten(F.transform(block, lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), 1)))).alias("module")
    return files.select(F.col(id_col).alias("id"), module).distinct()


def symbols(files: DataFrame, id_col: str, language_col: str, text_col: str) -> DataFrame:
    """Symbols of files of any known language: Python by syntax tree, the others by line patterns."""
    python = F.lower(F.coalesce(language_col, F.lit(""))) == "python"
    return python_symbols(files.where(python), id_col, text_col).unionByName(line_symbols(files.where(~python), id_col, language_col, text_col))


def python_symbols(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, name, start_line, end_line) of Python files by their syntax tree; files that do not parse give no row."""
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["id"], batch["text"], strict=True):
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                        rows.append((item, "class" if isinstance(n, ast.ClassDef) else "function", n.name, n.lineno, n.end_lineno))
            yield pd.DataFrame(rows, columns=["id", "kind", "name", "start_line", "end_line"])

    return files.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, kind string, name string, start_line int, end_line int")


def redact_mail(text: Column) -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]")


def query_symbols(text: Column, limit: int = 5) -> Column:
    """CamelCase and snake_case names of a query, sorted, at most ``limit``."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+|[a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"), 1)
    return F.slice(F.array_sort(F.array_distinct(found)), 1, limit)


def code_signal(text: Column) -> Column:
    """How much a query looks like code: 0.3 for each kind of mark it holds, at most 1."""
    marks = (r"[a-z][A-Z]", r"[a-z]_[a-z]", r"\w\(", r"::|->|\w\.\w", r"`[^`]+`")
    total: Column = F.lit(0.0)
    for m in marks:
        total = total + F.when(F.coalesce(text, F.lit("")).rlike(m), 0.3).otherwise(0.0)
    return F.least(F.round(total, 6), F.lit(1.0))


def patch_files(patch: Column) -> Column:
    """Sorted distinct paths that a unified diff touches."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^\+\+\+ b/(\S+)"), 1)))


def patch_functions(patch: Column) -> Column:
    """Sorted distinct functions that a unified diff names in its hunk heads or adds."""
    word = r"(?:def|func|function|fn)[ \t]+(\w+)"
    heads = F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^@@[^@]*@@.*?\b" + word), 1)
    added = F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^\+\s*(?:async[ \t]+|pub[ \t]+)?" + word), 1)
    return F.array_sort(F.array_distinct(F.concat(heads, added)))


def symbol_hashes(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, key, hash): a symbol's key of kind, name and first line, and the hash of its lines; the join is by file."""
    lines = files.select("file_id", F.split(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), "\n", -1).alias("_l"))
    y = symbols.join(lines, "file_id")
    own = F.slice("_l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    key = F.concat_ws("_", F.coalesce("kind", F.lit("")), F.coalesce("name", F.lit("")), F.col("start_line").cast("string"))
    return y.select("symbol_id", key.alias("key"), F.sha1(F.array_join(own, "\n")).alias("hash"))


def embed_once(texts: DataFrame, text: str, embed) -> DataFrame:
    """(text, uses, vector): every distinct text is embedded once by ``embed``, a function of a column such as a pandas UDF."""
    once = texts.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("uses"))
    return once.select("text", "uses", embed(F.col("text")).alias("vector"))
