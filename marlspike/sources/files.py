"""Files and manifests in, compact text out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of indexable files and their languages.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "sh": "shell", "sql": "sql", "md": "markdown", "yml": "yaml", "yaml": "yaml", "json": "json", "toml": "toml", "tf": "terraform"}
#: Folders that are not walked.
EXCLUDED = (".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".venv", "target")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, size, mtime, sha1) of the indexable text files below a folder, read by the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    return raw.where(indexable(path) & ~excluded(path)).select(path.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha1("content").alias("sha1"))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    name = F.lower(F.regexp_extract(path, r"([^/\\]+)$", 1))
    return F.when(name.startswith("dockerfile"), "dockerfile").otherwise(F.try_element_at(F.create_map(*pairs), F.regexp_extract(name, r"\.([^.]+)$", 1)))


def indexable(path: Column) -> Column:
    return language(path).isNotNull()


def excluded(path: Column, folders: tuple[str, ...] = EXCLUDED) -> Column:
    return F.arrays_overlap(F.split(path, r"[/\\]"), F.array(*[F.lit(f) for f in folders]))


def read_commits(spark: SparkSession, path: str, message_chars: int = 2000) -> DataFrame:
    """(commit_id, author, date, message, path): a commit manifest, one row for each file of a commit."""
    schema = "mode string, commits array<struct<commit_id:string,author_name:string,authored_date:string,message:string,files:array<string>>>"
    from ..operators.extract import redact_mail

    c = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("commits").alias("c")).select("c.*")
    return c.select("commit_id", F.col("author_name").alias("author"), F.col("authored_date").alias("date"), F.substring(redact_mail(F.col("message")), 1, message_chars).alias("message"), F.explode_outer("files").alias("path"))


def toon_value(value: Column) -> Column:
    """A value of a compact table; quoted where it holds a comma, quote, line end or outer blanks."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    odd = v.rlike('[,"\n\r]|^\\s|\\s$') | (v == "")
    return F.when(odd, F.concat(F.lit('"'), F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))).otherwise(v)


def toon_rows(df: DataFrame, columns: list[str]) -> Column:
    return F.concat(F.lit("  "), F.concat_ws(",", *[toon_value(F.col(c)) for c in columns]))


def write_toon(df: DataFrame, columns: list[str], name: str = "results", most: int = 10_000) -> str:
    """A bounded result (a query's top k) as a compact table: one header with the columns, then a line a row.

    More than ``most`` rows are an error; write ``toon_rows`` as text instead.
    """
    lines = [r[0] for r in df.select(toon_rows(df, columns)).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} rows for one compact table")
    return "\n".join([f"{name}[{len(lines)}]{{{','.join(columns)}}}:", *lines])
