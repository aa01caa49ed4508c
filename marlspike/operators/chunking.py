"""Row generators over texts: line windows, token windows, and the symbol of a chunk."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_lines(text: Column) -> Column:
    """Lines of a text; a final line end adds none, null and empty texts have none."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n\\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1))


def line_chunks(files: DataFrame, id_col: str, text_col: str, max_lines: int = 120, overlap: int = 20) -> DataFrame:
    """(id, start_line, end_line, chunk_text): windows of ``max_lines`` lines that share ``overlap`` with the next."""
    if not 0 <= overlap < max_lines:
        raise ValueError("overlap must be less than max_lines")
    step = max_lines - overlap
    cut = files.select(F.col(id_col).alias("id"), text_lines(F.col(text_col)).alias("_l")).where(F.size("_l") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_l") - max_lines) / step) * step).cast("int")
    starts = cut.select("id", "_l", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("_s"))
    piece = F.slice("_l", F.col("_s") + 1, max_lines)
    return starts.select("id", (F.col("_s") + 1).alias("start_line"), (F.col("_s") + F.size(piece)).alias("end_line"), F.array_join(piece, "\n").alias("chunk_text"))


def token_chunks(files: DataFrame, id_col: str, text_col: str, tokens: int = 16, stride: int | None = None, cap: int = 200) -> DataFrame:
    """(id, no, start_char, end_char, start_line, end_line): windows of tokens as offsets into the original text.

    Where a text would give more than ``cap`` windows, window and stride grow in proportion.
    """
    kind = files.schema[id_col].dataType.simpleString()
    base_stride = stride or max(1, tokens // 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["id"], batch["text"], strict=True):
                spans = [m.span() for m in re.finditer(r"\S+", text)]
                k, step = tokens, base_stride
                if (number := -(-max(0, len(spans) - k) // step) + 1) > cap:
                    grow = number / cap * 1.1
                    k, step = int(k * grow), int(step * grow)
                breaks = np.array([m.start() for m in re.finditer("\n", text)], dtype=np.int64)
                first, last = np.searchsorted(breaks, np.array(spans or [(0, 0)]).T) + 1
                for no, s in enumerate(range(0, max(1, len(spans)), step) if spans else ()):
                    a, b = spans[s][0], spans[min(s + k, len(spans)) - 1][1]
                    rows.append((item, no, a, b, int(first[s]), int(last[min(s + k, len(spans)) - 1])))
                    if s + k >= len(spans):
                        break
            yield pd.DataFrame(rows, columns=["id", "no", "start_char", "end_char", "start_line", "end_line"])

    return files.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, no int, start_char int, end_char int, start_line int, end_line int")


def chunk_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, start_line, symbol): of the overlapping symbols the one that starts last, then the shortest; else the last
    that starts before; else empty. ``symbols``: id, name, start_line, end_line. Joined by id, so no theta join."""
    s = symbols.select("id", F.col("name").alias("_n"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    met = chunks.select("id", "start_line", "end_line").join(s, "id", "left")
    overlap = (F.col("_a") <= F.col("end_line")) & (F.col("_b") >= F.col("start_line"))
    before = F.col("_a") <= F.col("end_line")
    key = F.struct(F.when(overlap, 2).when(before, 1).otherwise(0), F.col("_a"), F.when(overlap, F.col("_a") - F.col("_b")).otherwise(0), F.col("_n"))
    best = met.groupBy("id", "start_line").agg(F.max_by(F.when(before, F.col("_n")), key).alias("symbol"))
    return best.select("id", "start_line", F.coalesce("symbol", F.lit("")).alias("symbol"))


def information(language: Column, path: Column, start: Column, end: Column, text: Column) -> Column:
    """A line that tells what a chunk is, with up to 160 characters of its first line."""
    first = F.trim(F.get(F.split(F.coalesce(text, F.lit("")), "\n"), F.lit(0)))
    short = F.when(F.length(first) > 160, F.concat(F.substring(first, 1, 160), F.lit("…"))).otherwise(first)
    return F.concat(F.coalesce(language, F.lit("")), F.lit(" code from "), path, F.lit(" lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(". "), short)


def pack_symbols(n: int, symbols: list[tuple[int, int]], max_lines: int = 120, overlap: int = 20) -> list[tuple[int, int]]:
    """Line ranges over 1..n: adjacent symbols share a chunk while it spans at most ``max_lines`` and no gap is over ``overlap``;
    longer symbols and the gaps between are cut into plain windows."""
    runs: list[list[int]] = []
    for a, b in sorted(s for s in symbols if 1 <= s[0] <= s[1] <= n):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)  # nested in or overlapping the one before
        elif runs and a - runs[-1][1] - 1 <= overlap and b - runs[-1][0] + 1 <= max_lines:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    out, at = [], 1
    for a, b in [*runs, [n + 1, n]]:
        if at < a:
            out += _windows(at, a - 1, max_lines, overlap)
        if a <= b:
            out += _windows(a, b, max_lines, overlap)
        at = max(at, b + 1)
    return out


def _windows(a: int, b: int, size: int, overlap: int) -> list[tuple[int, int]]:
    out = []
    while True:
        end = min(a + size - 1, b)
        out.append((a, end))
        if end == b:
            return out
        a = end - overlap + 1


def semantic_chunks(files: DataFrame, symbols: DataFrame, id_col: str, text_col: str, max_lines: int = 120, overlap: int = 20) -> DataFrame:
    """(id, start_line, end_line, chunk_text): chunks that keep symbols (id, start_line, end_line) whole where they fit; see ``pack_symbols``."""
    kind = files.schema[id_col].dataType.simpleString()
    spans = symbols.groupBy("id").agg(F.collect_list(F.struct("start_line", "end_line")).alias("spans"))
    rows = files.select(F.col(id_col).alias("id"), text_lines(F.col(text_col)).alias("lines")).where(F.size("lines") > 0).join(spans, "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, lines, found in zip(batch["id"], batch["lines"], batch["spans"], strict=True):
                pairs = [(x["start_line"], x["end_line"]) for x in found] if found is not None else []
                out += [(item, a, b, "\n".join(lines[a - 1 : b])) for a, b in pack_symbols(len(lines), pairs, max_lines, overlap)]
            yield pd.DataFrame(out, columns=["id", "start_line", "end_line", "chunk_text"])

    return rows.mapInPandas(run, f"id {kind}, start_line int, end_line int, chunk_text string")
