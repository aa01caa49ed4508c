"""Problem 4: splitting oversized items at natural boundaries.

A sparse-table range-maximum index over the boundary strength of each line answers "the strongest cut among lines
l to r, the rightmost of equals" in constant time; the pieces of an item are then found greedily, each next piece
stepping back by the overlap. Only items over the limit leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINES, MIN_LINES, OVERLAP = 120, 41, 20

#: Words that open a declaration in the first column of a line.
OPENERS = ("def", "async", "class", "func", "function", "export", "fn", "pub", "impl", "type", "interface", "public")

_OPENS = re.compile(r"@|(?:%s) " % "|".join(OPENERS))
_BLANK = re.compile(r"[ \t]*\Z")


def split_lines(text: str) -> list[str]:
    """Lines end at LF or CRLF and nowhere else; a final line end adds no line."""
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    if text.endswith("\n"):
        lines.pop()
    elif lines and text.endswith("\r"):  # a lone CR at the very end is text, not a line end
        lines[-1] += "\r"
    return lines


def boundary_strengths(lines: list[str]) -> np.ndarray:
    """1 where a line is a natural boundary, else 0. The last line has no next line to open a declaration."""
    out = np.zeros(len(lines), dtype=np.int8)
    for i, line in enumerate(lines):
        if _BLANK.match(line) or (i + 1 < len(lines) and _OPENS.match(lines[i + 1]) and not line.startswith("@")):
            out[i] = 1
    return out


class RightmostMax:
    """Sparse table: position of the greatest value of any range, the rightmost of equals."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.asarray(values)
        self.levels = [np.arange(len(self.values))]
        span = 1
        while 2 * span <= len(self.values):
            left, right = self.levels[-1][:-span], self.levels[-1][span:]
            self.levels.append(np.where(self.values[left] > self.values[right], left, right))
            span *= 2

    def query(self, lo: int, hi: int) -> int:
        """Best position in lo..hi, both included."""
        level = (hi - lo + 1).bit_length() - 1
        a, b = int(self.levels[level][lo]), int(self.levels[level][hi - (1 << level) + 1])
        if self.values[a] == self.values[b]:
            return max(a, b)
        return a if self.values[a] > self.values[b] else b


def cut_pieces(strengths: np.ndarray, max_lines: int = MAX_LINES, min_lines: int = MIN_LINES, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(first, last, whether it ends at a natural boundary) of each piece, 0-based and inclusive.

    ``min_lines`` must be greater than ``overlap``, else a piece might not advance.
    """
    if not overlap < min_lines <= max_lines:
        raise ValueError("overlap < min_lines <= max_lines must hold")
    n, start, out = len(strengths), 0, []
    index = RightmostMax(strengths)
    while n - start > max_lines:
        best = index.query(start + min_lines - 1, start + max_lines - 1)
        natural = bool(strengths[best])
        end = best if natural else start + max_lines - 1
        out.append((start, end, natural))
        start = end + 1 - overlap
    out.append((start, n - 1, True))
    return out


def line_count(text: Column) -> Column:
    """Number of lines of a text, JVM-side; 0 for null and empty."""
    breaks = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(text.isNull() | (text == ""), 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1))


def split_oversized(
    items: DataFrame, id_col: str, text_col: str, start_col: str | None = None,
    max_lines: int = MAX_LINES, min_lines: int = MIN_LINES, overlap: int = OVERLAP,
) -> DataFrame:
    """Pieces of every item of more than ``max_lines`` lines.

    Result: item_id, piece_no (from 1), piece_start, piece_end (lines of the file), is_semantic_unit, piece_text.
    ``is_semantic_unit`` says that the piece begins at the item's start or just behind a natural boundary and ends at
    one. Items within the limit, null and empty texts give no row. A null start counts as line 1. Repeated rows give
    repeated pieces. Other columns of ``items`` are not read, so their names cannot clash.
    """
    start = F.coalesce(F.col(start_col), F.lit(1)) if start_col else F.lit(1)
    long = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("_text"), start.cast("int").alias("_first")).where(line_count(F.col("_text")) > max_lines)
    id_type = long.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text, first in zip(batch["item_id"], batch["_text"], batch["_first"], strict=True):
                lines = split_lines(text)
                strengths = boundary_strengths(lines)
                for no, (a, b, natural) in enumerate(cut_pieces(strengths, max_lines, min_lines, overlap), 1):
                    whole = natural and (a == 0 or bool(strengths[a - 1]))
                    rows.append((item, no, first + a, first + b, whole, "\n".join(lines[a : b + 1])))
            yield pd.DataFrame(rows, columns=["item_id", "piece_no", "piece_start", "piece_end", "is_semantic_unit", "piece_text"])

    return long.mapInPandas(run, f"item_id {id_type}, piece_no int, piece_start int, piece_end int, is_semantic_unit boolean, piece_text string")
