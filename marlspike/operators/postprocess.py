"""Order-dependent steps behind ranking: adjacency clusters, diversification, duplicates, caps and span budgets.

All of them take rows that a query's limit has already bounded, one group a query.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import top_k


def first_per_entity(ranked: DataFrame, query: str, entity: list[str], rank: str = "rank") -> DataFrame:
    """The best-ranked row of each entity of a query."""
    return top_k(ranked, [query, *entity], [F.asc(rank)], 1, "_first").drop("_first")


def cap_per_path(ranked: DataFrame, query: str, per_path: int, limit: int, rank: str = "rank") -> DataFrame:
    """At most ``per_path`` rows a path, then at most ``limit`` rows a query, ranked anew."""
    capped = top_k(ranked, [query, "path"], [F.asc(rank)], per_path, "_in_path").drop("_in_path")
    return top_k(capped.withColumnRenamed(rank, "_old"), query, [F.asc("_old")], limit, rank).drop("_old")


def cluster_adjacent(rows: pd.DataFrame, gap: int = 15) -> pd.DataFrame:
    """Of rows of one path that lie within ``gap`` lines of a growing range only the best stays, with its own lines.

    Rows come best first.
    """
    ranges: dict[str, list[list[int]]] = {}
    keep = []
    for i, (path, start, end) in enumerate(zip(rows["path"], rows["start_line"], rows["end_line"], strict=True)):
        for r in ranges.setdefault(path, []):
            if start <= r[1] + gap and end >= r[0] - gap:
                r[0], r[1] = min(r[0], start), max(r[1], end)
                break
        else:
            ranges[path].append([start, end])
            keep.append(i)
    return rows.iloc[keep]


def diversify(rows: pd.DataFrame, k: int = 60, trade: float = 0.7) -> pd.DataFrame:
    """Maximal marginal relevance: the best first, then whatever balances score and unlikeness to those taken.

    Likeness is 1 on one path, 0.8 on one symbol, else half the overlap of path parts. The rest follows in its order.
    """
    n = len(rows)
    if n < 2:
        return rows
    paths, symbols, score = rows["path"].fillna("").tolist(), rows["symbol"].fillna("").tolist(), rows["score"].tolist()
    parts = [frozenset(x for x in re.split(r"[/\\]+", p.lower()) if x) for p in paths]

    def like(i: int, j: int) -> float:
        if paths[i] and paths[i] == paths[j]:
            return 1.0
        if symbols[i] and symbols[i] == symbols[j]:
            return 0.8
        both = len(parts[i] | parts[j])
        return 0.5 * len(parts[i] & parts[j]) / both if both else 0.0

    taken, left = [0], list(range(1, n))
    closest = {i: like(i, 0) for i in left}
    while left and len(taken) < k:
        best = max(left, key=lambda i: (trade * score[i] - (1 - trade) * closest[i], -i))
        left.remove(best)
        taken.append(best)
        for i in left:
            closest[i] = max(closest[i], like(i, best))
    return rows.iloc[taken + left]


def finish(ranked: DataFrame, per_path: int = 1, limit: int = 10, gap: int = 15) -> DataFrame:
    """Adjacency clusters, diversification, one row an entity, the path cap and the limit, one group a query."""
    columns = ["query_id", "id", "path", "symbol", "start_line", "end_line", "score", "rank"]
    types = dict(ranked.dtypes)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = diversify(cluster_adjacent(rows.sort_values("rank"), gap))
        return rows.assign(rank=range(1, len(rows) + 1))[columns]

    spread = ranked.select(*columns).groupBy("query_id").applyInPandas(one, ", ".join(f"{c} {types[c]}" for c in columns))
    return cap_per_path(first_per_entity(spread, "query_id", ["path", "symbol"]), "query_id", per_path, limit)


def budget_spans(rows: pd.DataFrame, merge_lines: int = 4, tokens_per_line: int = 32, budget: int = 5000, per_path: int = 8) -> pd.DataFrame:
    """Spans near each other on a path are merged as they come, then taken by score until the token budget is spent; the last is trimmed."""
    spans: list[dict] = []
    for r in rows.to_dict("records"):
        for s in spans:
            if s["path"] == r["path"] and r["start_line"] <= s["end_line"] + merge_lines and r["end_line"] >= s["start_line"] - merge_lines:
                s.update(start_line=min(s["start_line"], r["start_line"]), end_line=max(s["end_line"], r["end_line"]), score=max(s["score"], r["score"]))
                break
        else:
            spans.append(dict(r))
    out, used, count = [], 0, {}
    for s in sorted(spans, key=lambda x: (-x["score"], x["path"], x["start_line"])):
        if count.get(s["path"], 0) >= per_path:
            continue
        lines = min(s["end_line"] - s["start_line"] + 1, (budget - used) // tokens_per_line)
        if lines <= 0:
            break
        out.append(s | {"end_line": s["start_line"] + lines - 1, "tokens": lines * tokens_per_line})
        used += lines * tokens_per_line
        count[s["path"]] = count.get(s["path"], 0) + 1
    return pd.DataFrame(out, columns=[*rows.columns, "tokens"])


def span_budget(ranked: DataFrame, **limits: int) -> DataFrame:
    """``budget_spans`` for each query."""
    schema = "query_id bigint, path string, start_line int, end_line int, score double, tokens int"
    columns = ["query_id", "path", "start_line", "end_line", "score"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return budget_spans(rows.sort_values("rank")[columns], **limits)[[*columns, "tokens"]]

    return ranked.groupBy("query_id").applyInPandas(one, schema)


def symbol_extent(chunks: DataFrame) -> DataFrame:
    """(path, symbol, start_line, end_line): the lines that a symbol's chunks cover together."""
    return chunks.groupBy("path", "symbol").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
