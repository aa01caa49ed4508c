"""Symbol relations, change history, commit and memory search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, tokens
from ..session import cut_lineage, rounded

#: Bytes of names and links up to which a graph goes to every task; nodes from which a task walks, and rows that it gives at a time.
GRAPH_BYTES, STARTS, ROWS = 96 << 20, 1_000, 50_000


def call_edges(chunks: DataFrame) -> DataFrame:
    """(id, callee): one row for each distinct call of a chunk."""
    return chunks.select("id", F.explode(F.array_distinct(F.coalesce("calls", F.array().cast("array<string>")))).alias("callee"))


def callers(chunks: DataFrame, symbols: DataFrame, limit: int | None = None) -> DataFrame:
    """(symbol, id, strategy): chunks that call a symbol, by exact name (1), else by its base name or container (2).

    Both strategies are one equi-join on the called name; a chunk counts by its best.
    """
    names = symbols.select("symbol", F.posexplode(tokens.symbol_variants(F.col("symbol"))).alias("_p", "callee")).select("symbol", "callee", F.when(F.col("_p") == 0, 1).otherwise(2).alias("strategy"))
    found = call_edges(chunks).join(names, "callee").groupBy("symbol", "id").agg(F.min("strategy").cast("int").alias("strategy"))
    if limit is None:
        return found
    w = Window.partitionBy("symbol").orderBy("strategy", "id")
    return found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def definitions(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, symbol_id, strategy): qualified path (1) before bare name (2); only the best strategy of each name stays."""
    by_path = symbols.join(wanted, symbols["path"] == wanted["wanted"]).select("wanted", "symbol_id", F.lit(1).alias("strategy"))
    by_name = symbols.join(wanted, symbols["name"] == wanted["wanted"]).select("wanted", "symbol_id", F.lit(2).alias("strategy"))
    both = by_path.unionByName(by_name).groupBy("wanted", "symbol_id").agg(F.min("strategy").alias("strategy"))
    best = both.groupBy("wanted").agg(F.min("strategy").alias("strategy"))
    return both.join(best, ["wanted", "strategy"]).select("wanted", "symbol_id", "strategy")


def change_history(versions: DataFrame) -> DataFrame:
    """(path, versions, contents, first and last change) of each path."""
    return versions.groupBy("path").agg(
        F.count(F.lit(1)).alias("versions"), F.count_distinct("file_hash").alias("contents"),
        F.min("last_modified_at").alias("first_modified"), F.max("last_modified_at").alias("last_modified"), F.max("ingested_at").alias("last_ingested"),
    )


def commit_search(commits: DataFrame, terms: list[str], fields: dict[str, float], limit: int | None = None) -> DataFrame:
    """(id, score): each term scores the weight of every field that holds it; at least one hit is needed."""
    score: Column = F.lit(0.0)
    for t in terms:
        for f, w in fields.items():
            score = score + F.when(F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(t.lower())), w).otherwise(0.0)
    found = commits.select("id", score.alias("score")).where("score > 0")
    return found.orderBy(F.desc("score"), "id").limit(limit) if limit else found


def memory_find(dense: DataFrame, lexical: DataFrame, mode: str = "rrf") -> DataFrame:
    """(query_id, id, score) of two ranked lists: by ranks, or ``legacy`` by 1 / (1 + similarity) with weights 1.0 and 0.9."""
    part = (lambda w: scores.rrf(F.col("rank"), 60)) if mode == "rrf" else (lambda w: F.lit(w) / (F.lit(1.0) + F.col("score")))
    both = dense.select("query_id", "id", part(1.0).alias("p")).unionByName(lexical.select("query_id", "id", part(0.9).alias("p")))
    return both.groupBy("query_id", "id").agg(rounded(F.sum("p"), 9).alias("score"))


def blend(code: DataFrame, memories: DataFrame, limit: int, memory_weight: float = 0.3, memory_rows: int = 3) -> DataFrame:
    """(query_id, source, id, score, rank): code and memories in one list, memories weighed down and held to a quota."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    some = memories.withColumn("score", F.col("score") * memory_weight).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= memory_rows)
    both = code.select("query_id", F.lit("code").alias("source"), "id", "score").unionByName(some.select("query_id", F.lit("memory").alias("source"), "id", "score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "id")
    return both.withColumn("score", rounded("score", 9)).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)


def collection_map(points: DataFrame, by: str = "repo") -> DataFrame:
    return points.groupBy(by).agg(F.count(F.lit(1)).alias("points"), F.count_distinct("path").alias("paths"), F.max("ingested_at").alias("last_ingested"), F.max("last_modified_at").alias("last_modified"))


def collection_health(points: DataFrame, manifest: DataFrame, by: str = "repo") -> DataFrame:
    """(repo, state): ``empty`` without points, ``sparse`` with under a tenth of the manifest's files, else ``healthy``."""
    have = points.groupBy(by).agg(F.count_distinct("path").alias("paths"))
    want = manifest.groupBy(by).agg(F.count_distinct("path").alias("files"))
    ratio = F.coalesce("paths", F.lit(0)) / F.col("files")
    state = F.when(F.coalesce("paths", F.lit(0)) == 0, "empty").when(ratio < 0.1, "sparse").otherwise("healthy")
    return want.join(have, by, "left").select(by, "files", F.coalesce("paths", F.lit(0)).cast("bigint").alias("paths"), state.alias("state"))


def by_file(symbols: DataFrame, top: int = 3) -> DataFrame:
    """(file_id, symbols, top_symbols): how many symbols a file has and its most complex ones."""
    w = Window.partitionBy("file_id").orderBy(F.desc("complexity"), "symbol_id")
    best = symbols.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top)
    listed = best.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("_rn", "name"))).alias("_l")).select("file_id", F.array_join(F.col("_l")["name"], ",").alias("top_symbols"))
    return symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols")).join(listed, "file_id")


def callees(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, callee): what the first chunk (least id) that declares a symbol calls; ``chunks``: id, symbol, calls."""
    first = chunks.where("symbol <> ''").join(symbols.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.min_by("calls", "id").alias("calls"))
    return first.select("symbol", F.explode(F.array_distinct(F.coalesce("calls", F.array().cast("array<string>")))).alias("callee"))


def importers(chunks: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, id, strategy): chunks that import a module: exactly (1), by its last part (2), or as part of a longer name (3).

    ``chunks``: id, imports. All three are equi-joins on the parts of the imported name; a chunk counts by its best.
    """
    last = lambda c: F.element_at(F.split(c, r"[./:]+"), -1)
    e = chunks.select("id", F.explode(F.array_distinct(F.coalesce("imports", F.array().cast("array<string>")))).alias("i"))
    m = modules.select("module").distinct()
    exact = e.join(m, F.col("i") == F.col("module")).select("module", "id", F.lit(1).alias("s"))
    base = e.withColumn("b", last(F.col("i"))).join(m.withColumn("b", last(F.col("module"))), "b").select("module", "id", F.lit(2).alias("s"))
    parts = e.select("id", F.explode(F.array_distinct(F.split("i", r"[./:]+"))).alias("p"))
    inside = parts.join(m, F.col("p") == F.col("module")).select("module", "id", F.lit(3).alias("s"))
    return exact.unionByName(base).unionByName(inside).groupBy("module", "id").agg(F.min("s").cast("int").alias("strategy"))


def reachable(edges: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): what can be reached from each node in at most ``hops`` steps, with the fewest of them. ``edges``: a, b.

    The pairs are many times the links. So a graph of at most GRAPH_BYTES goes to every task, which walks from its share of the
    nodes, and no pair is shuffled; a larger one is joined step by step.
    """
    kinds = {edges.schema[c].dataType.simpleString() for c in ("a", "b")}
    whole = edges.select("a", "b").where("a is not null and b is not null")
    if len(kinds) > 1 or not kinds <= {"string", "int", "bigint"}:
        return _joined(whole.distinct(), hops)
    lists = cut_lineage(whole.groupBy("a").agg(F.collect_set("b").alias("bs")))
    length = lambda c: F.octet_length(c.cast("string")).cast("bigint") + 8
    size = lists.agg(F.sum(F.aggregate("bs", length(F.col("a")), lambda n, b: n + length(b)))).first()[0] or 0
    return _walked(lists, hops) if size <= GRAPH_BYTES else _joined(lists.select("a", F.explode("bs").alias("b")), hops)


def _joined(once: DataFrame, hops: int) -> DataFrame:
    """``reachable`` of distinct edges by joins of pairs."""
    found = once.select(F.col("a").alias("start"), F.col("b").alias("node"), F.lit(1).alias("hops"))
    front = found
    for h in range(2, hops + 1):
        step = front.join(once.withColumnsRenamed({"a": "node", "b": "_next"}), "node").select("start", F.col("_next").alias("node")).distinct()
        front = step.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(h))
        found = found.unionByName(front)
    return found


def _walked(lists: DataFrame, hops: int) -> DataFrame:
    """``reachable`` of a graph that fits in memory; ``lists``: a, bs, one row for each node that links lead from."""
    spark, kind = lists.sparkSession, lists.schema["a"].dataType.simpleString()
    held = lists.toArrow()
    starts, ends = held["a"].combine_chunks(), held["bs"].combine_chunks()
    coded = pa.concat_arrays([starts, ends.flatten()]).dictionary_encode()  # in order of appearance: the starts come first
    at = np.zeros(len(coded.dictionary) + 1, np.int64)
    at[1 : len(starts) + 1] = pc.list_value_length(ends).to_numpy(zero_copy_only=False)
    shared = spark.sparkContext.broadcast((coded.dictionary, at.cumsum(), coded.indices.to_numpy(zero_copy_only=False)[len(starts) :]))

    def rows(found: list[tuple[int, int, np.ndarray]], names: pa.Array) -> Iterator[pa.RecordBatch]:
        size = np.array([len(nodes) for *_, nodes in found])
        start, hop = (np.repeat(np.array([x[i] for x in found], np.int32), size) for i in (0, 1))
        node = np.concatenate([x[2] for x in found])
        for lo in range(0, len(node), ROWS):
            part = slice(lo, lo + ROWS)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(start[part])), names.take(pa.array(node[part])), pa.array(hop[part])], ["start", "node", "hops"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, links = shared.value
        seen, place = np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        found: list[tuple[int, int, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            for start in batch.column(0).to_pylist():
                levels = [links[at[start] : at[start + 1]]]
                seen[levels[0]] = True
                while len(levels) < hops and len(levels[-1]):
                    begin = at[levels[-1]]
                    n = at[levels[-1] + 1] - begin
                    last = n.cumsum()
                    new = links[np.arange(last[-1]) + np.repeat(begin - last + n, n)]
                    new = new[~seen[new]]
                    order = np.arange(len(new))
                    place[new] = order
                    new = new[place[new] == order]  # each node once
                    seen[new] = True
                    levels.append(new)
                for h, nodes in enumerate(levels, 1):
                    seen[nodes] = False
                    if len(nodes):
                        found.append((start, h, nodes))
                        waiting += len(nodes)
                if waiting >= ROWS:
                    yield from rows(found, names)
                    found, waiting = [], 0
        if found:
            yield from rows(found, names)

    tasks = max(spark.sparkContext.defaultParallelism, -(-len(starts) // STARTS))
    return spark.range(0, len(starts), 1, tasks).mapInArrow(walk, f"start {kind}, node {kind}, hops int")


#: Path globs of the preset searches.
PRESETS = {"tests": ("*/tests/*", "tests/*", "*test_*", "*_test.*", "*.spec.*", "*.test.*"), "config": ("*.yml", "*.yaml", "*.json", "*.toml", "*.ini", "*config*")}


def preset_points(points: DataFrame, preset: str) -> DataFrame:
    """Points that a preset search runs over."""
    from .filters import where_filters

    return where_filters(points, {"path_glob": list(PRESETS[preset])})


def settings_drift(settings: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint): a hash over each row's settings; a changed one means that the index must be made anew."""
    rest = sorted(c for c in settings.columns if c != key)
    return settings.select(key, F.substring(F.sha2(F.to_json(F.struct(*rest)), 256), 1, 16).alias("fingerprint"))
