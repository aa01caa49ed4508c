"""Problem 3: the most similar vectors of every vector, by an inverted multi-index.

Both halves of a vector are quantised separately by codebooks of K centroids each, which give K x K cells. A query
walks the cells in the order of its summed squared distance to the two centroids, with a heap, passing by cells that
cannot hold a vector within the bound (their radius is known), until ``budget`` entries have been met; without a budget
it walks all cells that can, and the result is exact. The entries of the cells visited are then ranked by exact distance.
K grows with the square root of the number of vectors. The codebooks are fitted on a bounded sample (SAMPLE rows, or
SAMPLE_PER_CENTROID for each centroid if that is more, with the least hashes of their ids); every vector is indexed, and every
vector is a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of the sample; vectors for which a cell is planned; centroids of a codebook: 2,048 give a cell for every 16 of 67 million
#: vectors, and up to 3 billion a cell still holds fewer entries than a query's budget.
SAMPLE, SAMPLE_PER_CENTROID, CELL_ROWS, MAX_K = 20_000, 32, 16, 2_048
#: Entries that a query meets before it stops.
BUDGET = 800
#: Entries of one cell that are compared with a query at a time; larger cells are split into such blocks.
BLOCK = 4_000


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` numbers, none null, NaN or infinite, not all 0."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def to_binary(vectors: DataFrame, dim: int, unit: bool, kind: str = "<f8") -> DataFrame:
    """(id, vec): vectors as packed numbers, of length 1 if ``unit``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["vec"].to_numpy()).astype(np.float64) if len(batch) else np.empty((0, dim))
            if unit and len(x):
                x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"id": batch["id"], "vec": [r.tobytes() for r in x.astype(kind)]})

    return vectors.mapInPandas(run, f"id {vectors.schema['id'].dataType.simpleString()}, vec binary")


def unpack(column: pd.Series, dim: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), dim)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids; empty ones move to the points that lie farthest from theirs."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
        near = d.argmin(1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        if (gone := np.flatnonzero(count == 0)).size:
            c[gone] = x[np.argsort(-d.min(1))[: gone.size]]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0))


def centroids_for(n: int) -> int:
    """Centroids of a codebook for n vectors."""
    return int(np.clip(round((n / CELL_ROWS) ** 0.5), 2, MAX_K))


class MultiIndex:
    """Codebooks of both halves, with cell populations and the radius of each centroid's share."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        k = centroids_for(n)
        self.dim = sample.shape[1]
        self.half = self.dim // 2
        self.books = [kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)]
        self.k = max(len(b) for b in self.books)
        self.counts = np.zeros(self.k * self.k, np.int64)
        self.radii = [np.zeros(len(b)) for b in self.books]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to the first half's centroid, to the second half's)."""
        d = [_distances(h, b) for h, b in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True)]
        near = [m.argmin(1) for m in d]
        rows = np.arange(len(x))
        return near[0] * self.k + near[1], d[0][rows, near[0]], d[1][rows, near[1]]

    def visits(self, x: np.ndarray, radius: float, budget: int | None) -> list[list[int]]:
        """Cells that each query visits, by summed squared distance; without a budget all that can hold a vector within the radius."""
        d1, d2 = _distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])
        o1, o2 = d1.argsort(1), d2.argsort(1)
        s1, s2 = np.take_along_axis(d1, o1, 1) ** 2, np.take_along_axis(d2, o2, 1) ** 2
        low1 = np.take_along_axis(np.maximum(d1 - self.radii[0], 0) ** 2, o1, 1)
        low2 = np.take_along_axis(np.maximum(d2 - self.radii[1], 0) ** 2, o2, 1)
        far, out, counts, k = radius * radius * (1 + 1e-9) + 1e-12, [], self.counts, self.k
        # past these ranks no centroid's share can reach into the bound
        reach1 = np.where(low1 <= far, np.arange(low1.shape[1]), -1).max(1)
        reach2 = np.where(low2 <= far, np.arange(low2.shape[1]), -1).max(1)
        for q in range(len(x)):
            a1, a2, l1, l2, i1, i2 = s1[q], s2[q], low1[q].tolist(), low2[q].tolist(), o1[q].tolist(), o2[q].tolist()
            last1, last2 = int(reach1[q]), int(reach2[q])
            cells: list[int] = []
            if last1 >= 0 and last2 >= 0:
                heap, met = [(a1[0] + a2[0], 0, 0)], 0
                while heap and (budget is None or met < budget):
                    _, i, j = heapq.heappop(heap)
                    cell = i1[i] * k + i2[j]
                    if l1[i] + l2[j] <= far and (number := counts[cell]):
                        cells.append(cell)
                        met += number
                    if j < last2:
                        heapq.heappush(heap, (a1[i] + a2[j + 1], i, j + 1))
                    if j == 0 and i < last1:
                        heapq.heappush(heap, (a1[i + 1] + a2[0], i + 1, 0))
            out.append(cells)
        return out


def _ranked(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, radius: float, k: int) -> list[pd.DataFrame]:
    """The up to k entries within the radius of each query, by exact distance, then id."""
    rough = (queries**2).sum(1)[:, None] - 2 * queries @ vectors.T + (vectors**2).sum(1)
    a, b = np.nonzero(rough <= radius * radius + 1e-6 * (1 + radius))
    keep = ids[a] != names[b]
    a, b = a[keep], b[keep]
    exact = np.sqrt(((queries[a] - vectors[b]) ** 2).sum(1))
    ok = exact <= radius + 1e-12
    frame = pd.DataFrame({"q": ids[a[ok]], "id": names[b[ok]], "dist": exact[ok]}).sort_values(["q", "dist", "id"])
    return [frame.groupby("q", sort=False).head(k)]


def nearest_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, radius: float, k: int = 5, unit: bool = False, budget: int | None = BUDGET) -> DataFrame:
    """(q, id, dist): for every vector up to ``k`` nearest others within ``radius`` (Euclidean; with ``unit`` between the
    vectors scaled to length 1, where a cosine of c is a distance of sqrt(2 - 2c)). Ties go to the smaller id.

    Unusable vectors and rows with a null id take no part; ids must be unique (repeated rows count once). Of equal
    vectors only the k + 1 with the least ids are indexed; any further copy has the k least as its nearest at distance 0.
    With ``budget=None`` the result is exact.
    """
    picked = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable(F.col("vec"), dim)).dropDuplicates(["id"])
    packed = to_binary(picked, dim, unit)
    packed = cut_lineage(packed)
    # the limit on the rank cuts a hot vector to k + 1 rows in each partition before the shuffle
    ranked = cut_lineage(packed.withColumn("_rn", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_rn") <= k + 1))
    base = ranked.select("id", "vec")
    full = ranked.where(F.col("_rn") == k + 1).select("vec")
    least = ranked.where(F.col("_rn") <= k).join(full, "vec", "left_semi").select("vec", F.col("id").alias("_n"))
    more = packed.join(full, "vec", "left_semi").join(base.select("id"), "id", "left_anti").select(F.col("id").alias("q"), "vec")
    copies = more.join(least, "vec").select("q", F.col("_n").alias("id"), F.lit(0.0).alias("dist"))
    n = base.count()
    kind = ranked.schema["id"].dataType.simpleString()
    schema = f"q {kind}, id {kind}, dist double"
    if n < 2:
        return copies
    sample = base.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, SAMPLE_PER_CENTROID * centroids_for(n))).toPandas()
    index = MultiIndex(unpack(sample["vec"], dim), n)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, r1, r2 = index.assign(unpack(batch["vec"], dim))
            yield batch.assign(cell=cell, r1=r1, r2=r2)

    cells = cut_lineage(base.mapInPandas(assign, f"id {kind}, vec binary, cell int, r1 double, r2 double"))
    # at most K x K and K rows: bounded by the codebooks, not by the data
    held = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()
    index.counts[held["cell"]] = held["n"]
    for half, (column, code) in enumerate((("r1", F.floor(F.col("cell") / index.k)), ("r2", F.col("cell") % index.k))):
        for r in cells.groupBy(code.cast("int").alias("c")).agg(F.max(column).alias("r")).collect():
            index.radii[half][r["c"]] = r["r"] * (1 + 1e-9) + 1e-9
    blocks = {int(c): int(-(-index.counts[c] // BLOCK)) for c in np.flatnonzero(index.counts > BLOCK)}

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number = np.array([blocks.get(c, 1) for c in batch["cell"]])
            block = pd.util.hash_array(batch["id"].to_numpy(dtype=object)) % number if len(batch) else []
            yield pd.DataFrame({"cell": batch["cell"], "block": np.asarray(block, dtype=np.int32), "part": 0, "id": batch["id"], "vec": batch["vec"]})
            for lo in range(0, len(batch), 2000):
                piece = batch.iloc[lo : lo + 2000]
                seen = index.visits(unpack(piece["vec"], dim), radius, budget)
                rows = [(c, b, i, v) for i, v, visited in zip(piece["id"], piece["vec"], seen, strict=True) for c in visited for b in range(blocks.get(c, 1))]
                if rows:
                    cell, blk, ids, vec = zip(*rows, strict=True)
                    yield pd.DataFrame({"cell": cell, "block": blk, "part": 1, "id": ids, "vec": vec})

    routed = cells.select("id", "vec", "cell").mapInPandas(spread, f"cell int, block int, part int, id {kind}, vec binary")
    ordered = routed.repartition("cell", "block").sortWithinPartitions("cell", "block", "part")

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A cell's entries come first and fit into memory; its queries stream by."""
        place, names, held = None, [], []
        for batch in batches:
            if not len(batch):
                continue
            x = unpack(batch["vec"], dim)
            ids, part = batch["id"].to_numpy(dtype=object), batch["part"].to_numpy()
            code = batch["cell"].to_numpy().astype(np.int64) * 2**31 + batch["block"].to_numpy()
            edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            out = []
            for lo, hi in zip(edges, np.r_[edges[1:], len(code)], strict=True):
                if code[lo] != place:
                    place, names, held = code[lo], [], []
                cut = lo + int((part[lo:hi] == 0).sum())
                if cut > lo:
                    names.append(ids[lo:cut])
                    held.append(x[lo:cut])
                if cut < hi and held:
                    names, held = [np.concatenate(names)], [np.concatenate(held)]
                    for s in range(cut, hi, 1000):
                        e = min(s + 1000, hi)
                        out += _ranked(x[s:e], ids[s:e], held[0], names[0], radius, k)
            if out:
                yield pd.concat(out)

    found = ordered.mapInPandas(rank, schema)
    best = found.withColumn("_rn", F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))).where(F.col("_rn") <= k).drop("_rn")
    return best.unionByName(copies)


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of pairs of which one is among the nearest of the other."""
    return neighbours.select(F.least("q", "id").alias("id_a"), F.greatest("q", "id").alias("id_b")).distinct()
