"""Problem 1: records that share most of their content.

DartMinHash: every element of a weighted set owns the region [0, weight) x [0, infinity) of a weight-by-rank plane.
Pseudo-random darts, determined by the element alone, are thrown at unit-area tiles of that plane; a dart counts if its
weight lies below the element's weight. Each dart belongs to one of k coordinates, and a coordinate keeps its dart of
least rank. Two sets agree in a coordinate with a probability of their weighted Jaccard similarity. Tiles are walked only
up to the rank at which about ``k ln k + 2k`` darts have been seen, so a sketch costs O(size + k log k).

Coordinates are joined in bands; candidates are checked exactly on the sets' 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BANDS, ROWS = 32, 4
#: Members of a band bucket up to which its pairs are candidates at once; larger buckets go through the prefix join.
BUCKET_PAIRS = 256
#: Members of a class of equal sets in one block; the pairs of larger classes are made block by block, so no task makes more than its square at once.
PAIR_BLOCK = 512
#: Ids up to which a set of wanted items is broadcast (about 16 MB); beyond it is shuffled.
BROADCAST_IDS = 1_000_000

_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15
#: Cumulative Poisson(1) probabilities, for the number of darts in a tile.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around on purpose."""
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _const(*parts: int) -> np.uint64:
    value = _GOLD
    for p in parts:
        value = ((value ^ (p + 0x632BE59BD9B4E019)) * 0xD6E8FEB86659FD93) & (2**64 - 1)
        value ^= value >> 32
    return np.uint64(value)


def _darts(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, theta: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, rank, dart id) of all darts with rank < theta that hit the elements' regions."""
    owners, ranks, ids = [], [], []
    top_nu = int(math.log2(1 + weight.max(initial=0.0)))
    for nu in range(top_nu + 1):
        heavy = weight > 2.0**nu - 1
        limit = theta[heavy].max(initial=0.0)
        for rho in range(int(math.log2(1 + limit)) + 1):
            live = np.flatnonzero(heavy & (theta > 2.0**rho - 1))
            if not len(live):
                continue
            width, height = 2.0 ** (nu - rho), 2.0 ** (rho - nu)
            # tiles: 2^rho by weight, 2^nu by rank, each of area 1
            per = 1 << (rho + nu)
            for part in np.array_split(live, max(1, len(live) * per // 2_000_000)):
                who = np.repeat(part, per)
                tile = np.tile(np.arange(per, dtype=np.uint64), len(part))
                w0 = 2.0**nu - 1 + (tile & np.uint64((1 << rho) - 1)).astype(np.float64) * width
                r0 = 2.0**rho - 1 + (tile >> np.uint64(rho)).astype(np.float64) * height
                ok = (w0 < weight[who]) & (r0 < theta[who])
                who, tile, w0, r0 = who[ok], tile[ok], w0[ok], r0[ok]
                base = _mix((element[who] ^ _const(seed, nu, rho)) + tile * np.uint64(_GOLD))
                number = np.searchsorted(_POISSON, _unit(base), side="right")
                for j in range(int(number.max(initial=0))):
                    has = number > j
                    h = _mix(base[has] + _const(seed, 7, j))
                    rank = r0[has] + _unit(h) * height
                    at = w0[has] + _unit(_mix(h ^ _const(seed, 11))) * width
                    hit = (at < weight[who[has]]) & (rank < theta[who[has]])
                    owners.append(owner[who[has]][hit])
                    ranks.append(rank[hit])
                    ids.append(_mix(h[hit] ^ _const(seed, 13)))
    if not owners:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64)
    return np.concatenate(owners), np.concatenate(ranks), np.concatenate(ids)


def dart_minhash(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None, seed: int = 1) -> np.ndarray:
    """Signatures (len(sets) x k, uint64) of non-empty weighted sets of 64-bit elements; weights are 1 if not given."""
    n = len(sets)
    out = np.zeros((n, k), dtype=np.uint64)
    darts = k * math.log(k) + 2 * k
    todo = np.arange(n)
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        element = _mix(np.concatenate([np.asarray(sets[i]).astype(np.int64).view(np.uint64) for i in todo]) + _const(seed))
        weight = np.concatenate([weights[i] for i in todo]).astype(float) if weights else np.ones(len(element))
        owner = np.repeat(np.arange(len(todo)), sizes)
        total = np.maximum(np.bincount(owner, weights=weight, minlength=len(todo)), 1e-300)
        who, rank, dart = _darts(element, weight, owner, np.repeat(darts / total, sizes), seed)
        slot = who * k + (dart % np.uint64(k)).astype(np.int64)
        least = np.full(len(todo) * k, np.inf)
        np.minimum.at(least, slot, rank)
        first = rank == least[slot]
        signature = np.zeros(len(todo) * k, dtype=np.uint64)
        signature[slot[first]] = dart[first]
        full = np.isfinite(least).reshape(len(todo), k).all(axis=1)
        out[todo[full]] = signature.reshape(len(todo), k)[full]
        todo, darts = todo[~full], darts * 2  # a coordinate without a dart: look at twice the ranks
    return out


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value for each run of ``rows`` coordinates."""
    n, k = signatures.shape
    grouped = signatures.reshape(n, k // rows, rows)
    value = np.full((n, k // rows), _const(5), dtype=np.uint64)
    for j in range(rows):
        value = _mix((value ^ grouped[:, :, j]) + np.uint64(_GOLD))
    return (value + np.arange(k // rows, dtype=np.uint64)).view(np.int64)


def shingle_hashes(text: Column, words: int = 3, pattern: str = "[a-z0-9_]+") -> Column:
    """Distinct 64-bit hashes of all runs of ``words`` tokens of the lower-cased text; empty for shorter texts."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)

    def shingles(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(t) - words), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(words)]))
        return F.array_distinct(F.when(F.size(t) >= words, runs).otherwise(F.array().cast("array<bigint>")))

    # transform over a one-element array binds the tokens once
    return F.get(F.transform(F.array(tokens), shingles), F.lit(0))


def _sketches(hashed: DataFrame, bands: int, rows: int, seed: int) -> DataFrame:
    """(item, h1, h2, m, bands): the band values of each item's set, whose class is told by two hashes and its size."""
    ordered = hashed.select("item", F.sort_array("sh").alias("sh")).select("item", F.xxhash64("sh").alias("h1"), F.hash("sh").alias("h2"), F.size("sh").alias("m"), "sh")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                values = band_hashes(dart_minhash(list(part["sh"]), bands * rows, seed=seed), rows)
                yield part[["item", "h1", "h2", "m"]].assign(bands=list(values))

    kind = ordered.schema["item"].dataType.simpleString()
    return ordered.mapInPandas(run, f"item {kind}, h1 bigint, h2 int, m int, bands array<bigint>")


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact candidates among ``sets``: pairs that share an element of their prefixes, rarest elements first.

    Two sets of similarity >= t always share one of their first size - ceil(t * size) + 1 elements in any common order.
    """
    elements = sets.select("rep", F.explode("sh").alias("e"))
    df = elements.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    ordered = elements.join(df, "e").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("s"))
    size = F.size("s")
    prefix = ordered.select("rep", size.alias("m"), F.explode(F.slice("s", 1, (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))["e"]).alias("e"))
    a, b = prefix.alias("a"), prefix.alias("b")
    near = (F.col("a.m") >= threshold * F.col("b.m") - 1e-9) & (F.col("b.m") >= threshold * F.col("a.m") - 1e-9)
    return a.join(b, (F.col("a.e") == F.col("b.e")) & (F.col("a.rep") < F.col("b.rep")) & near).select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"))


def _hashed(items: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    return items.select(F.col(id_col).alias("item"), shingle_hashes(F.col(text_col), words).alias("sh")).where(F.col("item").isNotNull() & (F.size("sh") > 0))


def _only(df: DataFrame, key: str, wanted: DataFrame, rows: int) -> DataFrame:
    """Rows of ``df`` whose key is in ``wanted`` (``rows`` of them): a broadcast up to BROADCAST_IDS, else a shuffle."""
    return df.join(F.broadcast(wanted) if rows <= BROADCAST_IDS else wanted, key, "left_semi")


def similar_classes(
    items: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, words: int = 3,
    bands: int = BANDS, rows: int = ROWS, bucket_pairs: int = BUCKET_PAIRS, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(members: item, rep, n_members; links: rep_a, rep_b, inter, uni).

    A class holds the items of equal shingle sets, rep is its least id; links are the pairs of classes with a Jaccard
    similarity of at least ``threshold``. Band buckets of more than ``bucket_pairs`` classes are not expanded: their
    classes go through an exact prefix join, so no link is lost. A pair of similarity s is missed with a probability of
    (1 - s**rows)**bands. Shingle sets are never shuffled for all items: only narrow sketches are, and the texts of
    those items that are in a candidate pair are read once more.
    """
    sketches = cut_lineage(_sketches(_hashed(items, id_col, text_col, words), bands, rows, seed))
    key = ["h1", "h2", "m"]
    reps = sketches.groupBy(*key).agg(F.min("item").alias("rep"), F.count_distinct("item").alias("n_members"))
    members = cut_lineage(sketches.select("item", *key).distinct().join(reps, key).select("item", "rep", "n_members"))
    own = members.where("item = rep").select("rep", "n_members")
    one = sketches.select(F.col("item").alias("rep"), "bands").join(own.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    banded = cut_lineage(one.select("rep", F.explode("bands").alias("band")))
    # counted map-side first: a hot band is a few rows here, and its join below is split by its skew
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = banded.join(sizes, "band")
    usual = shared.where(F.col("n") <= bucket_pairs)
    a, b = usual.alias("a"), usual.alias("b")
    pairs = cut_lineage(a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.rep") < F.col("b.rep"))).select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b")).distinct())
    crowded = cut_lineage(shared.where(F.col("n") > bucket_pairs).select("rep").distinct())
    if not crowded.isEmpty():
        sets = _hashed(_only(items.select(id_col, text_col), id_col, crowded.withColumnRenamed("rep", id_col), crowded.count()), id_col, text_col, words)
        pairs = cut_lineage(pairs.unionByName(_prefix_pairs(sets.dropDuplicates(["item"]).withColumnRenamed("item", "rep"), threshold)).distinct())
    involved = cut_lineage(pairs.select(F.explode(F.array("rep_a", "rep_b")).alias(id_col)).distinct())
    wanted = _hashed(_only(items.select(id_col, text_col), id_col, involved, involved.count()), id_col, text_col, words).dropDuplicates(["item"])
    both = pairs.join(wanted.select(F.col("item").alias("rep_a"), F.col("sh").alias("sh_a")), "rep_a").join(wanted.select(F.col("item").alias("rep_b"), F.col("sh").alias("sh_b")), "rep_b")
    counted = both.select("rep_a", "rep_b", F.size(F.array_intersect("sh_a", "sh_b")).alias("inter"), (F.size("sh_a") + F.size("sh_b")).alias("both"))
    links = counted.select("rep_a", "rep_b", "inter", (F.col("both") - F.col("inter")).alias("uni"))
    return members, links.where(F.col("inter") >= threshold * F.col("uni") - 1e-9)


def _speakers(members: DataFrame, items: DataFrame, id_col: str, text_col: str, copies: int) -> tuple[DataFrame, DataFrame]:
    """(members without the copies of a text beyond its least id, star: least id, copy) where a text has more than ``copies`` copies."""
    texts = items.select(F.col(id_col).alias("item"), F.sha2(F.col(text_col), 256).alias("_t")).dropDuplicates(["item"])
    told = members.where(F.col("n_members") > copies).join(texts, "item")
    least = told.groupBy("rep", "_t").agg(F.min("item").alias("_least"), F.count(F.lit(1)).alias("_n"))
    star = told.join(least.where(F.col("_n") > copies), ["rep", "_t"]).where("item <> _least").select(F.col("_least").alias("id_a"), F.col("item").alias("id_b"), F.lit(1.0).alias("similarity"))
    star = cut_lineage(star)
    return members.join(star.select(F.col("id_b").alias("item")), "item", "left_anti"), star


def near_duplicate_pairs(items: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, words: int = 3, class_pairs: int | None = None, pair_block: int = PAIR_BLOCK, **banding: int) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, of items whose shingle sets have at least the given similarity.

    Items with a null id, or with null, empty or too short texts (no shingle), are in no pair. Repeated rows count once. All
    pairs are listed, whatever the size of a class of equal sets; classes of more than ``pair_block`` members are paired block
    by block. Only where ``class_pairs`` is given, the copies of one exact text beyond that number are listed as a star around
    their least id, which then stands for them in all other pairs; no pair of different texts' least ids is lost by that.
    Other columns are not read.
    """
    members, links = similar_classes(items, id_col, text_col, threshold, words, **banding)
    speakers, star = (members, None) if class_pairs is None else _speakers(members, items, id_col, text_col, class_pairs)
    blocks = F.ceil(F.col("n_members") / pair_block).cast("int")
    placed = speakers.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    spread = placed.where("n_members > 1").select("item", "rep", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("item", "rep", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    x, y = spread.alias("x"), spread.alias("y")
    met = (F.col("x.rep") == F.col("y.rep")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    once = (F.col("x.lo") == F.col("x.hi")) | (F.col("x.block") != F.col("y.block"))
    within = x.join(y, met & once & (F.col("x.item") < F.col("y.item"))).select(F.col("x.item").alias("id_a"), F.col("y.item").alias("id_b"), F.lit(1.0).alias("similarity"))
    wide = members.where((F.col("item") == F.col("rep")) & (F.col("n_members") > pair_block)).select("rep", blocks.alias("blocks"))
    every = lambda side: F.explode(F.sequence(F.lit(0), F.coalesce(f"blocks_{side}", F.lit(1)) - 1))
    across = (
        links.select("rep_a", "rep_b", (F.col("inter") / F.col("uni")).alias("similarity"))
        .join(wide.select(F.col("rep").alias("rep_a"), F.col("blocks").alias("blocks_a")), "rep_a", "left")
        .join(wide.select(F.col("rep").alias("rep_b"), F.col("blocks").alias("blocks_b")), "rep_b", "left")
        .withColumn("block_a", every("a")).withColumn("block_b", every("b"))
        .join(placed.select(F.col("rep").alias("rep_a"), F.col("block").alias("block_a"), F.col("item").alias("p")), ["rep_a", "block_a"])
        .join(placed.select(F.col("rep").alias("rep_b"), F.col("block").alias("block_b"), F.col("item").alias("q")), ["rep_b", "block_b"])
        .select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "similarity")
    )
    pairs = within.unionByName(across)
    return pairs if star is None else pairs.unionByName(star)


def near_duplicate_classes(items: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, words: int = 3, **banding: int) -> DataFrame:
    """(item, class_id, n_members, n_links): each item with the least id of its class of equal sets, the size of that
    class and the number of other classes that it is similar to. Items without a shingle are left out."""
    members, links = similar_classes(items, id_col, text_col, threshold, words, **banding)
    degree = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(degree, "rep", "left").select("item", F.col("rep").alias("class_id"), "n_members", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


__all__ = ["band_hashes", "dart_minhash", "near_duplicate_classes", "near_duplicate_pairs", "shingle_hashes", "similar_classes"]
