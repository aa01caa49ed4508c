"""Problem 6: encoding a corpus with a public byte-level BPE tokenizer.

Texts are split into words by the tokenizer's pattern. Each distinct word is encoded once: its bytes (held as a string
of one character per byte) are folded by Spark's higher-order functions, each step joining the leftmost pair of least
rank, with ranks looked up in literal arrays that form a hash table (two slots per entry). The word dictionary is joined
back: its most frequent part, of bounded size, by a broadcast, the rest by a shuffle on the word; each text's pieces are gathered
once.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

TOKENIZERS = "/opt/tokenizers"
#: Words of more bytes than this are merged with a heap in Arrow batches: the fold copies its arrays once for each merge.
FOLD_BYTES = 1_000
#: Entries of the broadcast part of the word dictionary: words of at most SHORT_BYTES (under 16 MB), and a tenth as many longer ones
#: of at most FOLD_BYTES (some 10 MB at the very most).
HOT_WORDS, SHORT_BYTES = 50_000, 40

_SPACE = r"\t-\r \u0085   -     　"
#: The pre-tokenization pattern of the rank files, with Unicode's white space written out.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

_SEP = "\u0100"  # no byte, so it can part the tokens of a literal
_SLOT_BITS = 17


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[str, int]:
    """Token (a character per byte) -> rank, from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def rank_path(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


@lru_cache(maxsize=4)
def _slots(path: str) -> list[int]:
    """Slot -> rank + 1 (0 if free): each token sits in one of the two slots that its hash gives."""
    ranks = load_ranks(path)
    mask = (1 << _SLOT_BITS) - 1
    where: dict[int, tuple[int, int]] = {}
    slots = [0] * (mask + 1)
    for token, rank in ranks.items():
        h = xxhash.xxh64_intdigest(token.encode(), seed=42)
        where[rank] = (h & mask, (h >> _SLOT_BITS) & mask)
        at, moving = where[rank][0], rank
        for _ in range(500):
            slots[at], out = moving + 1, slots[at] - 1
            if out < 0:
                break
            moving = out
            a, b = where[moving]
            at = b if at == a else a
        else:
            raise ValueError("the hash table is too full")
    return slots


class RankTable:
    """Column expressions over the literal rank table of a rank file."""

    def __init__(self, path: str) -> None:
        ranks = load_ranks(path)
        tokens = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = F.split(F.lit(_SEP.join(tokens)), _SEP)
        self.slots = F.split(F.lit(",".join(map(str, _slots(path)))), ",").cast("array<int>")

    def rank(self, token: Column) -> Column:
        """Rank of a token, null if it is none."""
        mask = (1 << _SLOT_BITS) - 1
        h = F.xxhash64(token)
        both = F.array(h.bitwiseAND(F.lit(mask)).cast("int"), F.shiftrightunsigned(h, _SLOT_BITS).bitwiseAND(F.lit(mask)).cast("int"))
        ranks = F.transform(both, lambda s: F.get(self.slots, s) - 1)
        return F.get(F.filter(ranks, lambda r: F.get(self.tokens, F.when(r >= 0, r)) == token), F.lit(0))

    def fold(self, word: Column) -> Column:
        """Ids of a word: merges folded over its bytes, the leftmost pair of least rank first.

        The fold carries the pieces and the rank of each adjacent pair; a merge looks up only the two pairs that it makes anew.
        """
        bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
        none = F.lit(2**31 - 1)
        rank = lambda token: F.coalesce(self.rank(token), none)
        raw = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        pieces = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.substring(raw, i, F.lit(1)))
        no_ranks = F.array().cast("array<int>")
        ranks = F.when(F.length(raw) > 1, F.transform(F.sequence(F.lit(1), F.length(raw) - 1), lambda i: rank(F.substring(raw, i, F.lit(2))))).otherwise(no_ranks)

        def step(state: Column, _: Column) -> Column:
            p, r = state["p"], state["r"]

            def merge(at: Column) -> Column:
                def around(token: Column) -> Column:
                    left = F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), token)))).otherwise(no_ranks)
                    right = F.when(at + 1 < F.size(p), F.array(rank(F.concat(token, F.get(p, at + 1))))).otherwise(no_ranks)
                    return F.struct(
                        F.concat(F.slice(p, F.lit(1), at - 1), F.array(token), F.slice(p, at + 2, F.size(p))).alias("p"),
                        F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r))).alias("r"),
                    )

                return bind(F.concat(F.get(p, at - 1), F.get(p, at)), around)

            least = F.array_min(r)
            return F.when(least.isNull() | (least == none), state).otherwise(bind(F.array_position(r, least).cast("int"), merge))

        steps = F.when(F.length(raw) > 1, F.sequence(F.lit(2), F.length(raw))).otherwise(no_ranks)
        return F.transform(F.aggregate(steps, F.struct(pieces.alias("p"), ranks.alias("r")), step)["p"], self.rank)

    def decode(self, ids: Column) -> Column:
        """Text of ids: their binary pieces in a row, read as UTF-8."""
        return F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.get(self.tokens, i)), ""), "ISO-8859-1"), "UTF-8")


def merge_long(word: str, ranks: dict[str, int]) -> list[int]:
    """Ids of a word by a heap of ranked pairs: the same merges as the fold in O(n log n)."""
    piece: list[str] = list(word.encode("utf-8", "surrogatepass").decode("latin-1"))
    n = len(piece)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[t], i, t) for i in range(n - 1) if (t := piece[i] + piece[i + 1]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, token = heapq.heappop(heap)
        j = right[i]
        if not piece[i] or j >= n or piece[i] + piece[j] != token:
            continue
        piece[i], piece[j], right[i] = token, "", right[j]
        if right[i] < n:
            left[right[i]] = i
            if (t := token + piece[right[i]]) in ranks:
                heapq.heappush(heap, (ranks[t], i, t))
        if left[i] >= 0 and (t := piece[left[i]] + token) in ranks:
            heapq.heappush(heap, (ranks[t], left[i], t))
    return [ranks[p] for p in piece if p]


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), 0)


def word_dictionary(texts: DataFrame, text_col: str, ranks: str) -> DataFrame:
    """(word, n, ids) of all distinct words of the corpus."""
    counted = texts.select(F.explode(split_words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = cut_lineage(counted.repartition("word"))
    short = F.octet_length("word") <= FOLD_BYTES
    folded = counted.where(short).select("word", "n", RankTable(ranks).fold(F.col("word")).alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = load_ranks(ranks)
        for batch in batches:
            yield batch.assign(ids=[merge_long(w, table) for w in batch["word"]])

    return cut_lineage(folded.unionByName(counted.where(~short).mapInPandas(run, "word string, n bigint, ids array<int>")))


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """(id, ids): the token ids of each document's whole text, without special tokens.

    Null and empty texts have an empty list; blank texts and strings that look like special tokens are ordinary text.
    One row per row of ``documents``, repeated rows included; a null id stays null. Other columns are not read.
    """
    ranks = ranks or rank_path()
    base = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    words = word_dictionary(base, "_text", ranks)
    best = lambda df, n: df.orderBy(F.desc("n"), "word").limit(n).select("word", "ids")
    size = F.octet_length("word")
    hot = cut_lineage(best(words.where(size <= SHORT_BYTES), hot_words).unionByName(best(words.where((size > SHORT_BYTES) & (size <= FOLD_BYTES)), hot_words // 10)))
    # the place of a row in its file split names it: the same for each reading of the same files
    rows = base.withColumn("_row", F.monotonically_increasing_id())
    # outer: a text without words keeps its row
    spread = rows.select("_row", "_id", F.posexplode_outer(split_words(F.col("_text"))).alias("_pos", "word"))
    known = spread.join(F.broadcast(hot), "word", "left").where(F.col("ids").isNotNull() | F.col("word").isNull() | (F.col("_pos") == 0)).select("_row", "_id", "_pos", "ids")
    rare = spread.where("word is not null").join(F.broadcast(hot.select("word")), "word", "left_anti").join(words.select("word", "ids"), "word").select("_row", "_id", "_pos", "ids")
    piece = F.when(F.col("ids").isNotNull(), F.struct("_pos", "ids"))
    listed = known.unionByName(rare).groupBy("_row").agg(F.first("_id").alias("_id"), F.collect_list(piece).alias("_all"))
    ids = F.flatten(F.transform(F.array_sort("_all"), lambda x: x["ids"]))
    return listed.select(F.col("_id").alias(id_col), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """(id, text): the inverse of encode_corpus, up to null texts, which come back empty; null ids give a null text."""
    return encoded.select(id_col, RankTable(ranks or rank_path()).decode(F.col(ids_col)).alias("text"))


__all__ = ["RankTable", "decode_corpus", "encode_corpus", "load_ranks", "merge_long", "rank_path", "split_words", "word_dictionary"]
