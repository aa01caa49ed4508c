"""Problem 7: evaluation texts leaking into training text.

A positional inverted index over the training corpus: the terms are pairs of adjacent words, a posting is (term,
document, position). For every window of words whose exact occurrence would count as a leak, the window's rarest two
test terms are taken; the rarest one's postings are intersected with the offset-adjusted postings of the second, and what is
left is compared word by word around that alignment. An index made for one evaluation set keeps postings of its terms only:
no other posting can take part in a match, while term frequencies cover all documents. ``write_index`` stores the
postings of all terms, for evaluation sets to come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

RUN_WORDS, LEAST_WORDS = 12, 6
#: Bytes up to which what grows with the evaluation set (its terms, word lists, anchors) is broadcast; beyond it is joined by a shuffle.
BROADCAST_BYTES = 32_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; null has none. Only ASCII letters are folded."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), 0), F.lower)


def pair_terms(words: Column) -> Column:
    """64-bit term of each pair of adjacent words, in order."""
    def pairs(w: Column) -> Column:
        return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def test_items(items: DataFrame, id_col: str, text_col: str, run: int = RUN_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """(item_id, words, need): items of at least ``least`` words; ``need`` is the number of words in a row that leaks."""
    w = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
    return w.where(F.size("words") >= least).distinct().withColumn("need", F.least(F.size("words"), F.lit(run)))


def all_postings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, term): where each document holds each term."""
    return documents.select(F.col(id_col).alias("doc_id"), F.posexplode(pair_terms(words_of(F.col(text_col)))).alias("pos", "term"))


def write_index(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", files: int = 200) -> None:
    """Stores the postings of all terms of a corpus, in ranges of terms, so that a scan for few terms skips most row groups."""
    postings = all_postings(documents.where(F.col(id_col).isNotNull()), id_col, text_col)
    postings.repartitionByRange(files, "term", "doc_id").sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(path)


def _hinted(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


class PositionalIndex:
    """Postings of the training corpus for the terms of an evaluation set."""

    def __init__(self, documents: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> None:
        self.documents = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
        self.tests = cut_lineage(tests)
        terms = cut_lineage(self.tests.select(F.explode(pair_terms(F.col("words"))).alias("term")).distinct())
        size = F.aggregate("words", F.lit(0), lambda s, w: s + F.octet_length(w) + 16)
        self.test_bytes = self.tests.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        every = all_postings(self.documents, "doc_id", "_text") if index is None else index.select("doc_id", "pos", "term")
        self.postings = cut_lineage(every.join(_hinted(terms, 16 * terms.count()), "term", "left_semi"))

    def anchors(self) -> DataFrame:
        """(item_id, p1, t1, p2, t2): the rarest two terms of each window; windows with an unseen term are left out."""
        frequency = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        placed = self.tests.select("item_id", "words", "need", F.posexplode(pair_terms(F.col("words"))).alias("p", "term"))
        listed = placed.join(frequency, "term", "left").groupBy("item_id", "words", "need").agg(F.array_sort(F.collect_list(F.struct("p", "df", "term"))).alias("all"))
        starts = F.sequence(F.lit(0), F.size("words") - F.col("need"))
        windows = listed.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("all", s + 1, F.col("need") - 1))).alias("w")).where(F.forall("w", lambda x: x["df"].isNotNull()))
        rarest = F.array_sort(F.transform("w", lambda x: F.struct(x["df"].alias("df"), x["p"].alias("p"), x["term"].alias("term"))))
        picked = windows.select("item_id", F.get(rarest, F.lit(0)).alias("a"), F.get(rarest, F.lit(1)).alias("b"))
        return cut_lineage(picked.select("item_id", F.col("a.p").alias("p1"), F.col("a.term").alias("t1"), F.col("b.p").alias("p2"), F.col("b.term").alias("t2")).distinct())

    def alignments(self) -> DataFrame:
        """(doc_id, item_id, diag): word i of the item may stand at word diag + i of the document."""
        a = self.anchors()
        a = _hinted(a, 64 * a.count())
        first = self.postings.join(a, F.col("term") == F.col("t1")).select("doc_id", "item_id", (F.col("pos") - F.col("p1")).alias("diag"), F.col("t2").alias("term"), (F.col("pos") - F.col("p1") + F.col("p2")).alias("pos"))
        return first.join(self.postings, ["term", "doc_id", "pos"], "left_semi").select("doc_id", "item_id", "diag").distinct()

    def phrase_matches(self) -> DataFrame:
        """(doc_id, item_id, run_words): the longest run of an item's words in a document, where it is long enough."""
        at = cut_lineage(self.alignments())
        held = self.documents.join(at.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words_of(F.col("_text")).alias("dw"))
        both = at.join(_hinted(self.tests, self.test_bytes), "item_id").join(held, "doc_id")
        flags = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.when(F.get("dw", F.col("diag") + i) == F.get("words", i), F.lit("1")).otherwise(F.lit("0")))
        runs = both.select("doc_id", "item_id", "need", F.array_max(F.transform(F.split(F.array_join(flags, ""), "0+"), F.length)).alias("run"))
        return runs.where("run >= need").groupBy("doc_id", "item_id").agg(F.max("run").cast("int").alias("run_words"))

    def proximity_matches(self, slop: int = 8, least: int = 1) -> DataFrame:
        """(doc_id, item_id, windows): in how many of an item's windows, at least ``least``, the two rarest terms stand in the
        document in places at most ``slop`` words off their distance in the item."""
        a = self.anchors()
        a = _hinted(a, 64 * a.count())
        first = self.postings.join(a, F.col("term") == F.col("t1")).select("doc_id", "item_id", "p1", F.col("t2").alias("term"), (F.col("pos") - F.col("p1") + F.col("p2")).alias("want"))
        near = first.join(self.postings, ["term", "doc_id"]).where(F.abs(F.col("pos") - F.col("want")) <= slop)
        return near.groupBy("doc_id", "item_id").agg(F.count_distinct("p1", "term").alias("windows")).where(F.col("windows") >= least)


def leaked_documents(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, run_words) of documents that hold ``run`` words of an item in a row, or all of a shorter item.

    Items of fewer than ``least`` words never count. Null and empty texts match nothing, rows with a null id are left
    out; repeated rows give one result. Other columns are not read.
    """
    return PositionalIndex(documents, test_items(items, item_id, item_text, run, least), doc_id, doc_text).phrase_matches()
