"""Queries of retrieval, fusion, ranking quality and post-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, tokens
from ..operators import expand, filters, graph, metrics, postprocess, rerank, retrieve
from ..plans import hybrid
from ..session import cut_lineage, rounded, table
from .base import CHUNKS, chunks, query, sql_tokens

# The query vectors are the stated set of ids divisible by 20, held against all rows.
DENSE_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6) AS score
 FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
dense AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10)"""


def _dense(spark, root) -> DataFrame:
    e = table(spark, root, "embeddings")
    return retrieve.dense_topk(e.where("vec_id % 20 = 0"), e, 10)


@query("dense_topk", DENSE_SQL + " SELECT query_id, id, score, rank FROM dense")
def dense_topk(spark, root):
    return _dense(spark, root)


def _judged(spark, root) -> DataFrame:
    e = table(spark, root, "embeddings")
    labels = e.select(F.col("vec_id").alias("id"), F.col("label").alias("l"))
    sizes = e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    q = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")).join(F.broadcast(sizes), F.col("ql") == sizes["label"]).drop("label")
    return _dense(spark, root).join(labels, "id").join(q, "query_id").withColumn("relevant", F.col("l") == F.col("ql"))


@query("ranking_quality", DENSE_SQL + """, j AS (SELECT d.*, (a.label = b.label) AS relevant, n.n AS n_relevant FROM dense d JOIN v a ON a.vec_id = d.id JOIN v b ON b.vec_id = d.query_id
 JOIN (SELECT label, count(*) - 1 AS n FROM v GROUP BY label) n ON n.label = b.label)
SELECT query_id, round(coalesce(1.0::DOUBLE / min(CASE WHEN relevant THEN rank END), 0), 6)::DOUBLE AS mrr,
 round(sum(CASE WHEN relevant THEN 1.0::DOUBLE / log2(rank + 1.0::DOUBLE) ELSE 0 END) / list_sum(list_transform(generate_series(1, greatest(least(max(n_relevant), 10), 1)), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))), 6)::DOUBLE AS ndcg,
 round(sum(CASE WHEN relevant THEN 1 ELSE 0 END)::DOUBLE / max(n_relevant), 6)::DOUBLE AS recall,
 round(sum(CASE WHEN relevant THEN 1 ELSE 0 END)::DOUBLE / least(count(*), 10), 6)::DOUBLE AS precision_returned,
 round(sum(CASE WHEN relevant THEN 1 ELSE 0 END)::DOUBLE / 10, 6)::DOUBLE AS precision_k,
 (sum(CASE WHEN relevant THEN 1 ELSE 0 END) > 0)::INT AS hit FROM j GROUP BY query_id""")
def ranking_quality(spark, root):
    return metrics.ranking_quality(_judged(spark, root))


@query("pass_at_k", DENSE_SQL + """, t AS (SELECT query_id, id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 2),
 n AS (SELECT t.query_id, count(d.id) AS found, count(*) AS truth FROM t LEFT JOIN (SELECT query_id, id FROM dense JOIN v ON v.vec_id = dense.id WHERE label % 2 = 0) d USING (query_id, id) GROUP BY t.query_id)
SELECT query_id, found = truth AS passed FROM n""")
def pass_at_k(spark, root):
    """Whether a query's whole truth (its two nearest) is among what a list of the nearest with an even label returns."""
    e = table(spark, root, "embeddings")
    near = cut_lineage(_dense(spark, root))
    even = near.join(e.where("label % 2 = 0").select(F.col("vec_id").alias("id")), "id")
    return metrics.pass_at_k(even, near.where("rank <= 2"), 10)


def _lists_sql(name: str, p: str, dim: int | None = None) -> str:
    """CTEs that end in the ranked list ``name``; p keeps the names of two lists apart."""
    h = "('0x' || substr(md5(t), 1, 8))::BIGINT" + (f" % {dim}" if dim else "")
    parts = []
    for side, source, key in (("q", "eval_item", "item_id"), ("c", "documents", "doc_id")):
        raw, w = f"{p}{side}", "tf / n" if dim else "tf::DOUBLE"
        parts.append(f"{raw} AS (SELECT {key} AS id, {h} AS term, count(*) AS tf FROM (SELECT {key}, unnest({sql_tokens('text', True)}) AS t FROM {source}) GROUP BY ALL)")
        if dim:
            parts.append(f"{raw}n AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM {raw} GROUP BY id)")
        parts.append(f"{raw}w AS (SELECT id, term, {w} AS w FROM {raw}" + (f" JOIN {raw}n USING (id))" if dim else ")"))
    parts.append(f"{name} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, c.id AS id, round(sum(q.w * c.w), 6) AS score FROM {p}qw q JOIN {p}cw c USING (term) GROUP BY ALL) QUALIFY rank <= 10)")
    return ", ".join(parts)


LEX_SQL = "WITH " + _lists_sql("lex", "l")
HASHED_SQL = "WITH " + _lists_sql("hashed", "h", 4096)
BOTH_SQL = LEX_SQL + ", " + _lists_sql("hashed", "h", 4096)


def _texts(spark, root) -> tuple[DataFrame, DataFrame]:
    return table(spark, root, "eval_item").select(F.col("item_id").alias("id"), "text"), table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text")


def _lexical(spark, root) -> DataFrame:
    return cut_lineage(retrieve.lexical_scan(*_texts(spark, root), 10))


@query("lexical_topk", LEX_SQL + " SELECT query_id, id, score, rank FROM lex")
def lexical_topk(spark, root):
    return retrieve.lexical_scan(*_texts(spark, root), 10)


def _hashed(spark, root):
    return cut_lineage(retrieve.lexical_scan(*_texts(spark, root), 10, dim=4096, norm_queries=True, norm_corpus=True))


def _postings(spark, root, dim=None):
    return retrieve.postings(table(spark, root, "eval_item"), "item_id", "text", dim), retrieve.postings(table(spark, root, "documents"), "doc_id", "text", dim)


@query("sparse_dot_join", LEX_SQL + " SELECT query_id, id, score, rank FROM lex")
def sparse_dot_join(spark, root):
    """The same list from two tables of postings."""
    return retrieve.lexical_topk(*_postings(spark, root), 10)


@query("lexical_hash_topk", HASHED_SQL + " SELECT query_id, id, score, rank FROM hashed")
def lexical_hash_topk(spark, root):
    return _hashed(spark, root)


@query("rrf_fusion", BOTH_SQL + """,
 f AS (SELECT query_id, id, round(sum(p), 9) AS score FROM (SELECT query_id, id, 1.0::DOUBLE / (30 + rank) AS p FROM lex UNION ALL SELECT query_id, id, 1.25::DOUBLE * (1.0::DOUBLE / (30 + rank)) FROM hashed) GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 10""")
def rrf_fusion(spark, root):
    lex = _lexical(spark, root)
    return retrieve.fuse([(lex, 1.0), (_hashed(spark, root), 1.25)])


@query("score_normalisation", LEX_SQL + """, s AS (SELECT query_id, avg(score) AS m, stddev_pop(score) AS d FROM lex GROUP BY query_id)
SELECT query_id, id, score, rank, round(CASE WHEN d > 0 THEN 1 / (1 + exp(-0.5::DOUBLE * (score - m) / d)) ELSE 0.5 END, 6)::DOUBLE AS norm FROM lex JOIN s USING (query_id)""")
def score_normalisation(spark, root):
    lex = _lexical(spark, root)
    return retrieve.normalise_scores(lex)


@query("topk_overlap", BOTH_SQL + """,
 i AS (SELECT query_id, count(*) AS n FROM lex JOIN hashed USING (query_id, id) GROUP BY query_id), a AS (SELECT query_id, count(*) AS n FROM lex GROUP BY query_id), b AS (SELECT query_id, count(*) AS n FROM hashed GROUP BY query_id)
SELECT a.query_id, round(coalesce(i.n, 0)::DOUBLE / (a.n + b.n - coalesce(i.n, 0)), 6) AS overlap FROM a JOIN b USING (query_id) LEFT JOIN i USING (query_id)""")
def topk_overlap(spark, root):
    lex, hashed = _lexical(spark, root), _hashed(spark, root)
    a, b = (x.groupBy("query_id").agg(F.collect_set("id").alias(n)) for x, n in ((lex, "a"), (hashed, "b")))
    return a.join(b, "query_id").select("query_id", rounded(tokens.jaccard(F.col("a"), F.col("b"))).alias("overlap"))


@query("kendall_tau", BOTH_SQL + """,
 p AS (SELECT query_id, id, lex.rank AS a, hashed.rank AS b FROM lex JOIN hashed USING (query_id, id))
SELECT x.query_id, round(avg(CASE WHEN (x.a - y.a) * (x.b - y.b) > 0 THEN 1.0 ELSE -1.0 END::DOUBLE), 6) AS tau FROM p x JOIN p y ON x.query_id = y.query_id AND x.id < y.id GROUP BY x.query_id""")
def kendall_tau(spark, root):
    lex, hashed = _lexical(spark, root), _hashed(spark, root)
    return metrics.kendall_tau(lex.select("query_id", "id", F.col("rank").alias("a")).join(hashed.select("query_id", "id", F.col("rank").alias("b")), ["query_id", "id"]))


@query("entity_dedup_path_cap", LEX_SQL + """, d AS (SELECT lex.*, doc.source AS source, coalesce(doc.repo, '') AS path FROM lex JOIN documents doc ON doc.doc_id = lex.id),
 e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, source, path ORDER BY rank) = 1), p AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY rank) <= 2)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5""")
def entity_dedup_path_cap(spark, root):
    lex = _lexical(spark, root)
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "source", F.coalesce("repo", F.lit("")).alias("path"))
    one = postprocess.first_per_entity(lex.join(docs, "id"), "query_id", ["source", "path"])
    return postprocess.cap_per_path(one, "query_id", 2, 5).select("query_id", "id", "rank")


def _points(spark, root):
    c = cut_lineage(chunks(spark, root, "path", "start_line", "end_line", "chunk_text", "last_modified_at"))
    return c.select(
        "id", "path", hybrid.declared_symbol(F.col("chunk_text")).alias("symbol"), F.coalesce("chunk_text", F.lit("")).alias("code"),
        F.coalesce("start_line", F.lit(1)).alias("start_line"), F.coalesce("end_line", "start_line", F.lit(1)).alias("end_line"), F.col("last_modified_at").alias("modified"),
    )


def _queries(spark, root):
    return table(spark, root, "eval_item").where("text is not null").select(F.col("item_id").alias("query_id"), "text")


def _ranked_sql(name: str, p: str, k: int, dim: int | None, norm_q: bool, stop: bool) -> str:
    """CTEs that end in the ranked list ``name`` of points p (id, txt) for queries q (id, txt)."""
    h = "('0x' || substr(md5(t), 1, 8))::BIGINT" + (f" % {dim}" if dim else "")
    out = []
    for side, norm in (("q", norm_q), ("p", True)):
        out.append(f"{p}{side} AS (SELECT id, {h} AS term, count(*) AS tf FROM (SELECT id, unnest({sql_tokens('txt', stop)}) AS t FROM {side}) GROUP BY ALL)")
        weight = "tf / sqrt(sum(tf * tf) OVER (PARTITION BY id))" if norm else "tf::DOUBLE"
        out.append(f"{p}{side}w AS (SELECT id, term, {weight} AS w FROM {p}{side})")
    out.append(f"""{name} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
 (SELECT a.id AS query_id, b.id AS id, round(sum(a.w * b.w), 6) AS score FROM {p}qw a JOIN {p}pw b USING (term) GROUP BY ALL) QUALIFY rank <= {k})""")
    return ", ".join(out)


_TEST_SQL = "regexp_matches(lp, '(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|_test\\.\\w+$|\\.(test|spec)\\.\\w+$')"
_VENDOR_SQL = "(" + " OR ".join(f"contains(lp, '{v}')" for v in filters.VENDOR_PARTS) + ")"
_CODE_SQL = "ext IN (" + ", ".join(f"'{e}'" for e in filters.CODE_EXTENSIONS) + ")"
_CONFIG_SQL = "ext IN (" + ", ".join(f"'{e}'" for e in filters.CONFIG_EXTENSIONS) + ")"
_DOCUMENT_SQL = "(contains(lp, 'readme') OR contains(lp, '/docs/') OR contains(lp, '/documentation/') OR ends_with(lp, '.md'))"
_FILLED_SQL = "list_filter(string_split(code, chr(10)), lambda x: trim(x, ' ') <> '')"
_COMMENT_SQL = "len(list_filter(f, lambda x: regexp_matches(x, '^\\s*(?://|#|/\\*|\\*|<!--|--)')))::DOUBLE"

HYBRID_SQL = f"""WITH q AS (SELECT item_id AS id, text AS txt FROM eval_item WHERE text IS NOT NULL),
 raw AS (SELECT chunk_id AS id, path, coalesce(chunk_text, '') AS code, coalesce(start_line, 1) AS start_line, coalesce(end_line, start_line, 1) AS end_line, last_modified_at AS modified,
  regexp_extract(coalesce(chunk_text, ''), '(?m){hybrid.DECLARATION}', 1) AS symbol FROM {CHUNKS}),
 p AS (SELECT id, concat_ws(' ', path, code) AS txt FROM raw),
 {_ranked_sql("lx", "l", hybrid.CANDIDATES, None, False, True)}, {_ranked_sql("dn", "d", hybrid.CANDIDATES, hybrid.DENSE_DIM, True, False)},
 i AS (SELECT id AS query_id, list_distinct({sql_tokens('txt', True)}) AS toks, regexp_matches(txt, '[a-z]_[a-z]|[a-z][A-Z]|\\w\\(') AS nm,
  regexp_matches(lower(trim(txt, ' ')), '^(how|what|why|when|where|which|explain|describe)\\b') OR contains(txt, '?') AS ask FROM q),
 w AS (SELECT query_id, toks, 1.5::DOUBLE * (CASE WHEN ask AND NOT nm THEN 1.25 WHEN nm AND NOT ask THEN 0.8 ELSE 1 END)::DOUBLE AS wd,
  1.0::DOUBLE * (CASE WHEN ask AND NOT nm THEN 0.8 WHEN nm AND NOT ask THEN 1.25 ELSE 1 END)::DOUBLE AS wl FROM i),
 u AS (SELECT query_id, id, sum(d) AS d, sum(l) AS l FROM (SELECT query_id, id, 1.0::DOUBLE / (30 + rank) AS d, 0::DOUBLE AS l FROM dn UNION ALL SELECT query_id, id, 0, 1.0::DOUBLE / (30 + rank) FROM lx) GROUP BY ALL),
 f0 AS (SELECT *, lower(path) AS lp, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, lower(symbol) AS ls, lower(code) AS lc, {_FILLED_SQL} AS f,
  list_distinct({sql_tokens("regexp_replace(regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]+$', ''), '^[_$]+', '')")}) AS ft FROM raw),
 f1 AS (SELECT *, regexp_extract(lp, '([^/\\\\]*)$', 1) AS last, CASE WHEN len(f) > 0 THEN round({_COMMENT_SQL} / len(f), 6) ELSE 0 END::DOUBLE AS share,
  round((CASE WHEN {_CODE_SQL} AND NOT {_TEST_SQL} AND NOT {_DOCUMENT_SQL} THEN 0.1::DOUBLE ELSE 0 END) - (CASE WHEN {_VENDOR_SQL} THEN 0.05::DOUBLE ELSE 0 END) - (CASE WHEN {_TEST_SQL} THEN 0.35::DOUBLE ELSE 0 END)
  - (CASE WHEN {_CONFIG_SQL} THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN {_CODE_SQL} THEN 0.3::DOUBLE ELSE 0 END) - (CASE WHEN {_DOCUMENT_SQL} THEN 0.25::DOUBLE ELSE 0 END), 6) AS path_adjust FROM f0),
 m AS (SELECT u.query_id, u.id, path, symbol, start_line, end_line, modified, round(d * wd, 9) AS dense, round(l * wl, 9) AS lexical, path_adjust,
  -(CASE WHEN share >= 0.6 THEN round(0.2::DOUBLE * (share - 0.6::DOUBLE) / (1 - 0.6::DOUBLE), 6) ELSE 0 END)::DOUBLE + 0.0::DOUBLE AS comment,
  round(0.01::DOUBLE * coalesce(list_sum(list_transform(toks, lambda t: (CASE WHEN contains(ls, t) THEN 2.0 ELSE 0 END + CASE WHEN contains(lp, t) THEN 0.8 ELSE 0 END + CASE WHEN contains(last, t) THEN 0.3 ELSE 0 END
   + CASE WHEN contains(lc, t) THEN 1.0 ELSE 0 END)::DOUBLE)), 0), 6)::DOUBLE AS text_score,
  (CASE WHEN ls = '' THEN 0 WHEN list_contains(toks, ls) THEN 0.25 WHEN len(list_filter(toks, lambda t: contains(ls, t))) > 0 THEN 0.15 ELSE 0 END)::DOUBLE AS symbol_boost,
  (CASE WHEN len(list_intersect(toks, ft)) >= 2 THEN round(len(list_intersect(toks, ft)) * 0.1::DOUBLE, 6) ELSE 0 END)::DOUBLE AS filename_boost,
  len(list_filter(toks, lambda t: contains(lc, t))) AS hits FROM u JOIN w USING (query_id) JOIN f1 USING (id)),
 r AS (SELECT *, round(coalesce(0.1::DOUBLE * ((modified - min(modified) OVER g)::DOUBLE / greatest(1, max(modified) OVER g - min(modified) OVER g)), 0), 6)::DOUBLE AS recency FROM m WINDOW g AS (PARTITION BY query_id)),
 s AS (SELECT *, round(0.0::DOUBLE + dense + lexical + text_score + symbol_boost + filename_boost + path_adjust + comment + recency, 6) AS s0 FROM r),
 b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY s0 DESC, length(symbol), path, start_line, id) <= 200 THEN round(least(0.6::DOUBLE, 0.3::DOUBLE * hits), 6) ELSE 0 END::DOUBLE AS keyword FROM s),
 z AS (SELECT *, round(s0 + keyword, 6) AS score FROM b)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(symbol), path, start_line, id) AS rank, id, path, symbol, start_line, end_line,
 dense, lexical, text_score, symbol_boost, filename_boost, path_adjust, comment, recency, keyword, score FROM z"""


@query("hybrid_scored", HYBRID_SQL)
def hybrid_scored(spark, root):
    """All candidates of the hybrid search with every part of their score, before the order-dependent end."""
    return hybrid.scored(_queries(spark, root), _points(spark, root))


@query("hybrid_search")
def hybrid_search(spark, root):
    return hybrid.search(_queries(spark, root), _points(spark, root))


@query("hybrid_feedback")
def hybrid_feedback(spark, root):
    return hybrid.feedback_search(_queries(spark, root), _points(spark, root))


@query("span_budget")
def span_budget(spark, root):
    return postprocess.span_budget(cut_lineage(hybrid.scored(_queries(spark, root), _points(spark, root)).where(F.col("rank") <= 100)), budget=1024)


@query("context_blend")
def context_blend(spark, root):
    code = hybrid.search(_queries(spark, root), _points(spark, root))
    return graph.blend(code, _lexical(spark, root), 10)


@query("memory_find", BOTH_SQL + """
 SELECT query_id, id, round(sum(p), 9) AS score FROM (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS p FROM hashed UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM lex) GROUP BY ALL""")
def memory_find(spark, root):
    return graph.memory_find(_hashed(spark, root), _lexical(spark, root))


@query("recursive_rerank")
def recursive_rerank(spark, root):
    e = table(spark, root, "embeddings")
    top = _dense(spark, root).join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id").join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), "query_id")
    return rerank.recursive(top)


@query("rerank_blend", LEX_SQL + f""", t AS (SELECT lex.*, list_distinct({sql_tokens('q.text', True)}) AS qt, list_distinct({sql_tokens('d.text', True)}) AS dt FROM lex JOIN eval_item q ON q.item_id = lex.query_id JOIN documents d ON d.doc_id = lex.id),
 s AS (SELECT query_id, id, score, CASE WHEN len(qt) > 0 THEN round(len(list_intersect(qt, dt))::DOUBLE / len(qt), 6) ELSE 0 END AS second FROM t), m AS (SELECT query_id, min(second) AS lo, max(second) AS hi, max(score) AS top FROM s GROUP BY query_id)
SELECT query_id, id, round(0.6::DOUBLE * (CASE WHEN hi > lo THEN (second - lo) / (hi - lo) ELSE 0 END) + 0.4::DOUBLE * score / greatest(1.0::DOUBLE, top), 6) AS final FROM s JOIN m USING (query_id)""")
def rerank_blend(spark, root):
    lex = _lexical(spark, root)
    q = table(spark, root, "eval_item").select(F.col("item_id").alias("query_id"), F.array_distinct(tokens.ident_tokens(F.col("text"), True)).alias("qt"))
    d = table(spark, root, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(tokens.ident_tokens(F.col("text"), True)).alias("dt"))
    second = lex.join(q, "query_id").join(d, "id").withColumn("second", rerank.overlap_score(F.col("qt"), F.col("dt")))
    return rerank.blend_scores(second).select("query_id", "id", "final")


@query("feedback_terms", LEX_SQL + f""", t AS (SELECT query_id, unnest({sql_tokens('d.text', True)}) AS term FROM lex JOIN documents d ON d.doc_id = lex.id WHERE rank <= 8), n AS (SELECT query_id, term, count(*) AS n FROM t WHERE length(term) > 2 GROUP BY ALL)
SELECT query_id, term, n FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) <= 6""")
def feedback_terms(spark, root):
    lex = _lexical(spark, root)
    return expand.feedback_terms(lex, table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("token_weights", f"""WITH w AS (SELECT DISTINCT unnest({sql_tokens('text', True)}) AS term FROM eval_item), d AS (SELECT DISTINCT doc_id, unnest({sql_tokens('text', True)}) AS term FROM documents),
 f AS (SELECT w.term, count(d.doc_id) AS df FROM w LEFT JOIN d USING (term) GROUP BY w.term), i AS (SELECT term, df, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / (df + 1)) AS idf FROM f)
SELECT term, df, round(idf / (SELECT avg(idf) FROM i), 6) AS weight FROM i""")
def token_weights(spark, root):
    wanted = table(spark, root, "eval_item").select(F.explode(tokens.ident_tokens(F.col("text"), True)).alias("term")).distinct()
    return retrieve.token_weights(table(spark, root, "documents"), "doc_id", "text", wanted)


@query("fusion_scaling", """SELECT o_orderkey AS size, CASE WHEN o_orderkey < 10000 THEN 30 ELSE floor(30 * least(1 + log10(o_orderkey / 10000.0::DOUBLE), 3)) END::BIGINT AS k,
 least(floor(100 * (CASE WHEN o_orderkey > 10000 THEN least(1 + sqrt(o_orderkey / 10000.0::DOUBLE - 1), 8) ELSE 1 END) * (CASE WHEN o_orderpriority = '1-URGENT' THEN 0.7::DOUBLE ELSE 1 END)), 400)::BIGINT AS depth,
 round(1.0::DOUBLE / 80 + least(o_totalprice / 10000, 15) / 15 * (1.0::DOUBLE / 31 - 1.0::DOUBLE / 80), 9)::DOUBLE AS mapped FROM orders""")
def fusion_scaling(spark, root):
    o = table(spark, root, "orders")
    size = F.col("o_orderkey")
    return o.select(size.alias("size"), scores.scaled_rrf_k(size).alias("k"), scores.adaptive_depth(100, size, F.col("o_orderpriority") == "1-URGENT").alias("depth"), F.round(scores.sparse_to_rrf(F.col("o_totalprice") / 10000), 9).alias("mapped"))


@query("path_adjustments", f"""WITH c AS (SELECT chunk_id, lower(path) AS p, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM {CHUNKS}),
 f AS (SELECT chunk_id, regexp_matches(p, '(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|_test\\.\\w+$|\\.(test|spec)\\.\\w+$') AS test, {_VENDOR_SQL.replace('lp', 'p')} AS vendor,
 ext IN ('json','yml','yaml','toml','ini') AS config, ext IN ('py','ts','tsx','js','jsx','go','java','rs','rb','php','cs','cpp','c','hpp','h') AS code, (contains(p,'readme') OR contains(p,'/docs/') OR contains(p,'/documentation/') OR ends_with(p,'.md')) AS doc FROM c)
SELECT chunk_id AS id, test, vendor, config, doc, round((CASE WHEN code AND NOT test AND NOT doc THEN 0.1::DOUBLE ELSE 0 END) - (CASE WHEN vendor THEN 0.05::DOUBLE ELSE 0 END) - (CASE WHEN test THEN 0.35::DOUBLE ELSE 0 END) - (CASE WHEN config THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN code THEN 0.3::DOUBLE ELSE 0 END) - (CASE WHEN doc THEN 0.25::DOUBLE ELSE 0 END), 6) AS adjustment FROM f""")
def path_adjustments(spark, root):
    p = F.col("path")
    return chunks(spark, root, "path").select("id", filters.is_test(p).alias("test"), filters.is_vendor(p).alias("vendor"), filters.is_config(p).alias("config"), filters.is_document(p).alias("doc"), rounded(hybrid.path_adjustment(p)).alias("adjustment"))


@query("recency_boost", f"SELECT chunk_id AS id, round(0.1::DOUBLE * (last_modified_at - (SELECT min(last_modified_at) FROM {CHUNKS})) / greatest(1, (SELECT max(last_modified_at) - min(last_modified_at) FROM {CHUNKS})), 6) AS boost FROM {CHUNKS}")
def recency_boost(spark, root):
    c = chunks(spark, root, "last_modified_at")
    ends = c.agg(F.min("last_modified_at").alias("lo"), F.max("last_modified_at").alias("hi"))
    return c.join(F.broadcast(ends)).select("id", rounded(hybrid.RECENCY * (F.col("last_modified_at") - F.col("lo")) / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))).alias("boost"))


@query("query_intent", "SELECT item_id, CASE WHEN n AND NOT a THEN 'identifier' WHEN a AND NOT n THEN 'conceptual' ELSE 'mixed' END AS intent FROM (SELECT item_id, regexp_matches(text, '[a-z]_[a-z]|[a-z][A-Z]|\\w\\(') AS n, regexp_matches(lower(trim(text)), '^(how|what|why|when|where|which|explain|describe)\\b') OR contains(text, '?') AS a FROM eval_item)")
def query_intent(spark, root):
    return table(spark, root, "eval_item").select("item_id", expand.intent(F.col("text")).alias("intent"))


_SYNONYM_ROWS = ", ".join(f"('{w}', '{x}')" for w, more in expand.SYNONYMS.items() for x in more)


@query("synonym_expansion", f"""WITH q AS (SELECT item_id AS query_id, text FROM eval_item WHERE text IS NOT NULL), y(word, synonym) AS (VALUES {_SYNONYM_ROWS}),
 w AS (SELECT query_id, text, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM q),
 e AS (SELECT query_id, text, 0 AS tier FROM q UNION ALL SELECT query_id, regexp_replace(text, '\\b' || word || '\\b', synonym, 'gi'), 1 FROM w JOIN y USING (word)),
 m AS (SELECT query_id, text, min(tier) AS tier FROM e GROUP BY ALL)
SELECT query_id, text, tier FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, text) <= 12""")
def synonym_expansion(spark, root):
    pairs = [(w, s) for w, more in expand.SYNONYMS.items() for s in more]
    return expand.expand(_queries(spark, root), F.broadcast(spark.createDataFrame(pairs, "word string, synonym string")))


@query("jaccard_fallback", f"""WITH t AS (SELECT item_id, list_distinct({sql_tokens('text', True)}) AS t FROM eval_item WHERE text IS NOT NULL),
 p AS (SELECT item_id, unnest(t) AS w, len(t) AS n FROM t), c AS (SELECT x.item_id AS a, y.item_id AS b, x.n AS na, y.n AS nb, count(*) AS i FROM p x JOIN p y ON x.w = y.w AND x.item_id < y.item_id GROUP BY ALL)
SELECT a, b, round(i::DOUBLE / (na + nb - i), 6) AS likeness FROM c WHERE round(i::DOUBLE / (na + nb - i), 6) >= 0.5""")
def jaccard_fallback(spark, root):
    t = _queries(spark, root).select("query_id", F.array_distinct(tokens.ident_tokens(F.col("text"), True)).alias("t"))
    p = t.select("query_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    x, y = p.alias("x"), p.alias("y")
    common = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.query_id") < F.col("y.query_id"))).groupBy(F.col("x.query_id").alias("a"), F.col("y.query_id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count(F.lit(1)).alias("i"))
    return common.select("a", "b", rounded(F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("likeness")).where("likeness >= 0.5")
