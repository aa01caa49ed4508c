"""Queries of indexing, owned symbols, projections, gated and variant search, and weighted expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, tokens
from ..operators import chunking, expand, extract, retrieve
from ..plans import hybrid, ingest
from ..session import cut_lineage, rounded, table
from .base import FILES, files, query, sql_tokens
from .code import _SYMBOL_CASES, LINES
from .retrieval import DENSE_SQL, HASHED_SQL, _dense, _hashed, _queries

_PLACED = f"""WITH f AS (SELECT file_id AS id, lower(language) AS g, {LINES} AS a FROM {FILES} WHERE coalesce(text, '') <> ''),
 l AS (SELECT id, g, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM f), h AS (SELECT id, i, CASE {_SYMBOL_CASES} END AS h FROM l),
 k AS (SELECT id, i, h.kind AS kind, h.name AS name FROM h WHERE h IS NOT NULL)"""


@query("owned_symbols", _PLACED + """, o AS (SELECT *, last_value(CASE WHEN kind IN ('class', 'struct', 'impl', 'trait', 'interface') THEN name END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS o FROM k)
SELECT id, i::INT AS start_line, kind, CASE WHEN kind IN ('method', 'function') AND o IS NOT NULL THEN o || '.' || name ELSE name END AS path FROM o""")
def owned_symbols(spark, root):
    s = extract.line_symbols(files(spark, root, "language", "text"), "file_id", "language", "text")
    return extract.owned_symbols(s).select("id", "start_line", "kind", "path")


@query("all_symbols")
def all_symbols(spark, root):
    return extract.symbols(files(spark, root, "language", "text"), "file_id", "language", "text")


@query("semantic_chunks")
def semantic_chunks(spark, root):
    f = cut_lineage(files(spark, root, "language", "text"))
    return chunking.semantic_chunks(f, extract.symbols(f, "file_id", "language", "text"), "file_id", "text").select("id", "start_line", "end_line")


@query("indexed_points", f"""WITH f AS (SELECT path || '#' || file_id AS path, min(text) AS text FROM {FILES} WHERE coalesce(text, '') <> '' AND path IS NOT NULL GROUP BY 1), l AS (SELECT path, {LINES} AS l FROM f),
 s AS (SELECT path, l, unnest(generate_series(0, greatest(0, ceil((len(l) - 120) / 100.0) * 100)::BIGINT, 100)) AS s FROM l),
 c AS (SELECT path, s + 1 AS a, least(s + 120, len(l)) AS b, array_to_string(list_slice(l, s + 1, s + 120), chr(10)) AS code FROM s)
SELECT path, a::INT AS start_line, b::INT AS end_line, sha1(path || ':' || a || '-' || b || chr(10) || code)[1:16] AS id, length(code)::BIGINT AS vector FROM c""")
def indexed_points(spark, root):
    """A first index over all files; vectors stand in by the length of the code."""
    f = files(spark, root, "path", "text", "file_hash").where("path is not null and text <> ''")
    f = cut_lineage(f.select(F.concat("path", F.lit("#"), F.col("file_id").cast("string")).alias("path"), "text", F.coalesce("file_hash", F.lit("")).alias("file_hash")))
    embed = lambda c: F.length(c).cast("bigint")
    held = ingest.points_of(f.limit(0), embed)
    return ingest.index(f, held, embed).select("path", "start_line", "end_line", "id", "vector")


_ROWS = ", ".join("list_dot_product(e, [" + ", ".join(f"{x:.17g}::DOUBLE" for x in row) + "])" for row in retrieve.projection(64, 16))


@query("projected_vectors", f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT vec_id, [{_ROWS}] AS r FROM v)
SELECT vec_id, round(r[1] / sqrt(list_dot_product(r, r)), 5) AS first, round(r[16] / sqrt(list_dot_product(r, r)), 5) AS last FROM p""")
def projected_vectors(spark, root):
    p = table(spark, root, "embeddings").select("vec_id", retrieve.project(F.col("embedding"), 64, 16).alias("p"))
    return p.select("vec_id", rounded(F.get("p", F.lit(0)), 5).alias("first"), rounded(F.get("p", F.lit(15)), 5).alias("last"))


@query("gated_topk", f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT vec_id, e, [{_ROWS}] AS r FROM v),
 g AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.e AS a, c.e AS b FROM p q, p c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.r, c.r), 6) DESC, c.vec_id) <= 200),
 s AS (SELECT query_id, id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS score FROM g)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def gated_topk(spark, root):
    """The exact best among the 200 nearest by projected vectors; the queries are the stated set of ids divisible by 20."""
    e = table(spark, root, "embeddings")
    return retrieve.gated_topk(e.where("vec_id % 20 = 0"), e, 64, 10)


@query("dense_variants", DENSE_SQL + """, m AS (SELECT query_id // 100 * 100 AS query_id, id, max(score) AS score FROM dense GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m QUALIFY rank <= 10""")
def dense_variants(spark, root):
    """Each five query vectors are variants of one query; a row counts by its best raw score."""
    d = _dense(spark, root)
    of = table(spark, root, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("variant_id"), (F.col("vec_id") - F.col("vec_id") % 100).alias("query_id"))
    return retrieve.best_of_variants(d, of, 10)


_NEIGHBOURS_SQL = HASHED_SQL + f""", o AS (SELECT item_id AS query_id, {sql_tokens('text', True)} AS own FROM eval_item WHERE text IS NOT NULL),
 t AS (SELECT DISTINCT query_id, unnest({sql_tokens('d.path', True)}) AS term FROM hashed JOIN documents d ON d.doc_id = hashed.id WHERE rank <= 8 AND score >= 0.3),
 n AS (SELECT query_id, term FROM t JOIN o USING (query_id) WHERE NOT list_contains(own, term) AND length(term) > 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(term), term) <= 10)"""


@query("neighbour_terms", _NEIGHBOURS_SQL + " SELECT query_id, term FROM n")
def neighbour_terms(spark, root):
    names = table(spark, root, "documents").select(F.col("doc_id").alias("id"), F.col("path").alias("text"))
    return expand.neighbour_terms(_hashed(spark, root), names, _queries(spark, root))


@query("weighted_expansion")
def weighted_expansion(spark, root):
    q = _queries(spark, root)
    pairs = spark.createDataFrame([(w, s) for w, more in expand.SYNONYMS.items() for s in more], "word string, synonym string")
    words = expand.expand(q, F.broadcast(pairs)).where("tier > 0")
    phrases = q.select("query_id", F.explode(rules.phrase_versions(F.col("text"))).alias("text"))
    near = neighbour_terms(spark, root).join(q, "query_id").select("query_id", F.concat_ws(" ", "text", "term").alias("text"))
    return expand.weighted(q, phrases, words, near)


@query("declared_symbols", f"""SELECT file_id, regexp_extract(coalesce(text, ''), '(?m){hybrid.DECLARATION}', 1) AS symbol FROM {FILES}""")
def declared_symbols(spark, root):
    return files(spark, root, "text").select("file_id", hybrid.declared_symbol(F.col("text")).alias("symbol"))


@query("code_words", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$')
 AND t NOT IN ('the','a','an','of','in','on','for','and','or','to','with','by','is','are','be','this','that')))), ' ') AS words FROM documents""")
def code_words(spark, root):
    return table(spark, root, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(tokens.code_tokens(F.col("text")))), " ").alias("words"))
