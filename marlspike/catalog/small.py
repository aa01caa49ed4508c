"""Queries of the small rules: query features, budgets, routes, names, snippets, paths, fingerprints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import queries as rules
from ..functions import tokens
from ..operators import filters, postprocess, rerank
from ..session import rounded, table
from .base import CHUNKS, FILES, SYMBOLS, chunks, files, query, sql_tokens, symbols
from .retrieval import LEX_SQL, lexical_topk

_COMPLEX = """greatest(0, least(1, round(least(length(t) / 100.0::DOUBLE, 1) * 0.2::DOUBLE + least(len(regexp_extract_all(t, '[A-Za-z0-9_]+')) / 10.0::DOUBLE, 1) * 0.15::DOUBLE + (CASE WHEN regexp_matches(q, 'what|how|why|when|where|which|who|explain|describe') THEN 0.2::DOUBLE ELSE 0 END)
 + least((CASE WHEN contains(p, ' and ') THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN contains(p, ' or ') THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN contains(p, ' but ') THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN contains(p, ' with ') THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN contains(p, ' that ') THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN contains(p, ' also ') THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN contains(p, ' including ') THEN 0.1::DOUBLE ELSE 0 END), 0.2::DOUBLE)
 - (CASE WHEN regexp_matches(t, '[(){}\\[\\]<>.:;,]') THEN 0.1::DOUBLE ELSE 0 END) - (CASE WHEN regexp_matches(t, '[A-Z][a-z]+[A-Z]') OR contains(t, '_') THEN 0.1::DOUBLE ELSE 0 END) - (CASE WHEN regexp_matches(t, '["'']') THEN 0.15::DOUBLE ELSE 0 END) - (CASE WHEN regexp_matches(t, '[*+?\\\\|^$]') THEN 0.15::DOUBLE ELSE 0 END), 6)))::DOUBLE"""
_TEXTS = "(SELECT item_id, coalesce(text, '') AS t, lower(trim(coalesce(text, ''))) AS q, ' ' || lower(trim(coalesce(text, ''))) || ' ' AS p FROM eval_item)"


@query("query_complexity", f"SELECT item_id, c AS complexity, CASE WHEN c < 0.3 AND (regexp_matches(q, '^[a-z_][a-z0-9_]*$') OR (len(regexp_split_to_array(q, '\\s+')) <= 2 AND NOT regexp_matches(q, '[(){{}}\\[\\]]'))) THEN 'simple' WHEN c > 0.7 THEN 'complex' WHEN regexp_matches(q, '^(what|how|why|explain|describe|show me|find all)') THEN 'semantic' ELSE 'hybrid' END AS class FROM (SELECT *, {_COMPLEX} AS c FROM {_TEXTS})")
def query_complexity(spark, root):
    t = F.col("text")
    return table(spark, root, "eval_item").select("item_id", rules.complexity(t).alias("complexity"), rules.query_class(t).alias("class"))


@query("token_budgets", f"SELECT file_id, floor((2000 + least(150 * n, 2000)) * (CASE WHEN n > 8 THEN 1.5::DOUBLE ELSE 1 END))::BIGINT AS budget FROM (SELECT file_id, count(*) AS n FROM {SYMBOLS} GROUP BY file_id)")
def token_budgets(spark, root):
    n = symbols(spark, root, "file_id").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("file_id", rules.token_budget(F.col("n"), F.col("n") > 8).alias("budget"))


@query("request_routes", "SELECT item_id, CASE WHEN regexp_matches(t, '\\btests?\\b') THEN 'tests' WHEN regexp_matches(t, '\\b(config|configuration|setting|settings)\\b') THEN 'config' WHEN regexp_matches(t, '\\b(calls?|callers?|calling|called)\\b') THEN 'callers' WHEN regexp_matches(t, '\\b(imports?|importers?)\\b') THEN 'importers' WHEN regexp_matches(t, '\\b(commits?|history|changed)\\b') THEN 'history' WHEN regexp_matches(t, '^(what|how|why|explain)\\b') THEN 'answer' ELSE 'search' END AS route FROM (SELECT item_id, lower(coalesce(text, '')) AS t FROM eval_item)")
def request_routes(spark, root):
    return table(spark, root, "eval_item").select("item_id", rules.route(F.col("text")).alias("route"))


@query("collection_slugs", f"SELECT DISTINCT repo, regexp_replace(regexp_replace(lower(repo), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, sha1(repo)[1:16] AS repo_id FROM {FILES} WHERE repo IS NOT NULL")
def collection_slugs(spark, root):
    return files(spark, root, "repo").where("repo is not null").select("repo", rules.slug(F.col("repo")).alias("slug"), F.substring(F.sha1("repo"), 1, 16).alias("repo_id")).distinct()


@query("compressed_snippets", f"SELECT chunk_id AS id, array_to_string(list_slice(string_split(coalesce(chunk_text, ''), chr(10)), 1, 6), chr(10)) AS snippet, ceil(length(coalesce(chunk_text, '')) / 4.0)::BIGINT AS tokens FROM {CHUNKS}")
def compressed_snippets(spark, root):
    t = F.col("chunk_text")
    return chunks(spark, root, "chunk_text").select("id", rules.compressed(t).alias("snippet"), F.ceil(F.length(F.coalesce(t, F.lit(""))) / 4.0).cast("bigint").alias("tokens"))


@query("path_terms", f"SELECT file_id, array_to_string(list_sort(list_distinct([p[-1], regexp_replace(p[-1], '\\.[^.]+$', ''), array_to_string(list_slice(p, greatest(len(p) - 1, 1), len(p)), '/'), array_to_string(list_slice(p, greatest(len(p) - 2, 1), len(p)), '/')])), ' ') AS terms FROM (SELECT file_id, string_split(path, '/') AS p FROM {FILES})")
def path_terms(spark, root):
    return files(spark, root, "path").select("file_id", F.array_join(F.array_sort(rules.sharpened(F.col("path"))), " ").alias("terms"))


@query("comment_penalties", f"SELECT chunk_id AS id, s AS share, CASE WHEN s >= 0.6 THEN round(0.2::DOUBLE * (s - 0.6::DOUBLE) / (1 - 0.6::DOUBLE), 6) ELSE 0 END::DOUBLE AS penalty FROM (SELECT chunk_id, CASE WHEN len(f) > 0 THEN round(len(list_filter(f, lambda x: regexp_matches(x, '^\\s*(?://|#|/\\*|\\*|<!--|--)')))::DOUBLE / len(f), 6) ELSE 0 END::DOUBLE AS s FROM (SELECT chunk_id, list_filter(string_split(coalesce(chunk_text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS f FROM {CHUNKS}))")
def comment_penalties(spark, root):
    share = rules.comment_share(F.col("chunk_text"))
    return chunks(spark, root, "chunk_text").select("id", share.alias("share")).withColumn("penalty", rules.comment_penalty(F.col("share")))


@query("symbol_extents", f"""SELECT f.path AS path, y.name AS symbol, min(y.start_line) AS start_line, max(y.end_line) AS end_line FROM {SYMBOLS} y JOIN {FILES} f ON y.file_id = f.file_id
 WHERE y.name IS NOT NULL AND f.path IS NOT NULL GROUP BY ALL""")
def symbol_extents(spark, root):
    y = symbols(spark, root, "file_id", "name", "start_line", "end_line").where("name is not null")
    f = files(spark, root, "path").where("path is not null")
    return postprocess.symbol_extent(y.join(f, "file_id").select("path", F.col("name").alias("symbol"), "start_line", "end_line"))


@query("related_paths", f"""WITH f AS (SELECT DISTINCT repo, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM {FILES} WHERE repo IS NOT NULL AND path IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY repo, d ORDER BY path) AS r, count(*) OVER (PARTITION BY repo, d) AS n FROM f)
SELECT repo, d AS folder, max(n) AS files, string_agg(path, ',' ORDER BY r) FILTER (WHERE r <= 10) AS first_paths FROM r GROUP BY ALL""")
def related_paths(spark, root):
    """Siblings by folder: how many there are and the first ten."""
    f = files(spark, root, "repo", "path").where("repo is not null and path is not null").select("repo", "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
    n = f.groupBy("repo", "folder").agg(F.count(F.lit(1)).alias("files"))
    first = f.withColumn("_r", F.row_number().over(Window.partitionBy("repo", "folder").orderBy("path"))).where("_r <= 10")
    listed = first.groupBy("repo", "folder").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("first_paths"))
    return n.join(listed, ["repo", "folder"])


@query("mode_order", LEX_SQL + """, g AS (SELECT lex.*, CASE WHEN p AND NOT d THEN 0 WHEN d THEN 2 ELSE 1 END AS g FROM lex JOIN (SELECT doc_id, regexp_matches(x, '\\.(py|ts|tsx|js|jsx|go|java|rs|rb|php|cs|cpp|c|hpp|h)$') AND NOT regexp_matches(x, '(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|_test\\.\\w+$|\\.(test|spec)\\.\\w+$') AS p,
 contains(x,'readme') OR contains(x,'/docs/') OR contains(x,'/documentation/') OR ends_with(x,'.md') AS d FROM (SELECT doc_id, lower(coalesce(path, '')) AS x FROM documents)) f ON f.doc_id = lex.id)
SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY g, rank) AS mode_rank FROM g""")
def mode_order(spark, root):
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), F.coalesce("path", F.lit("")).alias("path"))
    ranked = lexical_topk(spark, root).join(docs, "id")
    return rerank.mode_order(ranked, filters.is_core(F.col("path")), filters.is_document(F.col("path"))).select("query_id", "id", "rank", "mode_rank")


@query("corpus_fingerprints", f"SELECT repo, sum(('0x' || substr(md5(path || file_hash), 1, 8))::BIGINT)::BIGINT AS fingerprint, count(*) AS files FROM {FILES} WHERE file_hash IS NOT NULL AND path IS NOT NULL GROUP BY repo")
def corpus_fingerprints(spark, root):
    """One number per repository over its files' paths and hashes, a sum, so that it is combined map-side in any order."""
    f = files(spark, root, "repo", "path", "file_hash").where("file_hash is not null and path is not null")
    return f.groupBy("repo").agg(F.sum(tokens.token_hash(F.concat("path", "file_hash"))).alias("fingerprint"), F.count(F.lit(1)).alias("files"))


@query("format_sizes", "SELECT n_nationkey, length('  ' || n_nationkey || ',' || n_name)::INT AS compact, length('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}')::INT AS json FROM nation")
def format_sizes(spark, root):
    from ..sources.files import toon_rows

    n = table(spark, root, "nation")
    return n.select("n_nationkey", F.length(toon_rows(n, ["n_nationkey", "n_name"])).alias("compact"), F.length(F.to_json(F.struct("n_nationkey", "n_name"))).alias("json"))


@query("token_overlap", f"SELECT chunk_id AS id, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / len(a), 6) ELSE 0 END::DOUBLE AS overlap FROM (SELECT chunk_id, list_distinct({sql_tokens('path', True)}) AS a, list_distinct({sql_tokens('chunk_text', True)}) AS b FROM {CHUNKS})")
def token_overlap(spark, root):
    t = lambda c: F.array_distinct(tokens.ident_tokens(F.col(c), True))
    return chunks(spark, root, "path", "chunk_text").select("id", rounded(rerank.overlap_score(t("path"), t("chunk_text"))).alias("overlap"))


@query("mapped_paths", f"SELECT chunk_id AS id, CASE WHEN starts_with(path, 'lib/') THEN '/work/' || path ELSE path END AS container_path, CASE WHEN repo IS NOT NULL THEN '/home/' || repo || '/' || path END AS host_path FROM {CHUNKS}")
def mapped_paths(spark, root):
    p = F.col("path")
    return chunks(spark, root, "path", "repo").select("id", F.when(p.startswith("lib/"), F.concat(F.lit("/work/"), p)).otherwise(p).alias("container_path"), F.concat(F.lit("/home/"), "repo", F.lit("/"), p).alias("host_path"))
