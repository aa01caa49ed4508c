"""Queries of point maintenance, graph walks and structural patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import extract, graph, incremental, patterns, points
from ..plans import hybrid
from ..session import current_rows, cut_lineage, rounded, table
from .base import CHUNKS, FILES, SIGNATURES, chunks, files, query, symbols
from .code import FEATURES

#: Two snapshots of a manifest: what the even and what the odd chunk ids tell of each place.
SNAPSHOTS = f"""WITH s AS (SELECT chunk_id % 2 AS side, path || '#' || coalesce(repo, '') || ':' || start_line AS path, md5(chunk_text) AS h FROM {CHUNKS} WHERE chunk_text IS NOT NULL AND path IS NOT NULL AND start_line IS NOT NULL),
 o AS (SELECT path, min(h) AS h FROM s WHERE side = 0 GROUP BY path), n AS (SELECT path, min(h) AS h FROM s WHERE side = 1 GROUP BY path),
 c AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS op, coalesce(n.h, o.h) AS file_hash FROM o FULL JOIN n ON o.path = n.path),
 g AS (SELECT path, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY path) AS r FROM c WHERE op = 'deleted'), k AS (SELECT path, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY path) AS r FROM c WHERE op = 'created'),
 m AS (SELECT g.path AS old_path, k.path AS new_path, g.file_hash AS file_hash FROM g JOIN k USING (file_hash, r))"""


def _snapshots(spark, root):
    c = chunks(spark, root, "path", "repo", "start_line", "chunk_text").where("chunk_text is not null and path is not null and start_line is not null")
    s = cut_lineage(c.select((F.col("id") % 2).alias("side"), F.concat("path", F.lit("#"), F.coalesce("repo", F.lit("")), F.lit(":"), F.col("start_line").cast("string")).alias("path"), F.md5("chunk_text").alias("h")))
    one = lambda side: s.where(F.col("side") == side).groupBy("path").agg(F.min("h").alias("file_hash"))
    return one(0), one(1)


def _changes(spark, root):
    return cut_lineage(incremental.classify(*_snapshots(spark, root)))


@query("move_detection", SNAPSHOTS + " SELECT old_path, new_path, file_hash FROM m")
def move_detection(spark, root):
    return incremental.moves(_changes(spark, root))


@query("delta_operations", SNAPSHOTS + """ SELECT path, to_json({'op': op, 'path': path, 'file_hash': file_hash})::VARCHAR AS operation FROM c WHERE op <> 'unchanged' AND path NOT IN (SELECT old_path FROM m UNION SELECT new_path FROM m)
 UNION ALL SELECT new_path, to_json({'op': 'moved', 'path': new_path, 'file_hash': file_hash, 'old_path': old_path})::VARCHAR FROM m""")
def delta_operations(spark, root):
    c = _changes(spark, root)
    return points.delta_operations(c, incremental.moves(c))


@query("delta_applied", SNAPSHOTS + " SELECT path, h AS file_hash FROM n")
def delta_applied(spark, root):
    """The old snapshot after the operations: the new one."""
    old, new = _snapshots(spark, root)
    c = cut_lineage(incremental.classify(old, new))
    return points.apply_delta(old, points.delta_operations(c, incremental.moves(c)))


@query("renamed_points", SNAPSHOTS + f""", p AS (SELECT chunk_id AS id, path || '#' || coalesce(repo, '') || ':' || start_line AS path, start_line, end_line, chunk_text FROM {CHUNKS} WHERE chunk_text IS NOT NULL AND path IS NOT NULL AND start_line IS NOT NULL),
 q AS (SELECT id, coalesce(new_path, path) AS path, start_line, end_line, chunk_text FROM p LEFT JOIN m ON p.path = m.old_path)
SELECT id, path, sha1(path || ':' || start_line || '-' || end_line || chr(10) || chunk_text)[1:16] AS point_id FROM q""")
def renamed_points(spark, root):
    p = chunks(spark, root, "path", "repo", "start_line", "end_line", "chunk_text").where("chunk_text is not null and path is not null and start_line is not null")
    p = p.withColumn("path", F.concat("path", F.lit("#"), F.coalesce("repo", F.lit("")), F.lit(":"), F.col("start_line").cast("string")))
    return points.rename_paths(p, incremental.moves(_changes(spark, root))).select("id", "path", "point_id")


@query("deleted_paths", f"SELECT chunk_id AS id, path FROM {CHUNKS} WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM {CHUNKS} WHERE language = 'python' AND path IS NOT NULL)")
def deleted_paths(spark, root):
    """Points that are left when every path of one language is deleted."""
    c = chunks(spark, root, "path", "language").where("path is not null")
    return points.delete_paths(c, c.where("language = 'python'")).select("id", "path")


@query("indexed_hashes", "SELECT path, arg_max(file_hash, (ingested_at, file_hash)) AS file_hash FROM source_file GROUP BY path")
def indexed_hashes(spark, root):
    return points.indexed_hashes(table(spark, root, "source_file"))


@query("scroll_page", f"SELECT chunk_id AS id, path FROM {CHUNKS} WHERE chunk_id > 100 ORDER BY chunk_id LIMIT 50")
def scroll_page(spark, root):
    """The third page of fifty: a limit is the feature."""
    return points.page(chunks(spark, root, "path"), "id", 100, 50)


@query("memory_points", """SELECT sha1(text)[1:16] AS memory_id, min(coalesce(source, 'note')) AS kind, min(text) AS information, count(*) AS copies FROM documents WHERE trim(coalesce(text, ''), ' ') <> '' GROUP BY 1""")
def memory_points(spark, root):
    return points.memory_points(table(spark, root, "documents"), "text", F.coalesce("source", F.lit("note")))


@query("sampled_events", "SELECT event_id FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 10000 < 2500")
def sampled_events(spark, root):
    """A quarter of the events: sampling is the feature."""
    return points.sampled(table(spark, root, "events"), "event_id", 0.25).select("event_id")


@query("retained_events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 14 DAYS")
def retained_events(spark, root):
    return points.retained(table(spark, root, "events"), "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 14).select("event_id")


@query("next_sequences", "SELECT repo, max(ingested_at) + 1 AS seq FROM source_file GROUP BY repo")
def next_sequences(spark, root):
    return points.next_sequence(table(spark, root, "source_file").withColumn("seq", F.col("ingested_at")), "repo")


@query("path_activity", "SELECT path, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS churn, count(DISTINCT author_role) AS authors FROM documents WHERE path IS NOT NULL GROUP BY path")
def path_activity(spark, root):
    return points.path_activity(table(spark, root, "documents"), "path", "created_at", "author_role").withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


@query("collection_copy", f"SELECT chunk_id AS id, repo, path FROM {CHUNKS}")
def collection_copy(spark, root):
    """A table written in its pruning layout and read again."""
    from ..session import ensure_checkpoint_dir

    where = f"{ensure_checkpoint_dir(spark)}/copy-{spark.sql('select uuid()').first()[0]}"
    points.write_points(chunks(spark, root, "repo", "path"), where, files=8)
    return spark.read.parquet(where).select("id", "repo", "path")


@query("embedding_cache", """WITH d AS (SELECT text, count(*) AS uses FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT md5(text) AS text_id, uses, length(text) AS vector FROM d""")
def embedding_cache(spark, root):
    """Each distinct text is embedded once (here by its length) however often it occurs."""
    return extract.embed_once(table(spark, root, "documents"), "text", F.length).select(F.md5("text").alias("text_id"), "uses", "vector")


@query("point_numbers", f"SELECT chunk_id AS id, ('0x' || sha1(path || ':' || start_line || '-' || end_line || chr(10) || chunk_text)[1:16])::UBIGINT::VARCHAR AS number FROM {CHUNKS}")
def point_numbers(spark, root):
    """Point ids as unsigned 64-bit numbers."""
    c = chunks(spark, root, "path", "start_line", "end_line", "chunk_text")
    return c.select("id", F.conv(tokens.point_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("chunk_text")), 16, 10).alias("number"))


@query("symbol_hashes", f"""WITH f AS (SELECT file_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM {FILES} WHERE text IS NOT NULL),
 y AS (SELECT symbol_id, file_id, kind, name, start_line, end_line FROM (SELECT * FROM code_symbol QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ingested_at DESC) = 1) WHERE start_line >= 1 AND end_line >= start_line)
SELECT symbol_id, coalesce(kind, '') || '_' || coalesce(name, '') || '_' || start_line AS key, sha1(array_to_string(list_slice(l, start_line, end_line), chr(10))) AS hash FROM y JOIN f USING (file_id)""")
def symbol_hashes(spark, root):
    y = symbols(spark, root, "file_id", "kind", "name", "start_line", "end_line").where("start_line >= 1 and end_line >= start_line")
    return extract.symbol_hashes(y, files(spark, root, "text").where("text is not null"))


@query("patch_names", """WITH d AS (SELECT doc_id, '+++ b/src/' || coalesce(repo, 'x') || '.py' || chr(10) || '@@ -1,2 +1,3 @@ def run_' || doc_id || '(x):' || chr(10) || '+def other(y):' AS p FROM documents)
SELECT doc_id, 'src/' || coalesce((SELECT repo FROM documents e WHERE e.doc_id = d.doc_id), 'x') || '.py' AS files, 'other run_' || doc_id AS functions FROM d""")
def patch_names(spark, root):
    """A patch made of each document's repository and id, read again."""
    p = F.concat(F.lit("+++ b/src/"), F.coalesce("repo", F.lit("x")), F.lit(".py\n@@ -1,2 +1,3 @@ def run_"), F.col("doc_id").cast("string"), F.lit("(x):\n+def other(y):"))
    return table(spark, root, "documents").select("doc_id", F.array_join(extract.patch_files(p), " ").alias("files"), F.array_join(extract.patch_functions(p), " ").alias("functions"))


def _declaring(spark, root):
    c = chunks(spark, root, "chunk_text", "calls", "imports")
    return cut_lineage(c.select("id", hybrid.declared_symbol(F.col("chunk_text")).alias("symbol"), "calls", "imports"))


_DECLARING = f"(SELECT chunk_id AS id, regexp_extract(coalesce(chunk_text, ''), '(?m){hybrid.DECLARATION}', 1) AS symbol, calls, imports FROM {CHUNKS})"


@query("symbol_callees", f"""WITH f AS (SELECT symbol, arg_min(coalesce(calls, []), id) AS c FROM {_DECLARING} WHERE symbol <> '' GROUP BY symbol) SELECT DISTINCT symbol, unnest(c) AS callee FROM f""")
def symbol_callees(spark, root):
    d = _declaring(spark, root).withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
    return graph.callees(d, d.select("symbol"))


@query("module_importers", f"""WITH e AS (SELECT DISTINCT chunk_id AS id, unnest(imports) AS i FROM {CHUNKS}), p AS (SELECT id, i, regexp_split_to_array(i, '[./:]+') AS s FROM e), m AS (SELECT DISTINCT i AS module FROM e UNION SELECT DISTINCT s[-1] FROM p),
 u AS (SELECT module, id, 1 AS s FROM e JOIN m ON i = module UNION ALL SELECT module, id, 2 FROM p JOIN (SELECT module, regexp_split_to_array(module, '[./:]+')[-1] AS b FROM m) x ON p.s[-1] = x.b
  UNION ALL SELECT module, id, 3 FROM (SELECT id, unnest(list_distinct(s)) AS q FROM p) JOIN m ON q = module)
SELECT module, id, min(s)::INT AS strategy FROM u GROUP BY ALL""")
def module_importers(spark, root):
    c = chunks(spark, root, "imports")
    names = c.select(F.explode("imports").alias("i"))
    return graph.importers(c, names.select(F.col("i").alias("module")).union(names.select(F.element_at(F.split("i", r"[./:]+"), -1))))


@query("call_closure", f"""WITH e AS (SELECT DISTINCT symbol AS a, unnest(calls) AS b FROM {_DECLARING} WHERE symbol <> ''), h1 AS (SELECT a AS s, b AS n FROM e),
 h2 AS (SELECT DISTINCT h1.s, e.b AS n FROM h1 JOIN e ON h1.n = e.a), f2 AS (SELECT s, n, 2 AS h FROM h2 WHERE (s, n) NOT IN (SELECT s, n FROM h1)),
 h3 AS (SELECT DISTINCT f2.s, e.b AS n FROM f2 JOIN e ON f2.n = e.a), f3 AS (SELECT s, n, 3 AS h FROM h3 WHERE (s, n) NOT IN (SELECT s, n FROM h1) AND (s, n) NOT IN (SELECT s, n FROM f2))
SELECT s AS start, n AS node, h::INT AS hops FROM (SELECT s, n, 1 AS h FROM h1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3)""")
def call_closure(spark, root):
    """The symbol is read before the current rows are found, so that no text is shuffled."""
    c = table(spark, root, "code_chunk").withColumn("symbol", hybrid.declared_symbol(F.col("chunk_text")))
    d = current_rows(c, "chunk_id", ["symbol", "calls"]).where("symbol <> ''")
    return graph.reachable(d.select(F.col("symbol").alias("a"), F.explode("calls").alias("b")), 3)


@query("test_points", f"""SELECT chunk_id AS id FROM {CHUNKS} WHERE regexp_matches(path, '^(.*/tests/.*|tests/.*|.*test_.*|.*_test\\..*|.*\\.spec\\..*|.*\\.test\\..*)$')""")
def test_points(spark, root):
    return graph.preset_points(chunks(spark, root, "path"), "tests").select("id")


@query("settings_drift", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}')[1:16] AS fingerprint FROM nation")
def settings_drift(spark, root):
    return graph.settings_drift(table(spark, root, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


def _sums(half: str, top: int) -> str:
    return ", ".join(f"sum(CASE WHEN ({half} >> {b}) & 1 = 1 THEN weight ELSE -weight END) AS {half}{b}" for b in range(top, -1, -1))


_BITS = " || ".join([f"(CASE WHEN {half}{b} > 0 THEN '1' ELSE '0' END)" for half in ("hi", "lo") for b in range(31, -1, -1)])


@query("simhash64", f"""WITH h AS (SELECT id, weight, ('0x' || substr(md5(feature), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(feature), 9, 8))::BIGINT AS lo FROM {FEATURES}), s AS (SELECT id, {_sums('hi', 31)}, {_sums('lo', 31)} FROM h GROUP BY id)
SELECT id, lower(lpad(to_hex(({_BITS})::BIT::UBIGINT), 16, '0')) AS simhash FROM s""")
def simhash64(spark, root):
    s = current_rows(table(spark, root, "pattern_signature"), "sig_id", ["structural_ngrams"]).where("structural_ngrams is not null")
    return patterns.simhash64(s.select(F.col("sig_id").alias("id"), F.explode("structural_ngrams").alias("feature", "weight")))


@query("similar_patterns")
def similar_patterns(spark, root):
    """Hyperplane buckets, then exact cosine; the queries are the stated set of ids divisible by 20."""
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return patterns.similar_to(v, v.where("id % 20 = 0"), 64)


@query("pruned_overlap", f"""WITH s AS (SELECT sig_id, repo, language, list_distinct(map_keys(structural_ngrams)) AS f FROM {SIGNATURES} WHERE structural_ngrams IS NOT NULL),
 p AS (SELECT a.sig_id AS query_id, b.sig_id AS id, a.f AS x, b.f AS y FROM s a JOIN s b ON a.repo = b.repo AND a.language = b.language AND a.sig_id <> b.sig_id),
 o AS (SELECT query_id, id, CASE WHEN len(x) > 0 THEN round(len(list_intersect(x, y))::DOUBLE / len(x), 6) ELSE 0 END::DOUBLE AS overlap FROM p)
SELECT query_id, id, overlap, round(0.6::DOUBLE * overlap + (1 - 0.6::DOUBLE) * 0.5::DOUBLE, 6) AS final FROM o""")
def pruned_overlap(spark, root):
    s = current_rows(table(spark, root, "pattern_signature"), "sig_id", ["repo", "language", "structural_ngrams"]).where("structural_ngrams is not null")
    a = s.select(F.col("sig_id").alias("query_id"), "repo", "language", F.array_distinct(F.map_keys("structural_ngrams")).alias("query_features"))
    b = s.select(F.col("sig_id").alias("id"), "repo", "language", F.array_distinct(F.map_keys("structural_ngrams")).alias("features"))
    pairs = a.join(b, ["repo", "language"]).where("query_id <> id").withColumn("score", F.lit(0.5))
    return patterns.prune_overlap(pairs).select("query_id", "id", "overlap", "final")
