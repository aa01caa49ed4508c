"""Queries over source texts, chunks, symbols and structural patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import chunking, extract, filters, graph, joins, patterns
from ..session import current_rows, rounded, table
from ..sources import files as sources
from .base import CHUNKS, FILES, SIGNATURES, SYMBOLS, chunks, files, query, sql_tokens, symbols

LINES = "string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || '$', ''), chr(10))"


@query("line_chunks", f"""WITH f AS (SELECT file_id, {LINES} AS l FROM {FILES} WHERE coalesce(text, '') <> ''), s AS (SELECT file_id, len(l) AS n, unnest(generate_series(0, greatest(0, ceil((len(l) - 60) / 50.0) * 50)::BIGINT, 50)) AS s FROM f)
SELECT file_id AS id, (s + 1)::INT AS start_line, least(s + 60, n)::INT AS end_line FROM s""")
def line_chunks(spark, root):
    return chunking.line_chunks(files(spark, root, "text"), "file_id", "text", 60, 10).select("id", "start_line", "end_line")


@query("token_chunks")
def token_chunks(spark, root):
    return chunking.token_chunks(table(spark, root, "documents"), "doc_id", "text")


@query("chunk_symbols", f"""WITH f AS (SELECT file_id, {LINES} AS l FROM {FILES} WHERE coalesce(text, '') <> ''), s AS (SELECT file_id, len(l) AS n, unnest(generate_series(0, greatest(0, ceil((len(l) - 60) / 50.0) * 50)::BIGINT, 50)) AS s FROM f),
 c AS (SELECT file_id AS id, s + 1 AS a, least(s + 60, n) AS b FROM s), y AS (SELECT file_id, name, start_line AS x, end_line AS z FROM {SYMBOLS} WHERE name IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL),
 m AS (SELECT c.id, c.a, name, row_number() OVER (PARTITION BY c.id, c.a ORDER BY (CASE WHEN x <= b AND z >= a THEN 2 WHEN x <= b THEN 1 ELSE 0 END) DESC, x DESC, (CASE WHEN x <= b AND z >= a THEN z - x ELSE 0 END), name DESC) AS r, x <= b AS ok FROM c LEFT JOIN y ON y.file_id = c.id)
SELECT id, a::INT AS start_line, CASE WHEN ok THEN name ELSE '' END AS symbol FROM m WHERE r = 1""")
def chunk_symbols(spark, root):
    c = chunking.line_chunks(files(spark, root, "text"), "file_id", "text", 60, 10)
    y = symbols(spark, root, "file_id", "name", "start_line", "end_line").where("name is not null and start_line is not null and end_line is not null").withColumnRenamed("file_id", "id")
    return chunking.chunk_symbols(c, y)


@query("chunk_information", f"SELECT chunk_id AS id, coalesce(language, '') || ' code from ' || path || ' lines ' || start_line || '-' || end_line || '. ' || (CASE WHEN length(f) > 160 THEN f[1:160] || '…' ELSE f END) AS info FROM (SELECT *, trim(string_split(coalesce(chunk_text, ''), chr(10))[1], ' ') AS f FROM {CHUNKS})")
def chunk_information(spark, root):
    c = chunks(spark, root, "language", "path", "start_line", "end_line", "chunk_text")
    return c.select("id", chunking.information(F.col("language"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("chunk_text")).alias("info"))


@query("point_ids", f"SELECT chunk_id AS id, sha1(path || ':' || start_line || '-' || end_line || chr(10) || chunk_text)[1:16] AS point_id FROM {CHUNKS}")
def point_ids(spark, root):
    c = chunks(spark, root, "path", "start_line", "end_line", "chunk_text")
    return c.select("id", tokens.point_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("chunk_text")).alias("point_id"))


@query("call_extraction", f"""WITH c AS (SELECT chunk_id, list_filter(regexp_extract_all(coalesce(chunk_text, ''), '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1),
  lambda x: x NOT IN ('if','for','while','switch','return','new','catch','func','def','class','match')) AS l FROM {CHUNKS}),
 d AS (SELECT chunk_id, list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 200) AS c FROM c)
SELECT chunk_id AS id, len(c)::INT AS n, array_to_string(list_sort(c), ',') AS names FROM d""")
def call_extraction(spark, root):
    c = extract.calls(F.col("chunk_text"))
    return chunks(spark, root, "chunk_text").select("id", F.size(c).alias("n"), F.array_join(F.array_sort(c), ",").alias("names"))


def _pattern_sql(patterns_of: dict[str, str], out: str) -> str:
    return "CASE " + " ".join(f"WHEN g = '{g}' THEN {out.format(p=p.replace(chr(39), chr(39) * 2))}" for g, p in patterns_of.items()) + " END"


_IMPORT_SQL = _pattern_sql(extract.IMPORTS, "regexp_extract(l, '{p}', 1)").replace("regexp_extract(l, '" + extract.IMPORTS["python"] + "', 1)", "coalesce(nullif(regexp_extract(l, '" + extract.IMPORTS["python"] + "', 1), ''), regexp_extract(l, '" + extract.IMPORTS["python"] + "', 2))")


@query("import_extraction", f"SELECT DISTINCT id, module FROM (SELECT id, {_IMPORT_SQL} AS module FROM (SELECT file_id AS id, lower(language) AS g, unnest({LINES}) AS l FROM {FILES} WHERE coalesce(text, '') <> '')) WHERE coalesce(module, '') <> ''")
def import_extraction(spark, root):
    return extract.imports(files(spark, root, "language", "text"), "file_id", "language", "text")


_SYMBOL_CASES = " ".join(f"WHEN g = '{g}' AND regexp_extract(l, '{p.replace(chr(39), chr(39) * 2)}', 1) <> '' THEN {{'kind': '{k}', 'name': regexp_extract(l, '{p.replace(chr(39), chr(39) * 2)}', 1)}}" for g, ps in extract.SYMBOLS.items() for k, p in ps)


@query("line_symbols", f"""WITH f AS (SELECT file_id AS id, lower(language) AS g, {LINES} AS a FROM {FILES} WHERE coalesce(text, '') <> ''), l AS (SELECT id, g, len(a) AS n, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM f),
 h AS (SELECT id, n, i, CASE {_SYMBOL_CASES} END AS h FROM l), k AS (SELECT * FROM h WHERE h IS NOT NULL)
SELECT id, h.kind AS kind, h.name AS name, i::INT AS start_line, greatest(i, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - 1, n))::INT AS end_line FROM k""")
def line_symbols(spark, root):
    return extract.line_symbols(files(spark, root, "language", "text"), "file_id", "language", "text")


@query("range_join", f"SELECT c.file_id, a.symbol_id, c.symbol_id AS inner_id FROM {SYMBOLS} a JOIN {SYMBOLS} c ON a.file_id = c.file_id AND a.start_line <= c.end_line AND c.start_line <= a.end_line WHERE a.symbol_id < c.symbol_id")
def range_join(spark, root):
    """Symbols of a file whose lines overlap."""
    y = symbols(spark, root, "file_id", "start_line", "end_line").where("start_line <= end_line").select("file_id", "symbol_id", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return joins.overlapping(y, y, "file_id", 64).where("symbol_id < r_symbol_id").select("file_id", "symbol_id", F.col("r_symbol_id").alias("inner_id"))


@query("python_symbols")
def python_symbols(spark, root):
    return extract.python_symbols(files(spark, root, "path", "text").where("path like '%.py'"), "file_id", "text")


@query("mail_redaction", "SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[redacted]', 'g') AS text FROM documents WHERE text IS NOT NULL AND contains(text, '@')")
def mail_redaction(spark, root):
    return table(spark, root, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", extract.redact_mail(F.col("text")).alias("text"))


@query("code_signals", "SELECT item_id, least(round((CASE WHEN regexp_matches(t, '[a-z][A-Z]') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(t, '[a-z]_[a-z]') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(t, '\\w\\(') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(t, '::|->|\\w\\.\\w') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(t, '`[^`]+`') THEN 0.3 ELSE 0 END)::DOUBLE, 6), 1)::DOUBLE AS signal FROM (SELECT item_id, coalesce(text, '') AS t FROM eval_item)")
def code_signals(spark, root):
    return table(spark, root, "eval_item").select("item_id", extract.code_signal(F.col("text")).alias("signal"))


@query("query_symbols", "SELECT item_id, array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '\\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+|[a-z][a-z0-9]*(?:_[a-z0-9]+)+)\\b', 1))), 1, 5), ',') AS names FROM eval_item")
def query_symbols(spark, root):
    return table(spark, root, "eval_item").select("item_id", F.array_join(extract.query_symbols(F.col("text")), ",").alias("names"))


@query("query_language", f"SELECT chunk_id AS id, language, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM {CHUNKS}")
def query_language(spark, root):
    """Each chunk's language and folder written as a query and parsed again."""
    c = chunks(spark, root, "language", "path")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    q = F.concat(F.lit("find it lang: "), F.coalesce("language", F.lit("")), F.lit(" file:"), folder, F.lit(" now"))
    parsed = c.select("id", "language", q.alias("q"))
    return parsed.select("id", F.when(F.col("language").isNotNull(), filters.dsl_column(F.col("q"), "lang", "language")).alias("language"), F.regexp_extract("q", r"file:(\S*) now$", 1).alias("folder"))


@query("filtered_points", f"SELECT chunk_id AS id FROM {CHUNKS} WHERE language = 'python' AND regexp_matches(path, '^lib/.*$') AND NOT contains(path, 'cache')")
def filtered_points(spark, root):
    return filters.where_filters(chunks(spark, root, "language", "path"), {"language": "python", "path_glob": "lib/*", "not": "cache"}).select("id")


@query("array_matches", f"SELECT chunk_id AS id, list_contains(coalesce(calls, []), 'append') AS exact, len(list_filter(coalesce(calls, []), lambda x: contains(x, 'Queue'))) > 0 AS partial FROM {CHUNKS}")
def array_matches(spark, root):
    c = F.coalesce("calls", F.array().cast("array<string>"))
    return chunks(spark, root, "calls").select("id", F.array_contains(c, "append").alias("exact"), filters.any_contains(c, "Queue").alias("partial"))


@query("language_detection", f"SELECT ext, language, count(*) AS n FROM (SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' END AS language FROM {FILES}) GROUP BY ALL")
def language_detection(spark, root):
    p = F.col("path")
    return files(spark, root, "path").groupBy(filters.extension(p).alias("ext"), sources.language(p).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("term_frequency", f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql_tokens('text', True)}) AS term FROM documents) GROUP BY term")
def term_frequency(spark, root):
    t = table(spark, root, "documents").select("doc_id", F.explode(tokens.ident_tokens(F.col("text"), True)).alias("term"))
    per = t.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


@query("lexical_vectors", f"""WITH t AS (SELECT doc_id AS id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 4096 AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS t FROM documents) GROUP BY ALL), n AS (SELECT id, sqrt(sum(n * n)) AS l FROM t GROUP BY id)
SELECT id, bucket, round(n / l, 6) AS w FROM t JOIN n USING (id)""")
def lexical_vectors(spark, root):
    from ..operators import retrieve

    v = retrieve.normalised(retrieve.postings(table(spark, root, "documents"), "doc_id", "text", 4096, False))
    return v.select("id", F.col("term").alias("bucket"), rounded("w").alias("w"))


@query("filename_tokens", f"SELECT file_id, array_to_string(list_sort(list_distinct({sql_tokens('stem')})), ',') AS parts FROM (SELECT file_id, regexp_replace(regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]+$', ''), '^[_$]+', '') AS stem FROM {FILES})")
def filename_tokens(spark, root):
    return files(spark, root, "path").select("file_id", F.array_join(F.array_sort(tokens.filename_tokens(F.col("path"))), ",").alias("parts"))


@query("highlights", "SELECT doc_id, regexp_replace(regexp_replace(text, 'undocumented', '<<\\0>>', 'gi'), 'format', '<<\\0>>', 'gi') AS marked FROM documents WHERE text IS NOT NULL")
def highlights(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", tokens.highlight(F.col("text"), ["format", "undocumented"]).alias("marked"))


@query("symbol_callers", f"""WITH y AS (SELECT DISTINCT path AS symbol FROM {SYMBOLS} WHERE path IS NOT NULL AND path <> ''),
 p AS (SELECT symbol, string_split(symbol, '.') AS s, string_split(symbol, '::') AS c, string_split(symbol, '->') AS w FROM y),
 v AS (SELECT symbol, symbol AS callee, 1 AS strategy FROM p UNION ALL SELECT symbol, s[-1], 2 FROM p WHERE len(s) > 1 UNION ALL SELECT symbol, s[1], 2 FROM p WHERE len(s) > 1
  UNION ALL SELECT symbol, c[-1], 2 FROM p WHERE len(c) > 1 UNION ALL SELECT symbol, c[-2], 2 FROM p WHERE len(c) > 1 UNION ALL SELECT symbol, w[-1], 2 FROM p WHERE len(w) > 1),
 e AS (SELECT DISTINCT chunk_id AS id, unnest(calls) AS callee FROM {CHUNKS})
SELECT symbol, id, min(strategy)::INT AS strategy FROM e JOIN v USING (callee) GROUP BY ALL""")
def symbol_callers(spark, root):
    y = symbols(spark, root, "path").where("path is not null and path <> ''").select(F.col("path").alias("symbol")).distinct()
    return graph.callers(chunks(spark, root, "calls"), y)


@query("symbol_definitions", f"""WITH w AS (SELECT DISTINCT name AS wanted FROM {SYMBOLS} WHERE name IS NOT NULL), b AS (SELECT wanted, symbol_id, 1 AS s FROM {SYMBOLS} y JOIN w ON y.path = w.wanted UNION ALL SELECT wanted, symbol_id, 2 FROM {SYMBOLS} y JOIN w ON y.name = w.wanted),
 m AS (SELECT wanted, symbol_id, min(s) AS strategy FROM b GROUP BY ALL)
SELECT wanted, symbol_id, strategy::INT AS strategy FROM m QUALIFY strategy = min(strategy) OVER (PARTITION BY wanted)""")
def symbol_definitions(spark, root):
    y = symbols(spark, root, "name", "path")
    return graph.definitions(y, y.where("name is not null").select(F.col("name").alias("wanted")).distinct())


@query("commit_search", "SELECT doc_id AS id, (CASE WHEN contains(t, 'rename') THEN 1.0 ELSE 0 END + CASE WHEN contains(r, 'rename') THEN 0.5 ELSE 0 END + CASE WHEN contains(t, 'fix') THEN 1.0 ELSE 0 END + CASE WHEN contains(r, 'fix') THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(repo, '')) AS r FROM documents WHERE source = 'commit') WHERE contains(t, 'rename') OR contains(r, 'rename') OR contains(t, 'fix') OR contains(r, 'fix')")
def commit_search(spark, root):
    d = table(spark, root, "documents").where("source = 'commit'").select(F.col("doc_id").alias("id"), "text", "repo")
    return graph.commit_search(d, ["rename", "fix"], {"text": 1.0, "repo": 0.5})


@query("symbols_by_file", f"""WITH y AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY complexity DESC NULLS LAST, symbol_id) AS r FROM {SYMBOLS})
SELECT file_id, count(*) AS symbols, string_agg(name, ',' ORDER BY r) FILTER (WHERE r <= 3) AS top_symbols FROM y GROUP BY file_id""")
def symbols_by_file(spark, root):
    return graph.by_file(symbols(spark, root, "file_id", "name", "complexity"))


def _signature_pairs(spark, root, by, *columns):
    s = current_rows(table(spark, root, "pattern_signature"), "sig_id", [*by, *columns])
    a, b = s.alias("a"), s.alias("b")
    same = (F.col("a.sig_id") < F.col("b.sig_id")) & (F.col(f"a.{by[0]}") == F.col(f"b.{by[0]}"))
    for c in by[1:]:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, same)


@query("simhash_distance", f"""SELECT a.sig_id AS sig_a, b.sig_id AS sig_b, bit_count(xor(a.simhash, b.simhash))::INT AS bits FROM {SIGNATURES} a JOIN {SIGNATURES} b
 ON a.repo = b.repo AND a.language = b.language AND a.control_flow = b.control_flow AND a.sig_id < b.sig_id WHERE a.simhash IS NOT NULL AND b.simhash IS NOT NULL""")
def simhash_distance(spark, root):
    """Signatures of one repository, language and control flow."""
    p = _signature_pairs(spark, root, ["repo", "language", "control_flow"], "simhash").where("a.simhash is not null and b.simhash is not null")
    return p.select(F.col("a.sig_id").alias("sig_a"), F.col("b.sig_id").alias("sig_b"), tokens.hamming(F.col("a.simhash"), F.col("b.simhash")).alias("bits"))


def _features(spark, root):
    s = current_rows(table(spark, root, "pattern_signature"), "sig_id", ["structural_ngrams"])
    return s.where("structural_ngrams is not null").select(F.col("sig_id").alias("id"), F.explode("structural_ngrams").alias("feature", "weight"))


FEATURES = f"(SELECT sig_id AS id, unnest(map_keys(structural_ngrams)) AS feature, unnest(map_values(structural_ngrams)) AS weight FROM {SIGNATURES} WHERE structural_ngrams IS NOT NULL)"


@query("minhash_sketches", f"SELECT id, seed::INT AS seed, min((h * (2 * seed + 1) + seed * 7919) % 2147483648)::BIGINT AS value FROM (SELECT DISTINCT id, ('0x' || substr(md5(feature), 1, 8))::BIGINT AS h FROM {FEATURES}), generate_series(0, 15) g(seed) GROUP BY ALL")
def minhash_sketches(spark, root):
    return patterns.minhash(_features(spark, root))


@query("simhash_sketches", f"SELECT id, sum(CASE WHEN s > 0 THEN (1::BIGINT << b) ELSE 0 END)::BIGINT AS simhash FROM (SELECT id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN weight ELSE -weight END) AS s FROM (SELECT id, weight, ('0x' || substr(md5(feature), 1, 8))::BIGINT AS h FROM {FEATURES}), (SELECT generate_series::INT AS b FROM generate_series(0, 31)) GROUP BY ALL) GROUP BY id")
def simhash_sketches(spark, root):
    return patterns.simhash32(_features(spark, root))


@query("common_ngrams", f"""WITH g AS (SELECT sig_id AS id, control_flow AS grp FROM {SIGNATURES} WHERE control_flow IS NOT NULL), z AS (SELECT grp, count(DISTINCT id) AS members FROM g GROUP BY grp HAVING count(DISTINCT id) >= 3),
 m AS (SELECT grp, feature, count(DISTINCT id) AS n, min(weight) AS w FROM {FEATURES} JOIN g USING (id) GROUP BY ALL)
SELECT z.grp AS "group", members, count(feature) AS common, coalesce(sum(w), 0)::BIGINT AS weight FROM z LEFT JOIN m ON m.grp = z.grp AND m.n = members GROUP BY ALL""")
def common_ngrams(spark, root):
    s = current_rows(table(spark, root, "pattern_signature"), "sig_id", ["control_flow"]).where("control_flow is not null")
    return patterns.common_features(_features(spark, root), s.select(F.col("sig_id").alias("id"), F.col("control_flow").alias("group")))


@query("statement_counts", f"SELECT chunk_id AS id, " + ", ".join(f"len(regexp_extract_all(coalesce(chunk_text, ''), '{p}'))::BIGINT AS n_{k}" for k, p in patterns.STATEMENTS.items()) + f" FROM {CHUNKS}")
def statement_counts(spark, root):
    return chunks(spark, root, "chunk_text").select("id", *patterns.statement_counts(F.col("chunk_text")))


@query("flow_likeness", f"""WITH s AS (SELECT sig_id, repo, language, control_flow AS f FROM {SIGNATURES}), p AS (SELECT a.sig_id AS sig_a, b.sig_id AS sig_b, a.f AS x, b.f AS y FROM s a JOIN s b ON a.repo = b.repo AND a.language = b.language AND a.sig_id < b.sig_id)
SELECT sig_a, sig_b, CASE WHEN coalesce(x, '') = '' OR coalesce(y, '') = '' THEN 0.4 ELSE round(len(list_intersect(list_distinct(string_split(x, '|')), list_distinct(string_split(y, '|'))))::DOUBLE / len(list_distinct(list_concat(string_split(x, '|'), string_split(y, '|')))), 6) END::DOUBLE AS likeness FROM p""")
def flow_likeness(spark, root):
    """Signatures of one repository and language."""
    p = _signature_pairs(spark, root, ["repo", "language"], "control_flow")
    return p.select(F.col("a.sig_id").alias("sig_a"), F.col("b.sig_id").alias("sig_b"), patterns.flow_likeness(F.col("a.control_flow"), F.col("b.control_flow")).alias("likeness"))


def _bucket_sql(planes) -> str:
    bits = [f"(CASE WHEN list_dot_product(e, [{', '.join(f'{x!r}::DOUBLE' for x in p.tolist())}]) > 0 THEN {1 << b} ELSE 0 END)" for b, p in enumerate(planes)]
    return " + ".join(bits)


_BUCKETS_SQL = " UNION ALL ".join(f"SELECT {t} AS tab, {_bucket_sql(p)} AS bucket, vec_id FROM v" for t, p in enumerate(patterns.planes(4, 8, 64)))


@query("hyperplane_buckets", f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), b AS ({_BUCKETS_SQL})
SELECT tab AS "table", bucket, count(*) AS members, min(vec_id) AS least FROM b GROUP BY ALL""")
def hyperplane_buckets(spark, root):
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return patterns.hyperplane_buckets(v, 64).groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("least"))


@query("compact_rows", "SELECT n_nationkey, '  ' || n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def compact_rows(spark, root):
    n = table(spark, root, "nation")
    return n.select("n_nationkey", sources.toon_rows(n, ["n_nationkey", "n_name", "n_regionkey"]).alias("line"))
