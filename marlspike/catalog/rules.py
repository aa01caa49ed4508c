"""Queries of the rules over queries, paths and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, tokens
from ..operators import expand
from ..session import rounded, table
from .base import CHUNKS, FILES, SYMBOLS, chunks, files, query, sql_tokens, symbols



def _any_sql(column: str, phrases: tuple[str, ...], test: str = "contains") -> str:
    quoted = [p.replace("'", "''") for p in phrases]
    return "(" + " OR ".join(f"{test}({column}, '{p}')" for p in quoted) + ")"


def _items(spark, root):
    return table(spark, root, "eval_item")


@query("implementation_intent", f"SELECT item_id, {_any_sql('lower(coalesce(text, chr(32)))', rules.IMPLEMENTATION_PHRASES)} AS wanted FROM eval_item")
def implementation_intent(spark, root):
    return _items(spark, root).select("item_id", rules.implementation_intent(F.col("text")).alias("wanted"))


@query("adaptive_weights", f"""WITH t AS (SELECT item_id, coalesce(text, '') AS x, list_distinct({sql_tokens('text', True)}) AS k FROM eval_item),
 d AS (SELECT item_id, greatest(-1, least(1, (CASE WHEN contains(x, '?') OR regexp_matches(lower(trim(x)), '^(how|what|why|when|where|explain|describe)') THEN 0.6 ELSE 0 END)::DOUBLE
  + (CASE WHEN len(k) >= 8 THEN 0.4 ELSE 0 END)::DOUBLE - (CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda t: regexp_matches(t, '[0-9]')))::DOUBLE / len(k) ELSE 0 END)))::DOUBLE AS delta FROM t)
SELECT item_id, round(1 + 0.25::DOUBLE * delta, 6) AS dense, round(1 - 0.25::DOUBLE * delta, 6) AS vector, round(1 - 0.2::DOUBLE * delta, 6) AS lexical FROM d""")
def adaptive_weights(spark, root):
    return _items(spark, root).select("item_id", rules.adaptive_weights(F.col("text")).alias("w")).select("item_id", "w.*")


@query("score_modes", """SELECT l_orderkey, l_linenumber, round(r, 9) AS raw, round(1.0::DOUBLE / 80 + least(r, 20) / 20 * (1.0::DOUBLE / 31 - 1.0::DOUBLE / 80), 9) AS rrf,
 round(tanh(r / 12.0::DOUBLE), 9) AS tanh, round(tanh(r / (4.0::DOUBLE * l_linenumber)), 9) AS adaptive FROM (SELECT *, l_quantity / 2.0::DOUBLE AS r FROM lineitem)""")
def score_modes(spark, root):
    r = F.col("l_quantity") / 2.0
    modes = [("raw", "raw"), ("rrf", "rrf"), ("tanh", "tanh"), ("tanh_adaptive", "adaptive")]
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", *[rules.bounded_score(r, m, n_tokens=F.col("l_linenumber")).alias(n) for m, n in modes])


@query("search_profiles", """WITH p AS (SELECT item_id, coalesce(text, '') AS x, len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS n FROM eval_item),
 c AS (SELECT item_id, CASE WHEN n <= 2 THEN 'symbol' WHEN regexp_matches(lower(x), 'how|why|explain|what does') THEN 'complex' WHEN n <= 8 THEN 'semantic' ELSE 'complex' END AS profile FROM p)
SELECT item_id, profile, CASE profile WHEN 'symbol' THEN 0.3 WHEN 'semantic' THEN 0.6 ELSE 0.7 END::DOUBLE AS dense_weight,
 CASE profile WHEN 'symbol' THEN 64 WHEN 'semantic' THEN 128 ELSE 192 END::INT AS effort, CASE profile WHEN 'symbol' THEN 5 WHEN 'semantic' THEN 10 ELSE 15 END::INT AS most FROM c""")
def search_profiles(spark, root):
    p = F.col("profile")
    settings = [rules.profile_setting(p, i).alias(n) for i, n in ((0, "dense_weight"), (3, "effort"), (4, "most"))]
    return _items(spark, root).select("item_id", rules.search_profile(F.col("text")).alias("profile")).select("item_id", "profile", *settings)


_LANGUAGE_SQL = " OR ".join(
    f"(lower(language) = '{g}' AND ({' OR '.join(f'''ends_with(lower(path), '{e}')''' for e in ends)}))" for g, ends in rules.LANGUAGE_EXTENSIONS.items()
)


@query("language_fits_path", f"SELECT chunk_id AS id, coalesce({_LANGUAGE_SQL}, false) AS fits FROM {CHUNKS}")
def language_fits_path(spark, root):
    return chunks(spark, root, "language", "path").select("id", rules.language_matches(F.col("language"), F.col("path")).alias("fits"))


@query("memory_rows", """SELECT doc_id, coalesce(path, '') = '' OR lower(coalesce(source, '')) IN ('memory', 'chat') OR lower(coalesce(author_role, '')) IN ('memory', 'preference', 'note', 'policy', 'chat') AS memory
 FROM documents""")
def memory_rows(spark, root):
    return table(spark, root, "documents").select("doc_id", rules.memory_like(F.col("path"), F.col("author_role"), F.col("source")).alias("memory"))


@query("memory_penalties", f"""WITH t AS (SELECT doc_id, lower(coalesce(source, '')) IN ('memory', 'chat') OR coalesce(path, '') = '' AS m, contains(lower(coalesce(text, '')), 'memory') AS q,
 len(list_intersect({sql_tokens('path', True)}, {sql_tokens('text', True)})) AS o FROM documents)
SELECT doc_id, (CASE WHEN m AND NOT q THEN -0.15::DOUBLE - (CASE WHEN o = 0 THEN 0.5 ELSE 0 END)::DOUBLE ELSE 0 END)::DOUBLE AS penalty FROM t""")
def memory_penalties(spark, root):
    overlap = F.size(F.array_intersect(tokens.ident_tokens(F.col("path"), True), tokens.ident_tokens(F.col("text"), True)))
    memory = rules.memory_like(F.col("path"), F.lit(""), F.col("source"))
    return table(spark, root, "documents").select("doc_id", rules.memory_penalty(F.col("text"), memory, overlap).alias("penalty"))


@query("secret_settings", f"""SELECT name, secret FROM (SELECT DISTINCT upper(name) || e AS name FROM {SYMBOLS}, (SELECT unnest(['_TOKEN', '_api_key', '_path', 'Password', '']) AS e) WHERE name IS NOT NULL),
 LATERAL (SELECT ends_with(upper(name), 'API_KEY') OR ends_with(upper(name), 'SECRET') OR ends_with(upper(name), 'PASSWORD') OR ends_with(upper(name), 'CREDENTIAL') OR ends_with(upper(name), '_TOKEN') OR starts_with(upper(name), 'AUTH_') AS secret)""")
def secret_settings(spark, root):
    """Names of symbols with and without the ends of secret settings."""
    ends = F.explode(F.array(*[F.lit(e) for e in ("_TOKEN", "_api_key", "_path", "Password", "")])).alias("e")
    n = symbols(spark, root, "name").where("name is not null").select(F.upper("name").alias("n"), ends).select(F.concat("n", "e").alias("name")).distinct()
    return n.select("name", rules.secret_key(F.col("name")).alias("secret"))


@query("rooted_paths", f"""WITH p AS (SELECT DISTINCT path AS given FROM {CHUNKS} WHERE path IS NOT NULL UNION SELECT '/work/' || path || '/' FROM {CHUNKS} WHERE path IS NOT NULL UNION SELECT 'work//' || path FROM {CHUNKS} WHERE path IS NOT NULL),
 i AS (SELECT given, regexp_replace(regexp_replace(trim(given), '/+', '/', 'g'), '^/|/$', '', 'g') AS x FROM p)
SELECT given, CASE WHEN x = '' THEN '/work' WHEN x = 'work' OR starts_with(x, 'work/') THEN '/' || x ELSE '/work/' || x END AS rooted FROM i""")
def rooted_paths(spark, root):
    p = F.col("path")
    forms = F.explode(F.array(p, F.concat(F.lit("/work/"), p, F.lit("/")), F.concat(F.lit("work//"), p))).alias("given")
    return chunks(spark, root, "path").where("path is not null").select(forms).distinct().select("given", rules.rooted_path(F.col("given")).alias("rooted"))


@query("expected_paths", f"""WITH f AS (SELECT file_id, path, string_split(path, '/') AS s FROM {FILES} WHERE path IS NOT NULL),
 e AS (SELECT file_id, path, unnest([s[-1], s[1], s[greatest(len(s) - 1, 1)], 'other.py', 'nowhere']) AS expected FROM f)
SELECT file_id, expected, path <> '' AND expected <> '' AND (ends_with(path, expected) OR (contains(path, '/' || expected || '/') AND NOT regexp_matches(expected, '[^/]\\.[^./]+$'))) AS found FROM (SELECT DISTINCT * FROM e)""")
def expected_paths(spark, root):
    s = F.split("path", "/")
    wanted = F.explode(F.array_distinct(F.array(F.element_at(s, -1), F.get(s, F.lit(0)), F.get(s, F.greatest(F.size(s) - 2, F.lit(0))), F.lit("other.py"), F.lit("nowhere")))).alias("expected")
    return files(spark, root, "path").where("path is not null").select("file_id", "path", wanted).select("file_id", "expected", rules.matches_expected(F.col("path"), F.col("expected")).alias("found"))


@query("grounding", f"""SELECT doc_id, {_any_sql('lower(text)', rules.HEDGES)} AS hedges, (len(regexp_extract_all(text, '```[\\s\\S]*?```')) + len(regexp_extract_all(text, '`[^`]+`')))::INT AS code_references,
 round(len(list_filter(['cache', 'queue', 'parser', 'index'], lambda t: contains(lower(text), t)))::DOUBLE / 4, 6) AS coverage FROM documents WHERE text IS NOT NULL""")
def grounding(spark, root):
    topics = F.array(*[F.lit(t) for t in ("cache", "queue", "parser", "index")])
    return table(spark, root, "documents").where("text is not null").select("doc_id", rules.hedges(F.col("text")).alias("hedges"), rules.code_references(F.col("text")).alias("code_references"), rules.covered_share(F.col("text"), topics).alias("coverage"))


@query("cited_paths", """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '([\\w./-]+\\.[a-z]+):[0-9]+', 1))), ' ') AS paths FROM documents""")
def cited_paths(spark, root):
    return table(spark, root, "documents").select("doc_id", F.array_join(rules.citations(F.col("text")), " ").alias("paths"))


@query("dense_texts", f"""WITH c AS (SELECT chunk_id AS id, coalesce(language, '') || ' code from ' || path || ' lines ' || start_line || '-' || end_line || '. x' AS info, coalesce(chunk_text, '') AS code, coalesce(calls, []) AS calls FROM {CHUNKS}),
 p AS (SELECT *, regexp_replace(coalesce(info, ''), ' lines [0-9]+-[0-9]+\\.', '.') AS plain FROM c)
SELECT id, md5(plain[1:8000]) AS info, md5(concat_ws(chr(10), plain, nullif(array_to_string(calls, ' '), ''), code)[1:8000]) AS whole FROM p""")
def dense_texts(spark, root):
    info = F.concat(F.coalesce("language", F.lit("")), F.lit(" code from "), "path", F.lit(" lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(". x"))
    calls = F.coalesce("calls", F.array().cast("array<string>"))
    made = lambda mode: F.md5(rules.dense_text(mode, info, calls, F.col("chunk_text")))
    return chunks(spark, root, "language", "path", "start_line", "end_line", "chunk_text", "calls").select("id", made("info").alias("info"), made("info+code").alias("whole"))


@query("chunk_tags", f"""WITH c AS (SELECT chunk_id AS id, {sql_tokens("regexp_extract(coalesce(path, ''), '([^/]*)$', 1)", True)} AS s, list_transform(list_slice(coalesce(imports, []), 1, 6), lambda i: lower(string_split(i, '.')[1])) AS i,
 list_filter(list_transform(list_slice(coalesce(calls, []), 1, 4), lambda c: lower(c)), lambda c: length(c) > 2) AS k FROM {CHUNKS}),
 u AS (SELECT id, list_filter(list_concat(list_concat(s, i), k), lambda t: length(t) > 1) AS a FROM c)
SELECT id, array_to_string(list_slice(list_filter(a, lambda x, n: list_position(a, x) = n), 1, 10), ' ') AS tags FROM u""")
def chunk_tags(spark, root):
    name = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1)
    return chunks(spark, root, "path", "imports", "calls").select("id", F.array_join(rules.heuristic_tags(name, F.col("imports"), F.col("calls")), " ").alias("tags"))


@query("memory_marks", """WITH d AS (SELECT doc_id, text, instr(lower(text), 'cache') AS a, instr(lower(text), 'queue') AS b FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, CASE WHEN a > 0 THEN '...' || regexp_replace(substr(text, greatest(a - 30, 1), least(a - 1, 30) + 35), 'cache', '<<\\0>>', 'gi') || '...' END AS x,
  CASE WHEN b > 0 THEN '...' || regexp_replace(substr(text, greatest(b - 30, 1), least(b - 1, 30) + 35), 'queue', '<<\\0>>', 'gi') || '...' END AS y FROM d)
SELECT doc_id, concat_ws(' | ', x, y) AS marks FROM p""")
def memory_marks(spark, root):
    d = table(spark, root, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.array_join(rules.memory_highlights(F.col("text"), ["cache", "queue", "of"]), " | ").alias("marks"))


@query("phrase_versions", """WITH i AS (SELECT item_id, lower(coalesce(text, '')) || (CASE WHEN item_id % 2 = 0 THEN ' true or false' ELSE '' END) AS x FROM eval_item)
SELECT item_id, replace(x, 'true or false', s) AS version FROM i, (SELECT unnest(['boolean', 'bool']) AS s) WHERE contains(x, 'true or false')""")
def phrase_versions(spark, root):
    x = F.concat(F.coalesce(F.col("text"), F.lit("")), F.when(F.col("item_id") % 2 == 0, " true or false").otherwise(""))
    return _items(spark, root).select("item_id", F.explode(rules.phrase_versions(x)).alias("version"))


@query("material_drops", """WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS b FROM d)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, coalesce(b >= 10 AND n < b * 0.9::DOUBLE, false) AS dropped FROM l""")
def material_drops(spark, root):
    from ..operators import points

    daily = table(spark, root, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return points.latest_runs(daily, "event_type", "day", "n").select("event_type", "day", "n", rules.material_drop(F.col("before"), F.col("n"), 0.9).alias("dropped"))


@query("search_efforts", "SELECT o_orderkey, round(64 + 448 * (o_totalprice / 600000))::INT AS effort FROM orders")
def search_efforts(spark, root):
    return table(spark, root, "orders").select("o_orderkey", rules.search_effort(F.col("o_totalprice") / 600000).alias("effort"))


@query("repo_hints", """WITH d AS (SELECT doc_id, lower('look in the ' || coalesce(repo, 'x') || ' repo') AS a, lower('repo:' || coalesce(repo, 'y') || ' find') AS b FROM documents)
SELECT doc_id, regexp_extract(a, '\\bin (?:the )?([\\w./-]+) repo\\b', 1) AS first, regexp_extract(b, '\\brepo[: ]+([\\w./-]+)', 1) AS second FROM d""")
def repo_hints(spark, root):
    a = F.concat(F.lit("look in the "), F.coalesce("repo", F.lit("x")), F.lit(" repo"))
    b = F.concat(F.lit("repo:"), F.coalesce("repo", F.lit("y")), F.lit(" find"))
    return table(spark, root, "documents").select("doc_id", rules.repo_hint(a).alias("first"), rules.repo_hint(b).alias("second"))


@query("full_extensions", f"""WITH p AS (SELECT DISTINCT path FROM {FILES} WHERE path IS NOT NULL UNION SELECT regexp_replace(path, '\\.(\\w+)$', '.d.\\1') FROM {FILES} WHERE path IS NOT NULL)
SELECT path, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^[^.]+\\.((?:[\\w-]+\\.)?[\\w-]+)$', 1)) AS extension FROM p""")
def full_extensions(spark, root):
    both = F.explode(F.array("path", F.regexp_replace("path", r"\.(\w+)$", ".d.$1"))).alias("path")
    return files(spark, root, "path").where("path is not null").select(both).distinct().select("path", rules.full_extension(F.col("path")).alias("extension"))


@query("priority_range", "SELECT doc_id FROM documents WHERE n_chars >= 200 AND n_chars < 900")
def priority_range(spark, root):
    return table(spark, root, "documents").where((F.col("n_chars") >= 200) & (F.col("n_chars") < 900)).select("doc_id")


@query("learned_expansion", f"""WITH t AS (SELECT chunk_id, unnest(list_distinct({sql_tokens('path', True)})) AS a, coalesce(calls, []) AS c FROM {CHUNKS}), p AS (SELECT a, lower(unnest(list_distinct(c))) AS b FROM t),
 n AS (SELECT a AS token, b AS expansion, count(*) AS n FROM p WHERE a <> b GROUP BY ALL)
SELECT token, expansion, round(n::DOUBLE / sum(n) OVER (PARTITION BY token), 6) AS weight FROM n QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, expansion) <= 5""")
def learned_expansion(spark, root):
    c = chunks(spark, root, "path", "calls").select(F.explode(F.array_distinct(tokens.ident_tokens(F.col("path"), True))).alias("token"), F.array_distinct(F.coalesce("calls", F.array().cast("array<string>"))).alias("c"))
    return expand.learned(c.select("token", F.explode("c").alias("e")).select("token", F.lower("e").alias("expansion")), 5)


@query("tool_choice", f"""WITH t AS (SELECT item_id, list_distinct({sql_tokens('text', True)}) AS k FROM eval_item), s AS (SELECT item_id, tool, len(list_intersect(k, w)) AS n FROM t,
 (SELECT 'search' AS tool, ['find', 'search', 'code'] AS w UNION ALL SELECT 'history', ['commit', 'change', 'history'] UNION ALL SELECT 'graph', ['call', 'import', 'symbol']))
SELECT item_id, tool, n::INT AS shared FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, tool) = 1""")
def tool_choice(spark, root):
    signatures = {"search": ("find", "search", "code"), "history": ("commit", "change", "history"), "graph": ("call", "import", "symbol")}
    k = F.array_distinct(tokens.ident_tokens(F.col("text"), True))
    shared = [F.struct(F.size(F.array_intersect(k, F.array(*[F.lit(w) for w in ws]))).alias("n"), F.lit(t).alias("tool")) for t, ws in signatures.items()]
    best = F.get(F.array_sort(F.array(*[F.struct((-s["n"]).alias("m"), s["tool"].alias("tool")) for s in shared])), F.lit(0))
    return _items(spark, root).select("item_id", best.alias("b")).select("item_id", F.col("b.tool").alias("tool"), (-F.col("b.m")).alias("shared"))


@query("centroid_intent", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT label % 2 AS side, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v),
 m AS (SELECT side, i, avg(x) AS x FROM u GROUP BY ALL), a AS (SELECT list(x ORDER BY i) AS c FROM m WHERE side = 0), b AS (SELECT list(x ORDER BY i) AS c FROM m WHERE side = 1)
SELECT vec_id, round(1 / (1 + exp(-5.0::DOUBLE * (list_dot_product(e, a.c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(a.c, a.c))) - list_dot_product(e, b.c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(b.c, b.c)))))), 5) AS code FROM v, a, b""")
def centroid_intent(spark, root):
    """How much nearer a vector is to the first of two class centroids."""
    v = table(spark, root, "embeddings")
    m = v.select((F.col("label") % 2).alias("side"), F.posexplode("embedding").alias("i", "x")).groupBy("side", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = m.groupBy("side").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("c"))
    both = c.agg(F.max(F.when(F.col("side") == 0, F.col("c"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("b"))
    gap = tokens.cosine(F.col("embedding"), F.col("a")) - tokens.cosine(F.col("embedding"), F.col("b"))
    return v.join(F.broadcast(both)).select("vec_id", rounded(F.lit(1.0) / (F.lit(1.0) + F.exp(-5.0 * gap)), 5).alias("code"))
