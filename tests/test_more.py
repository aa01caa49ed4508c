"""Rules, point maintenance, languages, semantic chunks, indexing and registered functions on small tables."""

import pytest
from pyspark.sql import functions as F

from marlspike.functions import registered, rules
from marlspike.operators import chunking, expand, extract, graph, metrics, patterns, points, retrieve
from marlspike.plans import hybrid, ingest
from marlspike.streaming import feeds


def one(spark, column, value="x"):
    return spark.range(1).select(column.alias(value)).first()[0]


@pytest.mark.parametrize(("language", "text", "names"), [
    ("csharp", "public sealed class Pool {\n  public int Take(int n) {\n  }\n}", [("class", "Pool"), ("method", "Take")]),
    ("php", "<?php\nfinal class A {\n  public static function go($x) {}\n}\nfunction f() {}", [("class", "A"), ("function", "go"), ("function", "f")]),
    ("rust", "pub enum E {}\ntrait T {}\nimpl<X> T for Pool {\n  pub(crate) fn take() {}\n}", [("enum", "E"), ("trait", "T"), ("impl", "Pool"), ("function", "take")]),
    ("terraform", 'resource "a" "b" {\n}\nvariable "c" {}', [("resource", "b"), ("block", "c")]),
    ("shell", "go() {\n}\nfunction stop () {", [("function", "go"), ("function", "stop")]),
    ("yaml", "name: x\n  inner: y\non: z", [("key", "name"), ("key", "on")]),
    ("powershell", "function Get-It {\n}", [("function", "Get-It")]),
])
def test_symbols_of_languages(spark, language, text, names):
    df = spark.createDataFrame([(1, language, text), (2, language, None)], "id int, g string, text string")
    rows = extract.symbols(df, "id", "g", "text").orderBy("start_line").collect()
    assert [(r.kind, r.name) for r in rows] == names
    if language in extract.ONE_LINE:
        assert all(r.start_line == r.end_line for r in rows)


def test_owners_and_imports(spark):
    df = spark.createDataFrame([(1, "java", "class A {\n  public void go(int x) {\n  }\n}\nclass B {\n  private int go() {"), (2, "go", 'import (\n  "a/b"\n  x "c"\n)\nimport "d"'), (3, "ruby", "require 'set'"), (4, "cpp", "#include <map>")], "id int, g string, text string")
    owned = extract.owned_symbols(extract.line_symbols(df, "id", "g", "text"))
    assert [r.path for r in owned.where("id = 1").orderBy("start_line").collect()] == ["A", "A.go", "B", "B.go"]
    assert {r.module for r in extract.go_block_imports(df.where("g = 'go'"), "id", "text").collect()} == {"a/b", "c"}
    assert {(r.id, r.module) for r in extract.imports(df, "id", "g", "text").collect()} == {(2, "d"), (3, "set"), (4, "map")}


def test_semantic_chunks(spark):
    assert chunking.pack_symbols(100, [(1, 30), (32, 60), (62, 90)], 60, 5) == [(1, 60), (61, 61), (62, 90), (91, 100)]
    assert chunking.pack_symbols(10, []) == [(1, 10)] and chunking.pack_symbols(250, [(1, 250), (5, 9)], 120, 20) == [(1, 120), (101, 220), (201, 250)]
    files = spark.createDataFrame([(1, "\n".join("abcdefgh")), (2, None), (3, "")], "id int, text string")
    symbols = spark.createDataFrame([(1, 1, 3), (1, 4, 6)], "id int, start_line int, end_line int")
    got = [(r.start_line, r.end_line, r.chunk_text) for r in chunking.semantic_chunks(files, symbols, "id", "text", 4, 1).orderBy("start_line").collect()]
    assert got == [(1, 3, "a\nb\nc"), (4, 6, "d\ne\nf"), (7, 8, "g\nh")]


def test_index_reuses_and_skips(spark):
    files = spark.createDataFrame([("a.py", "def f():\n  g(1)", "h1"), ("b.py", "x = 1", "h2"), ("c.py", None, "h3")], "path string, text string, file_hash string")
    embed = lambda c: F.array(F.length(c).cast("double"))
    first = ingest.points_of(files.where("text is not null"), embed)
    assert {(r.path, r.symbol, r.language) for r in first.collect()} == {("a.py", "f", "python"), ("b.py", "", "python")}
    held = first.withColumn("vector", F.array(F.lit(-1.0)))
    later = spark.createDataFrame([("a.py", "def f():\n  g(1)", "h1"), ("b.py", "x = 1", "h9"), ("d.py", "y = 22", "h4")], "path string, text string, file_hash string")
    got = {r.path: (r.file_hash, r.vector) for r in ingest.index(later, held, embed).collect()}
    assert got == {"a.py": ("h1", [-1.0]), "b.py": ("h9", [-1.0]), "d.py": ("h4", [6.0])}
    assert ingest.index(later.limit(0), held, embed).count() == 0


def test_registered_functions(spark):
    registered.register(spark)
    assert spark.sql("SELECT embed('cache Queue cache') AS v").first().v == registered.hash_embedding("cache Queue cache")
    assert spark.sql("SELECT rerank_score('open the cache', 'cache of files') AS s").first().s == 0.5
    assert [r.piece for r in spark.sql("SELECT * FROM token_windows('a b  c d e', 3, 2)").orderBy("no").collect()] == ["a b  c", "c d e"]


def test_points(spark, tmp_path):
    have = spark.createDataFrame([(1, "a")], "id int, path string").schema
    want = spark.createDataFrame([(1, "a", 2)], "id bigint, path string, line int").schema
    assert points.schema_problems(have, want) == ["missing line", "id is int, not bigint"] and points.schema_problems(want, want) == []
    notes = spark.createDataFrame([("", "memory", "chat", "one"), ("a.py", "code", "x", "two"), ("b.py", "note", None, "three")], "path string, kind string, source string, information string")
    points.backup_memories(notes, str(tmp_path / "m"))
    back = points.restore_memories(spark, str(tmp_path / "m"), notes.schema, F.length)
    assert {(r.information, r.vector) for r in back.collect()} == {("one", 3), ("three", 5)}
    manifest = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, file_hash string")
    ops = spark.createDataFrame([('{"op":"moved","path":"c","file_hash":"1","old_path":"a"}',), ('{"op":"created","path":"../x","file_hash":"9"}',), ('{"op":"updated","path":"b","file_hash":"3"}',)], "operation string")
    assert {(r.path, r.file_hash) for r in points.apply_delta(manifest, ops).collect()} == {("c", "1"), ("b", "3")}


def test_rules(spark):
    assert one(spark, rules.secret_key(F.lit("my_api_key"))) and not one(spark, rules.secret_key(F.lit("path")))
    assert one(spark, rules.rooted_path(F.lit("\\a//b/"))) == "/work/a/b"
    assert one(spark, rules.matches_expected(F.lit("src/x/a.py"), F.lit("x"))) and not one(spark, rules.matches_expected(F.lit("src/xy/a.py"), F.lit("x")))
    assert one(spark, rules.bounded_score(F.lit(0.0), "tanh")) == 0.0
    assert one(spark, rules.full_extension(F.lit("a/b.d.ts"))) == "d.ts"
    assert one(spark, rules.language_matches(F.lit("Python"), F.lit("A.PY"))) and not one(spark, rules.language_matches(F.lit(None).cast("string"), F.lit("a.py")))
    assert expand.implied_query({"symbol": "fooBar", "under": "src/pool"}) == "foo bar src pool"


def test_reachable_pairs_are_not_shuffled(spark, monkeypatch):
    links = {(a, (a * a + k * k * 7 + k) % 90) for a in range(60) for k in range(5)}
    near: dict[int, set[int]] = {a: {b for x, b in links if x == a} for a in range(90)}
    want = {}
    for s in range(60):
        front, seen = near[s], set()
        for h in (1, 2, 3):
            want |= {(f"n{s}", f"n{b}", h): 1 for b in front - seen}
            seen, front = seen | front, {c for b in front - seen for c in near[b]}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links] * 2 + [(None, "n1"), ("n1", None)], "a string, b string")
    monkeypatch.setattr(graph, "ROWS", 7)
    walked = graph.reachable(edges, 3)
    assert "Exchange" not in walked._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, walked.collect())) == sorted(want)
    monkeypatch.setattr(graph, "GRAPH_BYTES", 0)
    assert sorted(map(tuple, graph.reachable(edges, 3).collect())) == sorted(want)
    assert graph.reachable(edges.where("a = 'none'"), 3).isEmpty()


def test_walks_and_variants(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a")], "a string, b string")
    assert {(r.start, r.node): r.hops for r in graph.reachable(edges, 3).where("start = 'a'").collect()} == {("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3, ("a", "d"): 3}
    ranked = spark.createDataFrame([(1, 7, 0.5), (2, 7, 0.9), (2, 8, 0.1)], "query_id int, id int, score double")
    of = spark.createDataFrame([(1, 100), (2, 100)], "variant_id int, query_id int")
    assert [(r.id, r.score) for r in retrieve.best_of_variants(ranked, of, 5).orderBy("rank").collect()] == [(7, 0.9), (8, 0.1)]
    truth = spark.createDataFrame([(1, 7), (2, 7), (2, 9)], "query_id int, id int")
    assert {r.query_id: r.passed for r in metrics.pass_at_k(ranked.withColumn("rank", F.lit(1)), truth, 3).collect()} == {1: True, 2: False}
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "id bigint, vec array<double>")
    assert patterns.similar_to(v, v.where("id = 0"), 2, 2).orderBy("rank").first().id == 3


def test_blocks_give_the_same_lists(spark):
    docs = spark.createDataFrame([(i, f"cache queue{i % 4} word{i}") for i in range(40)] + [(99, None)], "id bigint, text string")
    asked = spark.createDataFrame([(i, f"queue{i % 4} cache word{i}") for i in range(12)], "id bigint, text string")
    whole = retrieve.lexical_scan(asked, docs, 3).collect()
    assert sorted(whole) == sorted(retrieve.lexical_scan(asked, docs, 3, block_rows=4).collect()) and len(whole) == 36
    assert retrieve.lexical_scan(asked.limit(0), docs, 3).count() == 0 and retrieve.lexical_scan(asked, docs.limit(0), 3).count() == 0
    e = spark.createDataFrame([(i, [float(i), 1.0, float(i % 5)]) for i in range(30)], "vec_id bigint, embedding array<double>")
    assert sorted(retrieve.dense_topk(e, e, 3).collect()) == sorted(retrieve.dense_topk(e, e, 3, block_rows=7).collect())
    assert retrieve.gated_topk(e.where("vec_id < 3"), e, 3, 2, 10, 2).count() == 6


def test_hybrid_parts(spark):
    queries = spark.createDataFrame([(1, "open cache pool")], "query_id bigint, text string")
    rows = [(1, "src/cache_pool.py", "open", "def open(): cache", 1, 9, 5), (2, "docs/readme.md", "", "pool", 1, 9, 9), (3, "a.py", "", "nothing", 1, 2, 1)]
    got = {r.id: r for r in hybrid.scored(queries, spark.createDataFrame(rows, "id bigint, path string, symbol string, code string, start_line int, end_line int, modified bigint")).collect()}
    assert set(got) == {1, 2} and got[1]["rank"] == 1 and got[1].symbol_boost == hybrid.SYMBOL_EQUAL and got[1].filename_boost == pytest.approx(0.2)
    assert got[1].score == pytest.approx(sum(got[1][p] for p in hybrid.PARTS), abs=1e-5)
    assert one(spark, hybrid.declared_symbol(F.lit("# x\nexport async function go() {"))) == "go"


def test_drained_streams_keep_open_groups(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{5 * i:02d}:00", 1) for i in range(4)]
    df = spark.createDataFrame(rows, "id int, t string, user_id int").select("user_id", F.col("t").cast("timestamp").alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    df.write.parquet(str(tmp_path / "feed.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed.parquet"))
    assert [r.n for r in feeds.drain_all(feeds.windowed(stream), ["start", "event_type"]).collect()] == [4]
    assert [(r.user_id, r.changes) for r in feeds.bursts(stream, df, "user_id").collect()] == [(1, 4)]


def test_published_versions(spark, tmp_path):
    from marlspike.operators import incremental

    for v in ("1", "2"):
        incremental.publish(spark.createDataFrame([(v,)], "v string"), str(tmp_path), "t", v)
        assert [r.v for r in incremental.read_published(spark, str(tmp_path), "t").collect()] == [v]
    incremental.roll_back(spark, str(tmp_path), "t", "1")
    assert incremental.read_published(spark, str(tmp_path), "t").first().v == "1"


def test_repeated_requests(spark):
    rows = [(1, " Find  X", 0), (2, "find x", 50), (3, "FIND X", 61), (4, "find y", 1), (5, None, 2)]
    df = spark.createDataFrame(rows, "id int, q string, s int").select("id", "q", F.timestamp_seconds("s").alias("ts"))
    assert {r.id for r in feeds.distinct_requests(df, ["q"], 60).collect()} == {1, 3, 4, 5}
    assert one(spark, feeds.similar_request(F.lit("a b c"), F.lit("C b a")))


def test_registry_needs_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, capture_output=True, timeout=120)
    assert run.returncode == 0, run.stderr.decode()
