"""Core operators on small literal tables, against values worked out by hand or by plain Python."""

import hashlib
import math
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlspike.functions import scores, tokens
from marlspike.operators import chunking, expand, extract, filters, graph, incremental, metrics, patterns, postprocess, rerank, retrieve, telemetry
from marlspike.session import current_rows, current_rows_where
from marlspike.sources import files


def one(spark, column, value="x"):
    return spark.range(1).select(column.alias(value)).first()[0]


def test_ident_tokens_like_python(spark):
    for text in ["getHTTPResponse_code2", "the_query OF XMLParser", "", "naïve Straße42", "a1B2"]:
        want = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", text)]
        assert one(spark, tokens.ident_tokens(F.lit(text))) == want
    assert one(spark, tokens.ident_tokens(F.lit(None).cast("string"))) == []


def test_hash_and_id(spark):
    assert one(spark, tokens.token_hash(F.lit("queue"))) == int(hashlib.md5(b"queue").hexdigest()[:8], 16)
    want = hashlib.sha1(b"a.py:1-9\nx").hexdigest()[:16]
    assert one(spark, tokens.point_id(F.lit("a.py"), F.lit(1), F.lit(9), F.lit("x"))) == want


def test_symbol_variants(spark):
    assert one(spark, tokens.symbol_variants(F.lit("Pool.take"))) == ["Pool.take", "take", "Pool"]
    assert one(spark, tokens.symbol_variants(F.lit("a::B::c"))) == ["a::B::c", "c", "B"]
    assert one(spark, tokens.symbol_variants(F.lit(None).cast("string"))) == []


def test_cosine_and_jaccard(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, tokens.cosine(a, b)) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, tokens.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    empty = F.array().cast("array<string>")
    assert one(spark, tokens.jaccard(empty, empty)) == 1.0


def test_current_rows(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, "b", 2), (2, "c", None), (None, "z", 9), (3, "old", None), (3, "new", -5)]
    df = spark.createDataFrame(rows, "id int, text string, ingested_at bigint")
    want = {1: "b", 2: "c", 3: "new"}
    assert {r.id: r.text for r in current_rows(df, "id", ["text"]).collect()} == want
    kept = current_rows_where(df, "id", ["text"], F.col("text") != "a").collect()
    assert {r.id: r.text for r in kept} == want and len(kept) == 3
    assert current_rows(df.limit(0), "id", ["text"]).count() == 0


def test_scores(spark):
    assert one(spark, scores.rrf(F.lit(1))) == pytest.approx(1 / 31)
    assert one(spark, scores.scaled_rrf_k(F.lit(100))) == 30
    assert one(spark, scores.scaled_rrf_k(F.lit(100_000))) == 60
    assert one(spark, scores.sigmoid_z(F.lit(2.0), F.lit(2.0), F.lit(1.0))) == 0.5


def test_dsl_and_filters(spark):
    assert filters.parse_dsl("find lang:go  path:src/a file:src/b now") == ("find now", {"language": "go", "under": "src/b"})
    df = spark.createDataFrame([("src/a.py", "python"), ("src/x/test_b.py", "python"), ("c.go", "go")], "path string, language string")
    assert [r.path for r in filters.where_filters(df, {"language": "python", "under": "src"}).collect()] == ["src/a.py"]
    assert filters.where_filters(df, {"path_glob": "src/*"}).count() == 2
    assert filters.where_filters(df, {"path_regex": "("}).count() == 3
    assert [r.path for r in df.where(filters.is_test(F.col("path"))).collect()] == ["src/x/test_b.py"]
    with pytest.raises(ValueError):
        filters.where_filters(df, {"nothing": 1})


def test_line_chunks_like_a_loop(spark):
    texts = {1: "\n".join("abcdefghijklm"), 2: "x\n", 3: "a\r\nb\r\n", 4: "", 5: None, 6: "a\n\n", 7: "q"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = sorted((r.id, r.start_line, r.end_line) for r in chunking.line_chunks(df, "id", "text", 6, 2).collect())
    want = []
    for i, t in texts.items():
        lines = (t or "").splitlines()
        a = 0
        while lines:
            b = min(a + 6, len(lines))
            want.append((i, a + 1, b))
            if b == len(lines):
                break
            a = b - 2
    assert got == sorted(want)


def test_token_chunks_keep_offsets(spark):
    text = "  one two\nthree  four five"
    rows = chunking.token_chunks(spark.createDataFrame([(1, text), (2, "")], "id int, text string"), "id", "text", 2).collect()
    assert [text[r.start_char : r.end_char] for r in rows][:2] == ["one two", "two\nthree"]
    assert {r.id for r in rows} == {1}


def test_calls_imports_symbols(spark):
    assert one(spark, extract.calls(F.lit("if (a) foo(bar(1)); foo (2)"))) == ["foo", "bar"]
    df = spark.createDataFrame([(1, "Go", 'import "a/b"\nfunc F(x int) {\n}\ntype T struct {\n}'), (2, "python", "from os.path import join\nimport re"), (3, None, "x")], "id int, g string, text string")
    assert {(r.id, r.module) for r in extract.imports(df, "id", "g", "text").collect()} == {(1, "a/b"), (2, "os.path"), (2, "re")}
    assert [(r.kind, r.name, r.start_line, r.end_line) for r in extract.line_symbols(df, "id", "g", "text").orderBy("start_line").collect()] == [("function", "F", 2, 3), ("struct", "T", 4, 5)]
    py = spark.createDataFrame([(1, "class A:\n    def f(self):\n        pass\n"), (2, "def ("), (3, None)], "id int, text string")
    assert [(r.kind, r.name, r.start_line) for r in extract.python_symbols(py, "id", "text").collect()] == [("class", "A", 1), ("function", "f", 2)]


def test_dense_topk(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r.id, r.score, r["rank"]) for r in retrieve.dense_topk(e.where("vec_id = 0"), e, 2).orderBy("rank").collect()]
    assert got == [(0, 1, 1.0, 1), (0, 2, 0.0, 2)]
    assert retrieve.dense_topk(e.limit(0), e, 2).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id int, id int, rank int")
    got = {r.id: r.score for r in retrieve.fuse([(a, 1.0), (b, 2.0)]).collect()}
    assert got == {11: round(1 / 32 + 2 / 31, 9), 10: round(1 / 31, 9)}


def test_postprocess(spark):
    rows = pd.DataFrame({"path": ["a", "a", "b"], "start_line": [1, 20, 1], "end_line": [10, 30, 5], "symbol": ["", "", ""], "score": [3.0, 2.0, 1.0]})
    assert list(postprocess.cluster_adjacent(rows)["score"]) == [3.0, 1.0]
    same = pd.DataFrame({"path": ["x/a", "x/a", "y/b"], "symbol": [None, None, None], "score": [1.0, 0.9, 0.8]})
    assert list(postprocess.diversify(same)["path"]) == ["x/a", "y/b", "x/a"]
    spans = pd.DataFrame({"path": ["a", "a"], "start_line": [1, 8], "end_line": [6, 12], "score": [1.0, 2.0]})
    out = postprocess.budget_spans(spans, tokens_per_line=10, budget=50)
    assert out[["start_line", "end_line", "tokens"]].values.tolist() == [[1, 5, 50]]


def test_metrics(spark):
    rows = [(1, 1, False, 2), (1, 2, True, 2), (1, 3, True, 2), (2, 1, False, 1)]
    q = {r.query_id: r for r in metrics.ranking_quality(spark.createDataFrame(rows, "query_id int, rank int, relevant boolean, n_relevant int")).collect()}
    assert q[1].mrr == 0.5 and q[1].recall == 1.0 and q[2].hit == 0
    assert q[1].ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)), abs=1e-6)
    tau = metrics.kendall_tau(spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 1), (1, 3, 3, 3)], "query_id int, id int, a int, b int")).first()
    assert tau.tau == pytest.approx(1 / 3, abs=1e-6)


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, file_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3")], "path string, file_hash string")
    c = incremental.classify(old, new)
    assert {r.path: r.op for r in c.collect()} == {"a": "unchanged", "b": "updated", "c": "deleted", "d": "created"}
    assert [(r.old_path, r.new_path) for r in incremental.moves(c).collect()] == [("c", "d")]
    p = spark.createDataFrame([(1, "x", 1)], "id int, v string, at int")
    up = incremental.upsert(p, spark.createDataFrame([(1, "y", 1), (2, "z", 0)], "id int, v string, at int"), "id", "at")
    assert {r.id: r.v for r in up.collect()} == {1: "y", 2: "z"}


def test_publish(spark, tmp_path):
    for version in ("1", "2"):
        incremental.publish(spark.createDataFrame([(version,)], "v string"), str(tmp_path), "points", version)
    assert [r.v for r in incremental.read_published(spark, str(tmp_path), "points").collect()] == ["2"]


def test_graph(spark):
    chunks = spark.createDataFrame([(1, ["take", "take"]), (2, ["Pool.take"]), (3, None)], "id int, calls array<string>")
    got = {(r.id, r.strategy) for r in graph.callers(chunks, spark.createDataFrame([("Pool.take",)], "symbol string")).collect()}
    assert got == {(1, 2), (2, 1)}


def test_patterns_and_telemetry(spark):
    f = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "a", 5), (3, "b", 1)], "id int, feature string, weight int")
    g = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g")], "id int, group string")
    r = patterns.common_features(f, g).first()
    assert (r.members, r.common, r.weight) == (3, 1, 1)
    spans = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "name string, duration double")
    assert telemetry.tool_usage(spans).first().p90_duration == pytest.approx(2.8)


def test_rerank_and_expand(spark):
    assert rerank.alpha(0, 3) == pytest.approx(0.8) and rerank.alpha(2, 3) == pytest.approx(0.2)
    q = spark.createDataFrame([(1, "a Function here")], "query_id int, text string")
    s = spark.createDataFrame([("function", "method")], "word string, synonym string")
    assert {(r.text, r.tier) for r in expand.expand(q, s).collect()} == {("a Function here", 0), ("a method here", 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.js").write_text("y")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    got = files.read_tree(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in got] == [("a.py", "x = 1\n")]
    df = spark.createDataFrame([(1, 'a,"b"')], "id int, t string")
    assert files.write_toon(df, ["id", "t"]) == 'results[1]{id,t}:\n  1,"a,\\"b\\""'


def test_registry_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "marlspike"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_lexical_score_reads_the_whole_code(spark):
    from pyspark.sql import functions as F

    from marlspike.functions import scores

    df = spark.createDataFrame([(1, "x " * 1500 + "Needle"), (2, "x"), (3, None)], "id int, code string")
    fields = df.select("id", *scores.lexical_fields(F.lit(None).cast("string"), F.lit("a/b.py"), F.col("code")))
    assert {r.id: r.s for r in fields.select("id", scores.lexical_score(F.array(F.lit("needle"))).alias("s")).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
