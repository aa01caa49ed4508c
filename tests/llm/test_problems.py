"""The eight problems on small tables, against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.llm import clustering, documented_code, leakage, near_duplicates, nearest_vectors, residue, splitting, tokenizing

random.seed(5)
WORDS = [f"w{i}" for i in range(60)]


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def shingles(t):
    w = re.findall(r"[a-z0-9_]+", (t or "").lower())
    return frozenset(zip(w, w[1:], w[2:]))


def similar_pairs(rows, threshold=0.7):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def near_rows():
    rows = [(i, text(60)) for i in range(40)]
    for i in range(40, 80):
        w = rows[i - 40][1].split()
        w[random.randrange(60)] = "changed"
        rows.append((i, " ".join(w)))
    return [*rows, (100, None), (101, ""), (102, "a b"), (103, rows[0][1]), (104, rows[0][1].upper()), (None, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize("bucket", [256, 1])
def test_near_duplicates_like_brute_force(spark, near_rows, bucket):
    df = spark.createDataFrame(near_rows, "id bigint, t string").withColumn("rep", F.lit(1)).withColumn("item", F.lit("x"))
    got = [(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "id", "t", bucket_pairs=bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == similar_pairs(near_rows)


def test_near_duplicates_large_class_is_a_star(spark):
    df = spark.createDataFrame([(i, "a b c d e") for i in range(6)], "id bigint, t string")
    got = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "id", "t", class_pairs=3).collect()}
    assert got == {(0, i) for i in range(1, 6)}
    assert {(r["item"], r.class_id, r.n_members) for r in near_duplicates.near_duplicate_classes(df, "id", "t").collect()} == {(i, 0, 6) for i in range(6)}
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "id", "t").count() == 0


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_of_a_hot_class(spark, block):
    base = text(60)
    other = " ".join(["changed", *base.split()[1:]])
    rows = [(i, base.replace(" ", " " * (1 + i % 3)) + "." * (i % 5)) for i in range(70)] + [(i, other) for i in range(70, 73)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    got = [(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "id", "t", pair_block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == similar_pairs(rows) and len(got) == 73 * 72 // 2
    starred = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "id", "t", class_pairs=4, pair_block=block).collect()}
    texts = dict(rows)
    least = {t: min(i for i, u in rows if u == t) for t in texts.values()}
    assert {(a, b) for a, b in similar_pairs(rows) if a == least[texts[a]] and b == least[texts[b]]} <= starred < set(got)


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**62), 2**62, 60)
    b = np.r_[a[:40], rng.integers(-(2**62), 2**62, 20)]
    s = near_duplicates.dart_minhash([a, b], 2048)
    assert abs((s[0] == s[1]).mean() - 40 / 80) < 0.05
    w = [np.full(60, 2.5), np.full(60, 1.0)]
    s = near_duplicates.dart_minhash([a, a], 2048, w)
    assert abs((s[0] == s[1]).mean() - 1 / 2.5) < 0.05


def unit_rows(n=120, dim=8):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, dim))
    x = np.repeat(centres, n // 12, axis=0) + 0.03 * rng.normal(size=(n, dim))
    return [(f"v{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)]


def odd_vectors(dim=8):
    return [("n1", None), ("n2", []), ("n3", [0.0] * dim), ("n4", [float("nan")] * dim), ("n5", [1.0]), (None, [1.0] * dim)]


@pytest.mark.parametrize("budget", [nearest_vectors.BUDGET, None])
def test_nearest_vectors_like_brute_force(spark, budget):
    rows = unit_rows()
    rows += [(f"c{i}", rows[0][1]) for i in range(9)]
    df = spark.createDataFrame([*rows, *odd_vectors(), rows[5]], "id string, vec array<double>").withColumn("cell", F.lit(1)).withColumn("q", F.lit(0))
    got = {}
    for r in nearest_vectors.nearest_vectors(df, "id", "vec", 8, 0.3, budget=budget).collect():
        got.setdefault(r.q, set()).add(r.id)
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    for i, q in enumerate(ids):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near = sorted((d[j], ids[j]) for j in range(len(ids)) if j != i and d[j] <= 0.3)[:5]
        assert got.get(q, set()) == {n for _, n in near}, q
    assert nearest_vectors.nearest_vectors(df.limit(0), "id", "vec", 8, 0.3).count() == 0


def components(rows, threshold=0.7, least=3):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    name = list(range(len(ids)))
    for a, b in zip(*np.nonzero(x @ x.T >= threshold - 1e-12), strict=True):
        lo, hi = sorted((name[a], name[b]))
        name = [lo if n == hi else n for n in name]
    groups = {}
    for i, n in enumerate(name):
        groups.setdefault(n, []).append(ids[i])
    return {(min(g), i) for g in groups.values() if len(g) >= least for i in g}


def test_clusters_like_components(spark):
    rows = unit_rows()
    rows += [(f"z{i}", [float(np.cos(i * 0.7)), float(np.sin(i * 0.7))] + [0.0] * 5 + [0.001]) for i in range(5)]
    df = spark.createDataFrame([*rows, *odd_vectors(), rows[7]], "id string, vec array<double>").withColumn("cluster", F.lit(1)).withColumn("node", F.lit(1))
    found = clustering.Clusters(df, "id", "vec", 8)
    got = [(r.cluster, r.id) for r in found.members().collect()]
    assert len(got) == len(set(got)) and set(got) == components(rows)
    shapes = found.clusters().collect()
    assert sum(r["size"] for r in shapes) == len(got) and all(len(r.typical) == 3 for r in shapes)
    parts = found.communities().collect()
    assert sum(r["size"] for r in parts) == len(got) and {r.cluster for r in parts} == {c for c, _ in got}
    split = clustering.Clusters(df, "id", "vec", 8, part_nodes=20)
    assert {(r.cluster, r.id) for r in split.members().collect()} == components(rows)
    empty = clustering.Clusters(df.limit(0), "id", "vec", 8)
    assert empty.members().count() == 0 and empty.communities().count() == 0


@pytest.mark.parametrize("noise", [0.0, 1e-4])
def test_clusters_of_many_copies(spark, noise):
    rng = np.random.default_rng(8)
    a, b = np.eye(8)[0], 0.8 * np.eye(8)[0] + 0.6 * np.eye(8)[1]
    rows = [(f"{n}{i:02d}", [float(v) for v in (1 + i) * (x + noise * rng.normal(size=8))]) for n, x in (("a", a), ("b", b)) for i in range(20)]
    rows += [(f"c{i:02d}", [0.0] * 7 + [float(i + 1)]) for i in range(50)]
    got = {(r.cluster, r.id) for r in clustering.Clusters(spark.createDataFrame(rows, "id string, vec array<double>"), "id", "vec", 8).members().collect()}
    assert got == {("a00", i) for i, _ in rows[:40]} | {("c00", i) for i, _ in rows[40:]} == components(rows)


def test_a_pass_that_joins_clusters_has_few_jobs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a, b = np.eye(8)[0], 0.8 * np.eye(8)[0] + 0.6 * np.eye(8)[1]
    rows = [(f"{n}{i:02d}", [float(v) for v in (1 + i) * (x + 1e-4 * rng.normal(size=8))]) for n, x in (("a", a), ("b", b)) for i in range(20)]
    start = clustering.start_graph

    def marked(*args, **kwargs):
        spark.sparkContext.setJobGroup(f"pass {kwargs.get('seed')}", "")
        return start(*args, **kwargs)

    monkeypatch.setattr(clustering, "start_graph", marked)
    found = clustering.Clusters(spark.createDataFrame(rows, "id string, vec array<double>"), "id", "vec", 8)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("pass 101"))
    spark.sparkContext.setJobGroup("", "")
    assert found.passes == 2 and {(r.cluster, r.id) for r in found.members().collect()} == components(rows)
    assert 0 < jobs <= 39, jobs


def test_clusters_with_every_centroid_fifty_times(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres, centres[:20] + 0.45 * rng.normal(size=(20, 16))])
    rows = [(f"{i:02d}-{j:02d}", [float(v) for v in r * (1 + j) + 1e-5 * rng.normal(size=16)]) for i, r in enumerate(x) for j in range(50)]
    got = {(r.cluster, r.id) for r in clustering.Clusters(spark.createDataFrame(rows, "id string, vec array<double>"), "id", "vec", 16).members().collect()}
    assert got == components(rows)


def test_communities_raise_modularity():
    rng = np.random.default_rng(6)
    group = np.repeat(np.arange(6), 20)
    u, v = np.triu_indices(120, 1)
    ok = rng.random(len(u)) < np.where(group[u] == group[v], 0.5, 0.02)
    u, v, w = u[ok], v[ok], np.ones(int(ok.sum()))
    degree = np.bincount(np.r_[u, v], minlength=120).astype(float)
    own = clustering.local_communities(u, v, w, dict(enumerate(degree.tolist())), 2.0 * len(u))
    assert len({(own[i], group[i]) for i in range(120)}) == 6 == len(set(own.values()))


@pytest.mark.parametrize("part", [500_000, 3])
def test_merge_linked(spark, part):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 40) if i % 7] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(15)]
    name = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            name[a] = name[b] = min(name[a], name[b])
    got = {r.c: r.l for r in clustering.merge_linked(spark.createDataFrame(pairs, "a bigint, b bigint"), part).collect()}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in name.items() if k != v}


def test_sparse_table_and_pieces():
    values = np.random.default_rng(3).integers(0, 3, 50)
    index = splitting.RightmostMax(values)
    for lo in range(50):
        for hi in range(lo, 50):
            best = max(values[lo : hi + 1])
            assert index.query(lo, hi) == max(i for i in range(lo, hi + 1) if values[i] == best)
    assert splitting.cut_pieces(np.zeros(121, np.int8)) == [(0, 119, False), (100, 120, True)]
    with pytest.raises(ValueError):
        splitting.cut_pieces(np.zeros(9), 5, 2, 2)


def test_split_oversized(spark):
    lines = [f"x{i}" for i in range(130)]
    lines[60] = " \t"
    lines[99:101] = ["@mark", "def f():"]
    rows = [(1, "\n".join(lines), 11), (2, "\r\n".join(lines) + "\r\n", None), (3, "a\n" * 120, 1), (4, None, 1), (5, "", 1)]
    df = spark.createDataFrame(rows, "id bigint, t string, s int").withColumn("item_id", F.lit(0))
    got = {(r.item_id, r.piece_start, r.piece_end) for r in splitting.split_oversized(df, "id", "t", "s").collect()}
    # line 99 stands before the mark; line 100 is the mark itself
    assert got == {(1, 11, 109), (1, 90, 140), (2, 1, 99), (2, 80, 130)}
    assert splitting.split_lines("a\rb\r\nc\r") == ["a\rb", "c\r"]


PYTHON = '''
"""def no(): pass"""
@cached(7)
async def alpha(x: int = len("):")) -> str:  # note
    # a remark
    r"""Reads every row twice before it answers."""
    def inner(): "Counts what the outer call has left."
class A:
    def beta(self):
        x = "def gamma():"
        return f"""def delta(): {x}"""
'''
JAVA = """
class A {
    // Keeps the last four rows of the table.
    @Override
    public int alpha(String s) { return s.indexOf("}"); }
    // Not next to anything at all, sadly.

    int beta() { if (x) { y(); } return 1; }
    /* Draws both maps at once. */ /** Says what happens to lost rows. */
    @A(x = 1,
       y = 2)
    void gamma() throws E { }
    abstract void delta();
}
"""


def test_functions_and_documentation():
    got = {f.name: (f.start_line, documented_code.clean_documentation(f.documentation)) for f in documented_code.functions(PYTHON, "python")}
    assert got == {"alpha": (4, "Reads every row twice before it answers."), "inner": (7, "Counts what the outer call has left."), "beta": (9, "")}
    got = {f.name: (f.start_line, bool(f.documentation)) for f in documented_code.functions(JAVA, "java")}
    assert got == {"alpha": (5, True), "beta": (8, False), "gamma": (12, True)}
    js = "// Turns the rows into a map of names.\nexport const f = async (a) => {\n}\nconst g = `function no() {${'`'}`;\nclass A {\n  /** Waits for both sides to end. */\n  go(x) { }\n}\n"
    assert [(f.name, f.start_line, f.kind) for f in documented_code.functions(js, "javascript")] == [("f", 2, "function"), ("go", 7, "method")]
    rust = "/// Holds /* the */ rows of one page.\n#[inline]\npub fn a<'x>(s: &'x str) -> char { '{' }\nfn b();\n/* out /* in */ fn no() {} */\n"
    assert [(f.name, f.start_line) for f in documented_code.functions(rust, "rust")] == [("a", 3)]


def test_documentation_above_long_annotations():
    nested = "@ApiResponses(value = {\n  @ApiResponse(code = 1,\n    text = \"){\"),\n\n  @ApiResponse(code = 2)\n})"
    long = "@A({\n" + "".join(f"  @B({i}),\n" for i in range(60)) + "}) @Override"
    for mark in (nested, long, "@A @C(\n  x = 1) @D(2)", nested + "\n@Override\n" + long):
        java = f"class A {{\n/** Keeps the last four rows. */\n{mark}\nvoid f() {{ }}\n}}\n"
        assert [f.documentation for f in documented_code.functions(java, "java")] == ["/** Keeps the last four rows. */"], mark
    for other in ("call({\n  @A(1)\n})", "int x = call(\n  1)", "]", ")"):
        java = f"class A {{\n/** Keeps the last four rows. */\n{other}\nvoid f() {{ }}\n}}\n"
        assert not any(f.documentation for f in documented_code.functions(java, "java")), other
    ts = "class A {\n  /** Keeps the last four rows. */\n  @Input({\n    a: { b: [1, 2] },\n    c() { return 1; },\n  })\n  go(x: string) { }\n}\n"
    assert {f.name: f.documentation for f in documented_code.functions(ts, "typescript")}["go"]
    rust = "/// Keeps the last four rows.\n#[cfg(any(\n  a,\n\n  b\n))]\nfn f() {}\n"
    assert documented_code.functions(rust, "rust")[0].documentation


def test_functions_without_result_type():
    go = "// Drops all rows of the page.\nfunc drop() {\n\tx := 1\n}\n// Drops what is left of it.\nfunc (p *Page) rest(n int) { }\n// Gives any row that is left.\nfunc any() interface{} {\n\treturn nil\n}\nfunc asm()\nfunc both() (map[string]struct{}, error) {\n}\n"
    assert [(f.name, f.start_line, f.end_line, f.signature) for f in documented_code.functions(go, "go")] == [("drop", 2, 4, "func drop()"), ("rest", 6, 6, "func (p *Page) rest(n int)"), ("any", 8, 10, "func any() interface{}"), ("both", 12, 13, "func both() (map[string]struct{}, error)")]
    rust = "/// Drops all rows of the page.\nfn a() {\n  b();\n}\nfn no();\npub fn b<T>(&self, t: T)\nwhere\n    T: Fn(u8) -> u8,\n{\n}\nfn c() -> Rows<{ N + 1 }> {\n}\nfn last() {}\n"
    assert [(f.name, f.start_line, f.end_line, f.signature) for f in documented_code.functions(rust, "rust")] == [("a", 2, 4, "fn a()"), ("b", 6, 10, "pub fn b<T>(&self, t: T) where T: Fn(u8) -> u8,"), ("c", 11, 12, "fn c() -> Rows<{ N + 1 }>"), ("last", 13, 13, "fn last()")]


@pytest.mark.parametrize(("doc", "name", "trivial"), [
    (None, "f", True), ("", "f", True), ("// TODO: say what rows are kept here", "f", True), ("eslint-disable-next-line a b c d", "f", True),
    ("Opens the big file.", "open_big_file", True), ("@param rows all the rows there are", "f", True), ("Reads four rows at once.", "f", False),
    ("Auto-generated method stub; replace this text.", "f", True), ("Writes every row to the documentation table.", "f", False),
])
def test_trivial_documentation(doc, name, trivial):
    assert documented_code.is_trivial(doc, name) is trivial


@pytest.mark.parametrize("doc", [
    "Replace the text between two markers with another value.", "Write the summary of every finished run to the report file.", "Add a comment to the open issue on behalf of the caller", "Describe the function table as a list of rows.",
    "Put every comment\non its own line of the page.", "Suppresses duplicate events of one key.", "Suppress warnings of the parser until the next run.", "Generated ids are kept in the table.", "Created by the factory once a session.", "Region names are mapped to their hosts.",
    "Placeholder values are filled from the row.", "Missing documents are fetched anew.", "Summary of pending jobs of each queue.", "Undocumented endpoints are left out of the list.", "Pragma settings are applied before the first row.", "Checkstyle rules are read from two files.", "This method is automatically called after each row.",
])
def test_sentences_that_begin_like_prompts(doc):
    assert not documented_code.is_trivial(doc, "f")


@pytest.mark.parametrize("doc", [
    "Add a short summary of the function and its arguments here.", "Please add documentation for this function.", "Describe what this method does.", "Explain what the function does", "Write the docs of this function and its arguments.", "Insert a short description here.\n@param a the first of all rows", "Please fill in the documentation.",
    "Replace this text with a real description.", "Description of what f does goes here.", "Generated by the scaffold tool. Please fill in the documentation.", "Code generated by protoc-gen-go. DO NOT EDIT.", "Created by jo on 12.03.2019 with some editor", "// #region Helpers of the page table", "//region helpers of pages", "suppress(all of the warnings here)", "CHECKSTYLE:OFF: line length and method count",
    "Placeholder for the real description of it", "eslint no-undef: 0, no-shadow: 0, a: 1",
])
def test_prompts_and_directives(doc):
    assert documented_code.is_trivial(doc, "f")


def test_documented_functions_table(spark):
    files = spark.createDataFrame([(1, "a.py", None, PYTHON), (2, "b.java", "java", None), (3, "c.txt", None, "def f(): pass"), (4, "d.py", "python", ""), (None, "e.py", "python", PYTHON), (5, None, None, None)], "file_id bigint, path string, language string, text string").withColumn("kind", F.lit("x"))
    symbols = spark.createDataFrame([(2, "f", "Method ", 7, 9, "void f() {", "Says which rows are lost."), (2, "g", "class", 1, 9, "class g {", "Says which rows are lost."), (2, "h", None, 20, 21, "void h() {", "todo"), (1, "i", "function", 3, 4, "def i():", "Says which rows are lost."), (2, None, None, None, None, None, None)], "file_id bigint, name string, kind string, start_line int, end_line int, signature string, docstring string")
    got = {(r.file_id, r.start_line) for r in documented_code.documented_functions(files, symbols).collect()}
    assert got == {(1, 4), (1, 7), (2, 7)}
    assert documented_code.documented_functions(files.limit(0), symbols.limit(0)).count() == 0


def test_tokenizer_like_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    if not tokenizing.os.path.exists(tokenizing.rank_path()):
        pytest.skip("no vocabulary files here")
    ranks = {t.encode("latin-1"): r for t, r in tokenizing.load_ranks(tokenizing.rank_path()).items()}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "  ", "a" * 3000, "it's a　 \x85 test\r\n\t x", "<|endoftext|> <s>", "日本語のテキスト" * 30, "👩‍💻" * 20, "naïve ½ ™", " " * 300 + "x", "same", "same"]
    df = spark.createDataFrame([(min(i, 10), t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("word", F.lit("x"))
    out = tokenizing.encode_corpus(df, hot_words=5)
    rows = out.collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == sorted((min(i, 10), library.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert {r.doc_id: r.text for r in tokenizing.decode_corpus(out).collect()} == {min(i, 10): t or "" for i, t in enumerate(texts)}
    assert tokenizing.encode_corpus(df.limit(0)).count() == 0


def test_leaks_like_brute_force(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([30, 20, 12, 11, 6, 5, 0])] + [(7, None), (None, "a b c d e f"), (0, None)]
    docs = []
    for d in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        i, t = rng.choice(items[:6])
        part = t.split()
        cut = rng.randrange(0, max(1, len(part) - 8))
        docs.append((d, ", ".join([*w[:9], *part[cut : cut + rng.choice([8, 12, 14])], *w[9:]]).upper()))
    docs += [(100, None), (101, ""), (None, items[0][1]), (5, docs[5][1])]
    ddf = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("term", F.lit(2))
    idf = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = [(r.doc_id, r.item_id) for r in leakage.leaked_documents(ddf, idf).collect()]
    want = set()
    for d, t in docs:
        for i, s in items:
            w, q = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (t, s))
            need = min(12, len(q))
            if d is not None and i is not None and len(q) >= 6 and any(w[a : a + need] == q[b : b + need] for a in range(len(w) - need + 1) for b in range(len(q) - need + 1)):
                want.add((d, i))
    assert want and len(got) == len(set(got)) and set(got) == want
    assert leakage.leaked_documents(ddf.limit(0), idf).count() == 0 and leakage.leaked_documents(ddf, idf.limit(0)).count() == 0


def test_proximity_like_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([16, 12, 8])]
    docs = []
    for d in range(40):
        t = rng.choice(items)[1].split()
        t.insert(rng.randrange(len(t)), "between")
        docs.append((d, " ".join([*[rng.choice(words) for _ in range(rng.randrange(20))], *t])))
    ddf, idf = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    tests = leakage.test_items(idf, "item_id", "text")
    pairs = {d: [(i, p) for i, p in enumerate(zip(t.split(), t.split()[1:]))] for d, t in docs}
    placed = {i: list(enumerate(zip(t.split(), t.split()[1:]))) for i, t in items}
    named = {r.term: (r.x, r.y) for r in spark.createDataFrame(sorted({p for v in placed.values() for _, p in v}), "x string, y string").selectExpr("x", "y", "xxhash64(x, y) as term").collect()}
    code = {p: t for t, p in named.items()}
    df = {p: sum(q == p for v in pairs.values() for _, q in v) for p in code}
    want = {}
    for i, v in placed.items():
        need = min(12, len(v) + 1)
        anchors = set()
        for s in range(len(v) - need + 2):
            w = v[s : s + need - 1]
            if all(df[p] for _, p in w):
                (_, p1, t1), (_, p2, t2) = sorted((df[p], at, code[p]) for at, p in w)[:2]
                anchors.add((p1, named[t1], p2, named[t2]))
        for d, at in pairs.items():
            hits = {(p1, b) for p1, a, p2, b in anchors for x, q in at if q == a for y, r in at if r == b and abs(y - (x - p1 + p2)) <= 4}
            if hits:
                want[(d, i)] = len(hits)
    for bound in (leakage.BROADCAST_BYTES, 0):
        monkeypatch.setattr(leakage, "BROADCAST_BYTES", bound)
        got = {(r.doc_id, r.item_id): r.windows for r in leakage.PositionalIndex(ddf, tests).proximity_matches(4).collect()}
        assert got == want and want
    assert {(r.doc_id, r.item_id) for r in leakage.PositionalIndex(ddf, tests).proximity_matches(4, 2).collect()} == {k for k, n in want.items() if n >= 2}
    leakage.write_index(ddf, str(tmp_path / "index"), files=3)
    stored = leakage.PositionalIndex(ddf, tests, index=spark.read.parquet(str(tmp_path / "index")))
    assert {(r.doc_id, r.item_id): r.windows for r in stored.proximity_matches(4).collect()} == want


def test_residue(spark):
    rng = random.Random(4)
    plain = ["The {0} now reads the {1} first.", "We moved {0} out of the {1}.", "If {0} returns nothing, check the {1}.", "Fixes a slow {0} in the {1} path."]
    nouns = ["queue", "table", "parser", "index", "router", "cache"]
    rows = [(i, " ".join(rng.choice(plain).format(rng.choice(nouns), rng.choice(nouns)) for _ in range(5))) for i in range(300)]
    bad = {1000: "Page not found", 1001: rows[0][1] + "\nDear {{ first_name }},", 1002: "Error establishing a connection to the cache database", 1003: "Lorem ipsum dolor sit amet consectetur.", 1004: "Please enable JavaScript to view this page.", 1005: "{{ name }} is a ${KIND} for <<TARGET>>. Maintained by %%OWNER%%.", 1006: "{{title}}", 1007: "xxxxx xxxx xxxxxx xxx", 1008: "${" + "a" * 200 + "}", 1009: "404 Not Found\nThe page went away."}
    good = {2000: 'The handler says "Page not found" for every lost row.', 2001: "```\nDear {{ first_name }},\n```\nThis is how the table looks.", 2002: "> You need to enable JavaScript to run this app.", 2003: "Set `${CACHE_HOME}` before you run the queue.", 2004: None, 2005: "", 2006: "  \n", 2007: "[x] read the table, [ ] fix the cache", 2008: "## 1.2.3", 2009: "word " * 20_000, 2010: "{{ half", 2011: '"{{title}}"'}
    df = spark.createDataFrame([*rows, *bad.items(), *good.items(), (None, "Page not found"), (1000, "Page not found")], "doc_id bigint, text string").withColumn("trusted", F.lit(True))
    assert {r.doc_id for r in residue.residue_records(df).collect()} == set(bad)
    assert residue.residue_records(df.limit(0)).count() == 0
    assert residue.residue_records(df.where("doc_id < 300")).count() == 0


def test_residue_is_learned_beside_the_seeds(spark):
    plain = [(i, f"The parser reads table {i} first. Then it fixes the queue.") for i in range(400)]
    page = [(1000 + i, f"Page not found\nThe shelf{i} you wanted has been carried off.") for i in range(30)]
    alone = [(2000 + i, f"The shelf{i} you wanted has been carried off.") for i in range(5)]
    df = spark.createDataFrame(plain + page + alone, "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residue_records(df).collect()} == {i for i, _ in page + alone}


def test_windows_of_long_passages():
    words = ["word"] * 350 + ["page", "missing"] + ["word"] * 350
    windows = residue.Featurizer().windows(" ".join(words))
    assert all(len(w) <= residue.WINDOW for w in windows) and sum(len(w) for w in windows) >= len(words)
    assert any(len(set(w)) == 3 for w in windows)
