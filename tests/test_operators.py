import pytest
from pyspark.sql import functions as F

from millrace.operators import bundle, chunk, delta, evaluate, graph, link, memory, search


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n, windows", [(0, 0), (3, 1), (50, 1), (51, 2), (90, 2), (91, 3), (150, 4)])
def test_chunk_windows(spark, n, windows):
    text = "\n".join(f"l{i}" for i in range(n))
    got = chunk.chunk_lines(spark.createDataFrame([(text,)], "text string")).orderBy("idx").collect()
    assert len(got) == windows
    if got:
        assert got[0]["line_start"] == 1 and got[-1]["line_end"] == n
        assert [r["line_start"] for r in got] == [1 + 40 * k for k in range(windows)]


def test_doc_chunks_follow_headings(spark):
    text = "lost line\n# One\na\nb\nTwo\n===\nc\n#!not\n" + "\n".join(["# Long", *("x" for _ in range(130))])
    got = chunk.chunk_docs(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).orderBy("idx").collect()
    assert got[0]["chunk"].startswith("# One") and "lost" not in got[0]["chunk"]
    assert got[1]["chunk"].startswith("Two\n===") and "#!not" in got[1]["chunk"]
    assert [r["chunk"].split("\n")[0] for r in got[2:]] == ["# Long"] * 3
    plain = chunk.chunk_docs(spark.createDataFrame([(2, "a\nb")], "id int, text string"), ["id"]).collect()
    assert [r["chunk"] for r in plain] == ["a\nb"]


def test_rrf_and_prior(spark):
    lists = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 3), ("c", 2, 1), ("d", 2, 2), ("a", 2, 3)], "doc string, list_no int, rank int")
    order = [r["doc"] for r in search.rrf_fuse(lists).orderBy("rank").collect()]
    assert order.index("a") < order.index("b") and order.index("c") < order.index("d")
    prior = spark.createDataFrame([("b", 0.5), ("zz", 9.0)], "doc string, bonus double")
    assert [r["doc"] for r in search.rrf_fuse(lists, prior).orderBy("rank").collect()][0] == "b"
    assert "zz" not in [r["doc"] for r in search.rrf_fuse(lists, prior).collect()]


def test_rerank_moves_only_the_head(spark):
    ranking = spark.createDataFrame([(i, i) for i in range(1, 7)], "doc int, rank int")
    got = search.rerank(ranking, lambda d: d.cast("double"), head=3).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [3, 2, 1, 4, 5, 6]
    assert search.rerank(ranking, None) is ranking


@pytest.mark.parametrize("label", [None, 3])
def test_batches_of_vectors_hold_few_products_and_pass_on_k_of_a_tie(label):
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    def table(name, vectors):
        columns = {name: np.arange(len(vectors))[::-1], "v": pa.array(vectors.tolist(), pa.list_(pa.float32()))}
        return pa.table(columns | ({"_q": [label] * len(vectors)} if label else {}))

    x = np.ones((4000, 8))
    x[::2, 0] = 2  # two groups of equal vectors
    asked = table("query_id", x).select(["query_id", "v", *(["_q"] if label else [])]).rename_columns(["query_id", "query_vec", *(["_q"] if label else [])])
    batch = table("vec_id", x[:1000]).combine_chunks().to_batches()[0]
    tracemalloc.start()
    got, most = [], 0
    for out in search._best_of(SimpleNamespace(value=asked), 3)(iter([batch])):
        got.append((out.num_rows, out.slice(0, 6).to_pydict()))
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert sum(n for n, _ in got) == 3 * 4000
    assert most < 40e6
    assert got[0][1]["vec_id"] == [1, 3, 5, 0, 2, 4] and got[0][1]["score"] == [1.0] * 6


def test_hops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert rows(search.one_hop(edges, seeds)) == [("b",), ("d",)]
    assert rows(search.k_hop(edges, seeds, 2)) == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]


@pytest.mark.parametrize("held", [0, 100])
def test_hops_make_no_set_of_all_edges(spark, monkeypatch, held):
    monkeypatch.setattr(search, "HELD", held, raising=False)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b"), ("c", "d"), ("d", "e"), ("b", None)], "src string, dst string")
    hops = search.k_hop(edges.unionByName(edges), spark.createDataFrame([("a",), ("a",)], "id string"), 3)
    assert sorted(map(tuple, hops.where("id is not null").collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert "Aggregate [src" not in hops._jdf.queryExecution().optimizedPlan().toString()


def test_vector_topk_filters_before_or_after(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.9, 0.1], "x"), (3, [0.0, 1.0], "y"), (4, None, "y")], "vec_id int, embedding array<double>, repo string")
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert [r["vec_id"] for r in search.vector_topk(v, q, 2, where=F.col("repo") == "y").collect()] == [3]
    assert search.vector_topk(v, q, 2, where=F.col("repo") == "y", post_filter=True).count() == 0


def test_innermost_interval(spark):
    points = spark.createDataFrame([("p1", "f", 5), ("p2", "f", 25), ("p3", "f", 99)], "call string, file string, line int")
    spans = spark.createDataFrame([("outer", "f", 1, 30), ("inner", "f", 4, 8), ("tie", "f", 22, 26), ("tie2", "f", 23, 27)], "fq string, file string, lo int, hi int")
    for bucket in (None, 7):
        got = graph.innermost(points, spans, ["file"], "line", "lo", "hi", ["call"], [F.asc("lo")], bucket)
        assert rows(got.select("call", "fq")) == [("p1", "inner"), ("p2", "tie")]


def test_tiers(spark):
    symbols = spark.createDataFrame(
        [("a.py", "f", "a.py::f", 1), ("a.py", "f", "a.py::C::f", 2), ("b.py", "g", "b.py::g", 3), ("c.py", "g", "c.py::g", 4), ("c.py", "h", "c.py::h", 5)],
        "file string, name string, fqname string, ord int",
    )
    imports = spark.createDataFrame([("a.py", "c.py", 0)], "file string, target string, pos int")
    calls = spark.createDataFrame(
        [("1", "a.py", "a.py::m", "f"), ("2", "a.py", "a.py::m", "g"), ("3", "b.py", "b.py::x", "h"), ("4", "a.py", "a.py::C::f", "f"), ("5", "a.py", "a.py::m", "none")],
        "call_id string, file string, caller string, name string",
    )
    assert rows(graph.resolve_calls(calls, symbols, imports)) == [
        ("1", "a.py::m", "a.py::C::f", 1.0), ("2", "a.py::m", "c.py::g", 0.7), ("3", "b.py::x", "c.py::h", 0.4), ("4", "a.py::C::f", "a.py::f", 0.4),
    ]


def test_merge_edges_and_overrides(spark):
    kind = "caller string, callee string, confidence double"
    a = spark.createDataFrame([("x", "y", 0.4), ("x", "z", 1.0)], kind)
    b = spark.createDataFrame([("x", "y", 0.95), ("x", "z", 0.95)], kind)
    assert rows(graph.merge_edges(a, b)) == [("x", "y", 0.95), ("x", "z", 1.0)]
    d = spark.createDataFrame([("api", 0, "old"), ("worker", 1, "keep")], "name string, ord int, text string")
    o = spark.createDataFrame([("api", "new"), ("extra", "add")], "name string, text string")
    assert rows(graph.merge_overrides(d, o, "name", "ord").select("name", "text")) == [("api", "new"), ("extra", "add"), ("worker", "keep")]


def test_links(spark):
    chunks = spark.createDataFrame(
        [("a", '@GetMapping("/items") @GetMapping("/more") db.carts.find()'), ("b", 'requests.get("http://a.test/items") db.carts.find() db.users.find()'), ("c", None)],
        "repo string, text string",
    )
    got = {(r["src"], r["dst"], r["via"]): (r["evidence"], r["confidence"]) for r in link.link_projects(chunks).collect()}
    assert got == {("a", "b", "http"): (["/items"], 0.5), ("a", "b", "shared_collection"): (["carts"], 0.5)}
    assert link.link_projects(chunks, 0.6).count() == 0


def test_snapshot_diff(spark):
    kind = "path string, hash string"
    prev = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3"), ("n", None)], kind)
    cur = spark.createDataFrame([("p", "1"), ("q", "X"), ("s", "4"), ("n", None)], kind)
    diff = delta.snapshot_diff(prev, cur)
    assert rows(diff) == [("q", "modified"), ("r", "deleted"), ("s", "added")]
    assert rows(delta.to_index(diff)) == [("q",), ("s",)]


def test_name_status_stream(spark):
    stream = "\0".join(["A", "new.py", "M", "mod.py", "D", "gone.py", "T", "type.py", "R100", "old.py", "moved.py", "C75", "src.py", "copy.py", ""])
    got = rows(delta.parse_name_status(spark.createDataFrame([(stream,), ("",)], "stream string")))
    assert got == sorted([("new.py", "added"), ("mod.py", "modified"), ("gone.py", "deleted"), ("type.py", "modified"), ("old.py", "deleted"), ("moved.py", "added"), ("copy.py", "added")], key=repr)


def test_upserts(spark):
    kind = "id int, v string, made int"
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], kind)
    new = spark.createDataFrame([(2, "B", 99), (3, "C", 99)], kind)
    assert rows(delta.upsert(old, new, ["id"], ("made",))) == [(1, "a", 10), (2, "B", 20), (3, "C", 99)]
    assert rows(delta.partial_update(old, new, ["id"], ["v"])) == [(1, "a", 10), (2, "B", 20)]
    assert rows(delta.prune(old, new, ["id"])) == [(2, "b", 20)]


def test_streaks_and_breaker(spark):
    e = spark.createDataFrame([(i, x) for i, x in enumerate([1, 1, 0, 1, 1, 1])], "i int, bad int").withColumn("k", F.lit("a"))
    s = delta.streaks(e, ["k"], [F.asc("i")], F.col("bad") == 1).orderBy("i").collect()
    assert [r["streak"] for r in s] == [1, 2, 0, 1, 2, 3]
    w = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 9)], "n int").select(delta.backoff_seconds(F.col("n")).alias("w")).collect()
    assert [r["w"] for r in w] == [0, 15, 30, 240, 300]
    t = delta.breaker_trips(e, ["k"], [F.asc("i")], F.col("bad") == 1, 4).orderBy("i").collect()
    assert [r["tripped"] for r in t] == [False, False, False, False, True, True]


def test_memory(spark):
    kind = "id string, repo string, label string, title string, status string, created_at int"
    m = spark.createDataFrame([("d1", "r", "Decision", "one", "active", 1), ("d2", "r", "Decision", "two", "active", 2), ("o1", "r", "Observation", "three", None, None)], kind)
    new = spark.createDataFrame([("d3", "r", "Decision", "new", "active", 3, "d1"), ("d2", "r", "Decision", "TWO", "active", 9, None)], kind + ", supersedes string")
    out = memory.remember(m, new)
    got = {r["id"]: (r["title"], r["status"], r["created_at"]) for r in out.collect()}
    assert got["d1"][1] == "superseded" and got["d2"] == ("TWO", "active", 2) and len(got) == 4
    assert [r["id"] for r in memory.list_memory(out, "r").collect()] == ["d3", "d2", "d1", "o1"]
    assert memory.forget(out, "d1", "r", "Decision").count() == 3
    with pytest.raises(ValueError):
        memory.forget(out, "d1", "r", "Else")
    refs = spark.createDataFrame([("d2", [" src/a.py ", "src/a.py::f", "", "gone.py"])], "id string, refs array<string>")
    files, symbols = spark.createDataFrame([("src/a.py",)], "path string"), spark.createDataFrame([("src/a.py::f",)], "fqname string")
    links = memory.mentions(refs, files, symbols)
    assert rows(links) == [("d2", "file", "src/a.py"), ("d2", "symbol", "src/a.py::f")]
    target = spark.createDataFrame([("other.py",)], "target string")
    assert [r["node"] for r in memory.decisions_for(out, links, target).collect()] == ["d3", "d1"]
    target = spark.createDataFrame([("src/a.py",)], "target string")
    assert [r["node"] for r in memory.decisions_for(out, links, target).collect()] == ["d3", "d2", "d1"]


def test_metrics(spark):
    ranks = spark.createDataFrame([(1,), (3,), (-1,)], "rank int")
    m = evaluate.metrics(ranks).first()
    assert (m["recall_1"], m["recall_5"], m["mrr"]) == (pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), pytest.approx(4 / 9, abs=1e-6))
    assert evaluate.metrics(ranks.where("false")).first()["mrr"] == 0.0
    probes = spark.createDataFrame([("q",), ("z",)], "probe string")
    results = spark.createDataFrame([("q", "x.py::A", 1), ("q", "y.py::B::run", 2)], "probe string, doc string, rank int")
    expected = spark.createDataFrame([("q", "other.py::run")], "probe string, doc string")
    assert rows(evaluate.first_hits(probes, results, expected)) == [("q", -1), ("z", -1)]
    assert rows(evaluate.first_hits(probes, results, expected, symbols=True)) == [("q", 2), ("z", -1)]


def test_bundle(spark):
    files = spark.createDataFrame([("src/UserController.java", "java", "users controller endpoint"), ("src/other.py", "python", "payments"), ("src/near.py", "python", "nothing")], "path string, lang string, text string")
    symbols = spark.createDataFrame([("src/UserController.java::UserController", "src/UserController.java", "class UserController")], "fqname string, file_path string, signature string")
    calls = spark.createDataFrame([("x::y", "src/UserController.java::UserController")], "caller string, callee string")
    imports = spark.createDataFrame([("src/UserController.java", "src/near.py")], "src string, dst string")
    g = bundle.Graph(files=files, symbols=symbols, calls=calls, imports=imports, runbook="run it")
    b = bundle.query(g, "users controller")
    assert [f["path"] for f in b.files] == ["src/UserController.java", "src/near.py"] and b.callers == ["x::y"] and not b.errors
    text = b.render()
    assert text.index("## Runbook") < text.index("## Files") < text.index("## Symbols")
    assert bundle.query(g, "users controller", token_budget=1).callers == []
    broken = bundle.query(bundle.Graph(files=files.drop("text")), "users controller")
    assert broken.errors and broken.render()
    ranked = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "cccc")], "rank int, text string")
    assert bundle.pack_to_budget(ranked, "text", "rank", 2).count() == 2
