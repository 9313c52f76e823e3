import textwrap

import pytest
from pyspark.sql import functions as F

from millrace.operators import delta
from millrace.sources import config, files, parsers, providers
from millrace.sources.store import Store
from millrace.streaming import ingest

TREE = {
    "app/core.py": """
        import app.util
        from app.util import clean

        class Shop:
            def sell(self, item: str) -> bool:
                return clean(item)

            def _hidden(self):
                pass

        def main():
            Shop().sell("x")
        """,
    "app/util.py": """
        def clean(value):
            return value.strip()
        """,
    "svc/Stock.java": """
        package svc;
        import java.util.List;
        @Deprecated
        public class Stock {
            private final int size = 3;
            public Stock(int n) { grow(n); }
            protected List<String> grow(int n) throws Exception {
                // grow(1) is no call
                return shrink("grow(2)", n);
            }
            List<String> shrink(String a, int b) { return null; }
        }
        """,
    "web/app.ts": """
        import { tidy } from './tidy';
        export class Box {
          count: number = 0;
          add(n: number): number { return tidy(n); }
        }
        export function start(): void { const b = new Box(); b.add(1); }
        export const stop = () => start();
        """,
    "web/tidy.ts": """
        export function tidy(n: number): number { return n; }
        """,
    "node_modules/skip.js": "function no() {}",
    "notes.bin": "zz",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in TREE.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(textwrap.dedent(text).lstrip("\n"))
    return tmp_path / "tree"


def test_walk_and_pack(spark, tree):
    f = files.walk(spark, str(tree), "r")
    assert {r["path"]: r["lang"] for r in f.collect()} == {"app/core.py": "python", "app/util.py": "python", "svc/Stock.java": "java", "web/app.ts": "typescript", "web/tidy.ts": "typescript"}
    ignored = spark.createDataFrame([("web/tidy.ts",)], "path string")
    assert files.walk(spark, str(tree), "r", ignored).count() == 4
    assert files.pack(f).first()["sha"] == files.pack(f.orderBy(F.desc("path"))).first()["sha"]


def test_parsers():
    text = {n: textwrap.dedent(t).lstrip("\n") for n, t in TREE.items()}
    py = parsers.parse_source("app/core.py", text["app/core.py"], "python")
    assert [(s["fqname"], s["kind"], s["visibility"]) for s in py.symbols] == [
        ("app/core.py::Shop", "class", "public"), ("app/core.py::Shop::sell", "method", "public"), ("app/core.py::Shop::_hidden", "method", "protected"), ("app/core.py::main", "function", "public"),
    ]
    assert py.imports == ["app.util"] and {c["name"] for c in py.calls} == {"clean", "Shop", "sell"}
    java = parsers.parse_source("svc/Stock.java", text["svc/Stock.java"], "java")
    assert [(s["fqname"].split("::", 1)[1], s["kind"], s["visibility"]) for s in java.symbols] == [
        ("Stock", "class", "public"), ("Stock::Stock", "method", "public"), ("Stock::grow", "method", "protected"), ("Stock::shrink", "method", ""), ("Stock::size", "field", "private"),
    ]
    assert java.symbols[0]["deprecated"] and java.symbols[2]["return_type"] == "List<String>" and java.symbols[2]["params_json"] == '[{"name":"n","type":"int"}]'
    assert [c["name"] for c in java.calls] == ["grow", "shrink"]
    ts = parsers.parse_source("web/app.ts", text["web/app.ts"], "typescript")
    assert [(s["fqname"].split("::", 1)[1], s["kind"]) for s in ts.symbols] == [("Box", "class"), ("Box::add", "method"), ("start", "function"), ("stop", "function")]
    assert ts.imports == ["./tidy"] and [c["name"] for c in ts.calls] == ["tidy", "add", "start"]
    assert parsers.parse_source("x.py", "def (", "python").error and not parsers.parse_source("x.go", "func", "go").symbols


def test_ingest_and_delta(spark, tree, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first = ingest.ingest(store, "r", str(tree))
    assert first["changed"] and first["changes"] == {"added": 5}
    edges = {(r["caller"], r["callee"]): r["confidence"] for r in store.read("call_edge").collect()}
    assert edges[("app/core.py::Shop::sell", "app/util.py::clean")] == 0.7
    assert edges[("app/core.py::main", "app/core.py::Shop::sell")] == 1.0
    assert edges[("web/app.ts::Box::add", "web/tidy.ts::tidy")] == 0.7
    assert {(r["from_path"], r["to_path"]) for r in store.read("import_edge").collect()} == {("app/core.py", "app/util.py"), ("web/app.ts", "web/tidy.ts")}
    assert all(len(r["embed_vec"]) == 64 for r in store.read("chunk").collect())
    assert ingest.ingest(store, "r", str(tree)) == {"changed": False}
    store.upsert("symbol", store.read("symbol").withColumn("summary", F.lit("said")))
    (tree / "web/tidy.ts").unlink()
    (tree / "app/util.py").write_text("def clean(value):\n    return value\n\ndef more():\n    return clean(1)\n")
    second = ingest.ingest(store, "r", str(tree))
    assert second["changes"] == {"modified": 1, "deleted": 1}
    symbols = {r["fqname"]: r["summary"] for r in store.read("symbol").collect()}
    assert "web/tidy.ts::tidy" not in symbols and symbols["app/util.py::clean"] == "said" and symbols["app/util.py::more"] is None
    edges = {(r["caller"], r["callee"]) for r in store.read("call_edge").collect()}
    assert ("app/core.py::Shop::sell", "app/util.py::clean") in edges and ("app/util.py::more", "app/util.py::clean") in edges
    assert not any(b.startswith("web/tidy") for _, b in edges)
    counts = store.purge("r")
    assert counts["file"] == 4 and store.read("file").count() == 0


def test_stream_upserts(spark, tmp_path):
    store, src = Store(spark, f"file://{tmp_path}/store"), str(tmp_path / "in")
    kind = "repo string, head_sha string, branch string, last_seen timestamp"
    make = lambda rows: spark.createDataFrame(rows, "repo string, head_sha string, branch string, s int").withColumn("last_seen", F.timestamp_seconds("s")).drop("s")
    make([("a", "1", "main", 1), ("a", "2", "main", 2), ("b", "1", "dev", 1)]).write.mode("append").parquet(src)
    for _ in range(2):
        q = ingest.stream_upserts(spark.readStream.schema(kind).parquet(src), store, "git_state", str(tmp_path / "cp"), ["repo"], "last_seen")
        q.awaitTermination()
        got = {r["repo"]: r["head_sha"] for r in store.read("git_state").collect()}
        make([("b", "9", "dev", 9)]).write.mode("append").parquet(src)
    assert got == {"a": "2", "b": "9"}
    journal = ingest.on_schedule(spark, {"ok": dict, "bad": lambda: 1 / 0})
    assert {r["repo"]: r["ok"] for r in journal.collect()} == {"ok": True, "bad": False}


def test_edges_of_other_projects_and_of_symbols_that_vanish(spark, tmp_path):
    """Two projects with the same paths; then a symbol goes from a file that another one calls."""
    store = Store(spark, f"file://{tmp_path}/store")
    for name in ("one", "two"):
        root = tmp_path / name
        root.mkdir()
        (root / "util.py").write_text("def clean(v):\n    return v\n\ndef other(v):\n    return v\n")
        (root / "core.py").write_text("from util import clean\n\ndef main():\n    clean(1)\n")
        ingest.ingest(store, name, str(root))
    edges = lambda: {(r["repo"], r["caller"], r["callee"]) for r in store.read("call_edge").collect()}
    assert edges() == {(x, "core.py::main", "util.py::clean") for x in ("one", "two")}
    (tmp_path / "two" / "util.py").write_text("def other(v):\n    return v + 1\n")
    ingest.ingest(store, "two", str(tmp_path / "two"))
    assert edges() == {("one", "core.py::main", "util.py::clean")}


def test_a_late_row_changes_nothing(spark, tmp_path):
    store, src = Store(spark, f"file://{tmp_path}/store"), str(tmp_path / "in")
    kind = "repo string, head_sha string, branch string, last_seen timestamp"
    for sha, at in (("new", 9), ("late", 1), ("newer", 10)):
        rows = spark.createDataFrame([("a", sha, "main", at)], "repo string, head_sha string, branch string, s int")
        rows.withColumn("last_seen", F.timestamp_seconds("s")).drop("s").write.mode("append").parquet(src)
        ingest.stream_upserts(spark.readStream.schema(kind).parquet(src), store, "git_state", str(tmp_path / "cp"), ["repo"], "last_seen").awaitTermination()
        assert store.read("git_state").first()["head_sha"] == ("newer" if at == 10 else "new")


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("project:\n  name: here\n  chunk_size: '70'\n  interval_s: nope\n")
    c = config.ProjectConfig.load(str(f), env={"MILLRACE_CHUNK_OVERLAP": "5", "MILLRACE_CHUNK_SIZE": "9"})
    assert (c.name, c.chunk_size, c.chunk_overlap, c.interval_s) == ("here", 70, 5, 600)
    assert config.ProjectConfig.load(str(f), name="given", env={}).name == "given"
    f.write_text(": : broken [")
    assert config.ProjectConfig.load(str(f), env={}).chunk_size == 50


def test_providers(spark):
    d = spark.createDataFrame([("one two",), (None,)], "t string")
    v = [r["v"] for r in providers.embed(d, "t", "v").collect()]
    assert len(v[0]) == 64 and sum(x * x for x in v[0]) == pytest.approx(1, abs=1e-5) and not any(v[1])
    s = [r["s"] for r in providers.summarize(d.where("t is not null"), "t", "s", lambda t: 1 / 0).collect()]
    assert s == [None]


def test_sources_helpers(spark):
    f = spark.createDataFrame([("a/b/x.py",), ("a/y.py",)], "path string")
    g = spark.createDataFrame([("s", "a/*.py"), ("t", "**/x.py")], "service string, glob string")
    assert sorted(map(tuple, files.expand_globs(g, f).collect())) == [("s", "a/y.py"), ("t", "a/b/x.py")]
    d = spark.createDataFrame([("s", "./a//y.py"), ("s", "../y.py"), ("s", "/a/y.py"), ("s", "no.py")], "service string, path string")
    assert [tuple(r) for r in files.valid_paths(d, f).collect()] == [("s", "a/y.py")]
    w = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, at int, v string")
    assert [tuple(r) for r in delta.last_write(w, ["k"], [F.col("at")]).collect()] == [("k", 2, "new")]


def test_question_from_the_store(spark, tree, tmp_path):
    from millrace.operators import bundle, search

    store = Store(spark, f"file://{tmp_path}/asked")
    ingest.ingest(store, "r", str(tree))
    other = tmp_path / "other"
    other.mkdir()
    (other / "stock.py").write_text("def shrink(n):\n    return n\n")
    ingest.ingest(store, "q", str(other))
    store.write("service", spark.createDataFrame([("r", "core"), ("r", "aaa"), ("q", "other")], "repo string, name string"))
    store.write("service_file", spark.createDataFrame([("r", "core", "svc/Stock.java"), ("r", "aaa", "none.py")], "repo string, service string, path string"))
    vec = store.read("chunk").where("repo = 'r' and file_path = 'svc/Stock.java'").select("embed_vec").first()[0]
    vec = F.array(*map(F.lit, vec))
    b = bundle.query(bundle.graph_of(store, "r"), "where does stock shrink", vec, "r")
    assert not b.errors, b.errors
    assert b.files[0]["path"] == "svc/Stock.java" and b.files[0]["score"] == 1.0
    assert "stock.py" not in [f["path"] for f in b.files]
    assert "svc/Stock.java::Stock::shrink" in [s["fqname"] for s in b.symbols] and b.symbols[0]["score"] == 1.0
    assert [s["name"] for s in b.services] == ["core"]
    found = search.fulltext_symbols(store.read("symbol").where("repo = 'r'"), ["shrink"], 5).collect()
    assert "svc/Stock.java::Stock::shrink" in [r["fqname"] for r in found]
    assert bundle.context_for(store, "r", "where does stock shrink", vec).startswith("# Context for")
    assert bundle.context_for(store, "gone", "stock") == "" and bundle.context_object(store, "r", " ") is None
    turned = bundle.query(bundle.graph_of(store, "r"), "where does stock shrink", vec, "r", scorer=lambda doc: F.when(doc == "web/tidy.ts", 1.0).otherwise(0.0))
    assert turned.files[0]["path"] == "web/tidy.ts" and turned.files[1]["path"] == "svc/Stock.java"
