"""A question to a context bundle: ground, hydrate, fit to a budget and render."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import memory as M
from . import search

CHARS_PER_TOKEN = 4


@dataclass
class Graph:
    """Tables of a project's graph; those that are None are left out of answers."""

    files: DataFrame
    chunks: DataFrame | None = None
    symbols: DataFrame | None = None
    calls: DataFrame | None = None
    imports: DataFrame | None = None
    services: DataFrame | None = None
    service_files: DataFrame | None = None
    memory: DataFrame | None = None
    mentions: DataFrame | None = None
    links: DataFrame | None = None
    runbook: str = ""


def graph_of(store, repo: str) -> Graph:
    """The tables of one project of a :class:`~millrace.sources.store.Store`."""

    def of(name: str) -> DataFrame:
        return store.read(name).where(F.col("repo") == repo)

    about = store.read("repo").where(F.col("name") == repo).select("runbook_md").first()
    imports = of("import_edge").select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"))
    return Graph(
        of("file"), of("chunk"), of("symbol"), of("call_edge"), imports, of("service"), of("service_file"), of("memory"), of("mentions"),
        store.read("repo_edge"), (about and about["runbook_md"]) or "",
    )


@dataclass
class Bundle:
    query: str
    intent: str = ""
    fastpath: tuple[str, str] | None = None
    services: list[dict] = field(default_factory=list)
    files: list[dict] = field(default_factory=list)
    symbols: list[dict] = field(default_factory=list)
    callers: list[str] = field(default_factory=list)
    callees: list[str] = field(default_factory=list)
    runbook: str = ""
    decisions: list[dict] = field(default_factory=list)
    observations: list[dict] = field(default_factory=list)
    related: list[dict] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def render(self) -> str:
        """Markdown in a fixed order of sections; empty ones are left out and lists are capped."""
        parts = [f"# Context for: {self.query}"]

        def section(title: str, rows: list[str]) -> None:
            if rows:
                parts.append("\n".join([f"## {title}", *rows]))

        section("Intent", [self.intent] if self.intent else [])
        section("Fast path", [f"{self.fastpath[0]}: {self.fastpath[1]}"] if self.fastpath else [])
        section("Services", [f"- **{s['name']}** {s.get('description') or ''}".rstrip() for s in self.services[:3]])
        section("Runbook", [self.runbook[:2000]] if self.runbook else [])
        section("Files", [f"- `{f['path']}` {f.get('summary') or ''}".rstrip() for f in self.files[:8]])
        section("Symbols", [f"- `{s['fqname']}` {s.get('signature') or ''}".rstrip() for s in self.symbols[:12]])
        section("Call neighbours", [*(f"- called by `{c}`" for c in self.callers[:6]), *(f"- calls `{c}`" for c in self.callees[:6])])
        section("Decisions", [f"- {d.get('title') or ''}: {(d.get('rationale') or '')[:200]}" for d in self.decisions[:5]])
        section("Observations", [f"- {(o.get('text') or '')[:240]}" for o in self.observations[:5]])
        section("Related projects", [f"- {r['src']} → {r['dst']} ({r['via']}): {', '.join(r['evidence'][:3])}" for r in self.related[:5]])
        section("Sources", [", ".join(self.sources)] if self.sources else [])
        section("Errors", [f"- {e}" for e in self.errors])
        return "\n\n".join(parts) + "\n"

    def fit(self, token_budget: int) -> Bundle:
        """Over the budget call neighbours go, then symbols after the sixth and files after the fourth."""
        if len(self.render()) > token_budget * CHARS_PER_TOKEN:
            self.callers, self.callees = [], []
        if len(self.render()) > token_budget * CHARS_PER_TOKEN:
            self.symbols, self.files = self.symbols[:6], self.files[:4]
        return self


def _terms(graph: Graph, text: str) -> list[str]:
    expanded = graph.files.sparkSession.range(1).select(T.expand_query(F.lit(text))).first()[0]
    return [t.lower() for t in search.query_terms(expanded)]


def file_scores(graph: Graph, query_vec: Column, k: int = 60) -> DataFrame:
    """``(file_path, score)``: files of the ``k`` most similar chunks with their best cosine."""
    hits = search.vector_topk(graph.chunks, query_vec, k, id="id", vector="embed_vec").select("file_path", "score")
    return hits.groupBy("file_path").agg(F.max("score").alias("score"))


def _by_text(graph: Graph, terms: list[str], k: int, named: DataFrame | None) -> DataFrame:
    """``(path, score)`` by full text: of the files' own text, else of the symbols found, else of the chunks."""
    if "text" in graph.files.columns:
        return search.bm25(graph.files, terms, k, id="path", text="text")
    if named is not None:
        return named.groupBy(F.col("file_path").alias("path")).agg(F.max("score").alias("score"))
    if graph.chunks is None:
        raise ValueError("a full-text ranking needs texts of files, symbols or chunks")
    return search.bm25(graph.chunks, terms, k, id="file_path", text="text").groupBy(F.col("file_path").alias("path")).agg(F.max("score").alias("score"))


def candidates(graph: Graph, text: str, query_vec: Column | None, k: int = 60, cap: int = search.CANDIDATES, scorer=None, named: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """``(doc, rank)`` of files: vector and full-text rankings fused with a path prior, the head reranked by ``scorer``
    if there is one, then expanded by one hop.

    ``named`` are symbols found by full text and ``near`` files by vector, where the caller has them already.
    """
    if named is None and graph.symbols is not None and "text" not in graph.files.columns:
        named = search.fulltext_symbols(graph.symbols, _terms(graph, text), k)
    lists = search.ranked(_by_text(graph, _terms(graph, text), k, named), "path", 2)
    if near is None and graph.chunks is not None and query_vec is not None:
        near = file_scores(graph, query_vec, k)
    if near is not None:
        lists = search.ranked(near, "file_path", 1).unionByName(lists)
    prior = lists.select("doc").distinct().withColumn("bonus", T.path_prior(F.lit(text), F.col("doc")))
    fused = search.rerank(search.rrf_fuse(lists, prior), scorer)
    if graph.imports is None:
        return fused.where(F.col("rank") <= cap).select("doc", "rank")
    seeds = fused.where(F.col("rank") <= search.EXPAND_FROM).select(F.col("doc").alias("id"))
    hop = search.one_hop(graph.imports, seeds)
    hop = hop.select(F.col("id").alias("doc"), F.row_number().over(Window.orderBy("id")).alias("rank"))
    return search.append_unseen(fused.select("doc", "rank"), hop, cap)


def query(graph: Graph, text: str, query_vec: Column | None = None, repo: str | None = None, token_budget: int = 4000, grounder=None, scorer=None) -> Bundle:
    """The bundle of a question. Every step that fails is noted in ``errors`` and the others go on.

    ``grounder(text, files, symbols)`` may pick an intent, services, files and symbols; without it the first five
    candidates of each are taken. ``scorer(doc)`` reranks the head of the candidates. Files carry the cosine of their
    best chunk and symbols the reciprocal of their place as ``score``. Services are those that the grounder names, then
    those that hold a file of the answer, and only where the project tells no files of services the first ones by name.
    Only short lists and the rows of the bundle reach the driver.
    """
    out = Bundle(text)
    spark = graph.files.sparkSession

    def step(name: str, run) -> None:
        try:
            run()
            out.sources.append(name)
        except Exception as e:
            out.errors.append(f"{name}: {type(e).__name__}: {str(e)[:200]}")

    def rows(df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def fast() -> None:
        hit = spark.range(1).select(T.fastpath(F.lit(text)).alias("f")).first()["f"]
        out.fastpath = (hit["kind"], hit["value"]) if hit else None

    picked: dict = {}

    def ground() -> None:
        named = near = None
        if graph.symbols is not None:
            named = search.short(search.fulltext_symbols(graph.symbols, _terms(graph, text), 60))
        if graph.chunks is not None and query_vec is not None:
            near = search.short(file_scores(graph, query_vec))
        ranking = candidates(graph, text, query_vec, scorer=scorer, named=named, near=near)
        found = [r["doc"] for r in ranking.orderBy("rank").limit(search.CANDIDATES).collect()]
        names = []
        if graph.symbols is not None:
            at = F.array_position(F.array(*map(F.lit, found[:20])), F.col("file_path")) if found else F.lit(0)
            inside = graph.symbols.where(F.col("file_path").isin(found[:20])).orderBy(at, "fqname").limit(60)
            names = [r["fqname"] for r in inside.select("fqname").collect()]
            names += [r["fqname"] for r in named.orderBy("rank").collect() if r["fqname"] not in set(names)]
        picked.update(grounder(text, found, names) if grounder else {})
        out.intent = picked.get("intent", "")
        files = [f for f in picked.get("files", []) if f in set(found)] or found[:5]
        symbols = [s for s in picked.get("symbols", []) if s in set(names)] or names[:5]
        if out.fastpath and out.fastpath[0] == "file":
            files = [out.fastpath[1], *(f for f in files if f != out.fastpath[1])]
        order = {f: i for i, f in enumerate(files)}
        have = [c for c in ("path", "lang", "summary") if c in graph.files.columns]
        cosine = {r["file_path"]: r["score"] for r in near.collect()} if near is not None else {}
        out.files = sorted(rows(graph.files.where(F.col("path").isin(files)).select(*have)), key=lambda r: order[r["path"]])
        for f in out.files:
            f["score"] = round(cosine.get(f["path"], 0.0), 4)
        if graph.symbols is not None:
            wanted = F.col("fqname").isin(symbols)
            if out.fastpath and out.fastpath[0] == "symbol":
                wanted = wanted | (T.terminal_name(F.col("fqname")) == out.fastpath[1].rsplit(".", 1)[-1])
            order = {s: i for i, s in enumerate(symbols)}
            place = {s: 1 / (i + 1) for i, s in enumerate(names)}
            have = [c for c in ("fqname", "file_path", "signature", "summary") if c in graph.symbols.columns]
            out.symbols = sorted(rows(graph.symbols.where(wanted).select(*have).orderBy("fqname").limit(60)), key=lambda r: (order.get(r["fqname"], len(order)), r["fqname"]))
            for s in out.symbols:
                s["score"] = round(place.get(s["fqname"], 0.0), 4)

    def neighbours() -> None:
        if graph.calls is not None and out.symbols:
            name = out.symbols[0]["fqname"]
            out.callers = [r[0] for r in graph.calls.where(F.col("callee") == name).select("caller").distinct().orderBy("caller").limit(8).collect()]
            out.callees = [r[0] for r in graph.calls.where(F.col("caller") == name).select("callee").distinct().orderBy("callee").limit(8).collect()]

    def remembered() -> None:
        if graph.memory is None or graph.mentions is None:
            return
        targets = [f["path"] for f in out.files] + [s["fqname"] for s in out.symbols]
        wanted = spark.createDataFrame([(t,) for t in targets], "target string")
        mine = graph.memory if repo is None else graph.memory.where(F.col("repo") == repo)
        out.decisions = rows(M.decisions_for(mine, graph.mentions, wanted))
        out.observations = rows(M.observations_for(mine, graph.mentions, wanted))

    def related() -> None:
        from . import link

        if graph.links is not None and repo is not None:
            out.related = rows(link.edges_of(graph.links, repo, 8))

    def services() -> None:
        out.runbook = graph.runbook
        if graph.services is None:
            return
        named = picked.get("services", [])
        rank = F.when(F.col("name").isin(named), 0)
        if graph.service_files is not None and not graph.service_files.isEmpty():
            held = graph.service_files.where(F.col("path").isin([f["path"] for f in out.files]))
            rank = rank.when(F.col("name").isin([r[0] for r in held.select("service").distinct().orderBy("service").limit(100).collect()]), 1)
        else:
            rank = rank.otherwise(1)
        out.services = rows(graph.services.where(rank.isNotNull()).orderBy(rank, "name").limit(3))

    for name, run in (("fastpath", fast), ("candidates", ground), ("calls", neighbours), ("services", services), ("memory", remembered), ("links", related)):
        step(name, run)
    return out.fit(token_budget)


def pack_to_budget(ranked: DataFrame, text: str, rank: str, budget: int, by: list[str] | None = None) -> DataFrame:
    """Rows of a ranked list as long as their running length stays within ``budget`` tokens."""
    w = Window.partitionBy(*(by or [])).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= budget * CHARS_PER_TOKEN)


def context_for(store, repo: str, text: str, query_vec: Column | None = None, token_budget: int = 4000, **how) -> str:
    """The rendered bundle of a question to a project of a store, or an empty text where none can be made."""
    made = context_object(store, repo, text, query_vec, token_budget, **how)
    return made.render() if made else ""


def context_object(store, repo: str, text: str, query_vec: Column | None = None, token_budget: int = 4000, **how) -> Bundle | None:
    """The same as an object, or None: an unknown project, an empty question or a store that can't be read."""
    try:
        graph = graph_of(store, repo)
        if not text.strip() or graph.files.isEmpty():
            return None
        return query(graph, text, query_vec, repo, token_budget, **how)
    except Exception:  # callers put the text before a prompt and go on without it
        return None
