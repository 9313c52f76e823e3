"""Queries of text functions, chunkers and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as T
from ..operators import chunk, link
from ..sources import files as files_source
from .common import Query, table

QUERIES: dict[str, Query] = {}
_LINES = r"string_split(regexp_replace(text, '\n$', ''), chr(10))"


def tokens(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.posexplode(T.search_tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("pos", "token")).select("p_partkey", "token")


QUERIES["tokens"] = (
    tokens,
    """WITH t AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS token, generate_subscripts(string_split(p_name || ' ' || p_type, ' '), 1) AS i FROM part)
    SELECT p_partkey, token FROM t WHERE length(token) >= 3 QUALIFY row_number() OVER (PARTITION BY p_partkey, lower(token) ORDER BY i) = 1""",
)


def camel_split(spark, sf):
    p = table(spark, sf, "part").withColumn("name", F.concat(F.lit("XML"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("Id")))
    return p.select("p_partkey", F.array_join(T.camel_split(F.col("name")), " ").alias("pieces"))


QUERIES["camel_split"] = (
    camel_split,
    r"""SELECT p_partkey, regexp_replace(regexp_replace('XML' || list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') || 'Id',
      '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g') AS pieces FROM part""",
)


def expand_query(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.expand_query(F.concat(F.lit("create "), F.col("p_name"), F.lit(" endpoint"))).alias("query"))


QUERIES["expand_query"] = (expand_query, "SELECT p_partkey, 'create ' || p_name || ' endpoint  save insert post controller api route' AS query FROM part")


def fastpath_detect(spark, sf):
    p = table(spark, sf, "part")
    text = F.expr("CASE WHEN p_size < 15 THEN 'see ABC-' || p_size || ' in src/app.py now' WHEN p_size < 30 THEN 'open src/' || p_size || '/Main.java please' WHEN p_size < 45 THEN 'call PaymentService.process on ' || p_name ELSE p_name END")
    hit = T.fastpath(text)
    return p.select("p_partkey", hit["kind"].alias("kind"), hit["value"].alias("value"))


QUERIES["fastpath_detect"] = (
    fastpath_detect,
    """SELECT p_partkey, CASE WHEN p_size < 15 THEN 'ticket' WHEN p_size < 30 THEN 'file' WHEN p_size < 45 THEN 'symbol' END AS kind,
      CASE WHEN p_size < 15 THEN 'ABC-' || p_size WHEN p_size < 30 THEN 'src/' || p_size || '/Main.java' WHEN p_size < 45 THEN 'PaymentService.process' END AS value FROM part""",
)


def escape_query(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.escape_query(F.col("url")).alias("escaped"))


QUERIES["escape_query"] = (escape_query, r"""SELECT page_id, regexp_replace(url, '([-+!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS escaped FROM pages""")


def names(spark, sf):
    c = table(spark, sf, "customer")
    fq = F.concat_ws("::", "c_mktsegment", "c_name")
    dunder = F.when(F.col("c_nationkey") < 5, F.concat(F.lit("__"), "c_name")).when(F.col("c_nationkey") < 10, F.concat(F.lit("_"), "c_name")).when(F.col("c_nationkey") < 15, F.lit("__init__")).otherwise(F.col("c_name"))
    return c.select("c_custkey", T.terminal_name(fq).alias("terminal"), T.safe_name(F.col("c_name")).alias("safe"), T.python_visibility(dunder).alias("visibility"), F.array_join(T.split_csv(F.concat(F.lit(" a, ,"), "c_mktsegment", F.lit(" ,"))), "|").alias("csv"))


QUERIES["names"] = (
    names,
    """SELECT c_custkey, c_name AS terminal, replace(c_name, '#', '_') AS safe, CASE WHEN c_nationkey < 5 THEN 'private' WHEN c_nationkey < 15 THEN 'protected' ELSE 'public' END AS visibility,
      'a|' || c_mktsegment AS csv FROM customer""",
)


def languages(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat(F.col("source"), F.lit("/A"), F.col("doc_id"), F.lit("."), F.when(F.col("lang") == "en", "py").when(F.col("lang") == "fr", "Java").when(F.col("lang") == "de", "md").otherwise("bin"))
    return d.select("doc_id", T.language(path).alias("language"), T.is_doc(path).alias("is_doc"))


QUERIES["languages"] = (
    languages,
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'java' WHEN 'de' THEN 'markdown' ELSE 'other' END AS language, lang = 'de' AS is_doc FROM documents",
)


def content_digest(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("hash"), T.line_count(F.col("text")).cast("long").alias("lines"), T.token_count(F.col("text")).cast("long").alias("tokens"))


QUERIES["content_digest"] = (
    content_digest,
    "SELECT doc_id, sha256(text) AS hash, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, (length(text) // 4)::BIGINT AS tokens FROM documents",
)


def project_digest(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("repo"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.sha2("text", 256).alias("hash"))
    return files_source.digest(d)


QUERIES["project_digest"] = (
    project_digest,
    "SELECT source AS repo, sha256(string_agg(lpad(doc_id::VARCHAR, 12, '0') || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS sha FROM documents GROUP BY 1",
)


def chunk_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    c = chunk.chunk_lines(d)
    return c.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), F.sha2("chunk", 256).alias("sha"))


QUERIES["chunk_lines"] = (
    chunk_lines,
    f"""WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text <> ''),
      w AS (SELECT doc_id, ls, unnest(range(0, greatest(0, ceil((len(ls) - 50) / 40.0))::BIGINT + 1)) AS idx FROM l)
    SELECT doc_id, idx, idx * 40 + 1 AS line_start, least(idx * 40 + 50, len(ls)) AS line_end, sha256(array_to_string(ls[idx * 40 + 1 : idx * 40 + 50], chr(10))) AS sha FROM w""",
)


def chunk_ids(spark, sf):
    c = chunk.chunk_lines(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return c.select("doc_id", F.col("idx").cast("long").alias("idx"), T.chunk_id(F.col("source"), F.concat(F.lit("doc"), "doc_id"), F.col("idx")).alias("id"))


QUERIES["chunk_ids"] = (
    chunk_ids,
    f"""WITH w AS (SELECT doc_id, source, unnest(range(0, greatest(0, ceil((len({_LINES}) - 50) / 40.0))::BIGINT + 1)) AS idx FROM documents WHERE text <> '')
    SELECT doc_id, idx, substr(sha256(source || '::doc' || doc_id || '::' || idx), 1, 32) AS id FROM w""",
)


def doc_sections(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\nTh", "\n# Th").alias("text"))
    s = chunk.doc_sections(d, ["doc_id"])
    return s.select("doc_id", F.col("section").cast("long").alias("section"), F.length("heading").cast("long").alias("heading_len"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


QUERIES["doc_sections"] = (
    doc_sections,
    r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(10) || 'Th', chr(10) || '# Th'), '\n$', ''), chr(10)) AS ls FROM documents WHERE text <> ''),
      u AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
      h AS (SELECT * FROM u WHERE ltrim(line, ' ') LIKE '#%' AND ltrim(line, ' ') NOT LIKE '#!%')
    SELECT doc_id, row_number() OVER w - 1 AS section, length(trim(line, ' ')) AS heading_len, i AS line_start, coalesce(lead(i) OVER w - 1, n) AS line_end FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)
    UNION ALL SELECT doc_id, 0, 0, 1, len(ls) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM h)""",
)


def evidence_extract(spark, sf):
    p = table(spark, sf, "pages")
    path = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)), E.normal_path)
    return p.select("page_id", F.explode(F.array_distinct(F.filter(path, lambda x: x.isNotNull()))).alias("path")).unionByName(p.select("page_id", E.normal_path(F.col("url")).alias("path")))


QUERIES["evidence_extract"] = (
    evidence_extract,
    """WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS raw FROM pages),
      p AS (SELECT DISTINCT page_id, CASE WHEN trim(raw) LIKE '/%' THEN trim(raw) ELSE '/' || trim(raw) END AS path FROM r)
    SELECT page_id, path FROM p WHERE length(path) BETWEEN 2 AND 199
    UNION ALL SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) FROM pages""",
)


_SNIPPET = """CASE p_partkey % 14
    WHEN 0 THEN concat('@RequestMapping(value = "/parts/', k, '")') WHEN 1 THEN concat('@GetMapping("/brands/', k, '")')
    WHEN 2 THEN concat('@app.post( "/sizes/', k, '")') WHEN 3 THEN concat('@router.delete("', k, '/gone")')
    WHEN 4 THEN concat('restTemplate.exchange(base, "/parts/', k, '")') WHEN 5 THEN concat('requests.get("https://host.example/brands/', k, '?page=1")')
    WHEN 6 THEN concat('await fetch("/sizes/', k, '")') WHEN 7 THEN concat('bus.publish("part.', k, '.made")') WHEN 8 THEN concat('SUBJECT = "part.', k, '"')
    WHEN 9 THEN concat('bus.pullSubscribe("part.', k, '.made")') WHEN 10 THEN concat('@JetStreamListener(durable = "d", subject = "part.', k, '")')
    WHEN 11 THEN concat('@Document(collection = "parts_', k, '")') WHEN 12 THEN concat('getCollection("parts_', k, '")') ELSE concat('db.parts_', k, '.find({})') END"""
_CODE = f"SELECT p_brand AS repo, {_SNIPPET} AS text FROM (SELECT p_partkey, p_brand, CAST(p_partkey % 97 AS VARCHAR(9)) AS k FROM part)"


def evidence_patterns(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part_of_evidence")
    return link.scan(spark.sql(_CODE.replace("FROM part)", "FROM part_of_evidence)")))


def _evidence_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(f"SELECT repo, '{channel}' AS channel, trim(unnest(regexp_extract_all(text, {quoted(p)}, 1))) AS raw FROM code" for channel, patterns in E.PATTERNS.items() for p in patterns)
    return f"""WITH code AS ({_CODE}), found AS ({found}),
      bare AS (SELECT *, regexp_extract(raw, '^https?://[^/?#]*([^?#]*)', 1) AS inner_path FROM found),
      plain AS (SELECT *, CASE WHEN regexp_matches(raw, '^https?://') AND inner_path <> '' THEN inner_path ELSE raw END AS path FROM bare),
      slashed AS (SELECT *, CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END AS full_path FROM plain)
    SELECT DISTINCT repo, channel, CASE WHEN channel LIKE 'http%' THEN full_path ELSE raw END AS token FROM slashed
    WHERE CASE WHEN channel LIKE 'http%' THEN length(full_path) BETWEEN 2 AND 199 ELSE raw <> '' END"""


QUERIES["evidence_patterns"] = (evidence_patterns, _evidence_sql())


def truncate_head_tail(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(T.truncate_middle(F.col("text"), 1000, "\n...\n"), 256).alias("sha"))


QUERIES["truncate_head_tail"] = (
    truncate_head_tail,
    "SELECT doc_id, sha256(CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 600) || chr(10) || '...' || chr(10) || right(text, 400) END) AS sha FROM documents",
)


def slice_body(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(T.slice_body(F.col("text"), F.lit(2), F.lit(50)), 256).alias("sha"))


QUERIES["slice_body"] = (
    slice_body,
    f"""WITH l AS (SELECT doc_id, ({_LINES})[2:50] AS b FROM documents)
    SELECT doc_id, sha256(coalesce(array_to_string(CASE WHEN len(b) > 35 THEN list_concat(b[1:30], ['    ...'], b[-5:]) ELSE b END, chr(10)), '')) AS sha FROM l""",
)


def skip_reasons(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    reason = F.when(F.col("toxic") == 1, "parse_error").when(F.col("quality") == 0, "no_symbols").when(F.col("quality").isNull(), "io_error").when(F.col("n_chars") > 2000, "too_large")
    return d.join(lab, "doc_id", "left").select("doc_id", reason.alias("reason"))


QUERIES["skip_reasons"] = (
    skip_reasons,
    """SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'parse_error' WHEN quality = 0 THEN 'no_symbols' WHEN quality IS NULL THEN 'io_error' WHEN n_chars > 2000 THEN 'too_large' END AS reason
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)""",
)


def symbol_eligibility(spark, sf):
    i = table(spark, sf, "lineitem")
    span = F.col("l_quantity").cast("long")
    getter = F.concat(F.col("l_returnflag"), F.lit("get()")).rlike("^Nget")
    ok = F.col("l_linestatus").isin("O", "F") & (span >= 8) & ~(getter & (span < 3))
    return i.where(ok).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.max(span).alias("longest"))


QUERIES["symbol_eligibility"] = (
    symbol_eligibility,
    "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity)::BIGINT AS longest FROM lineitem WHERE l_linestatus IN ('O', 'F') AND l_quantity >= 8 GROUP BY 1, 2",
)


def json_params(spark, sf):
    e = table(spark, sf, "events")
    answer = T.json_answer(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    return e.select("event_id", F.from_json(answer, "k bigint")["k"].alias("k"))


QUERIES["json_params"] = (json_params, "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")


def hydrate_defaults(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    note = F.coalesce(F.nullif(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, ""), F.lit("")), F.col("lang"), F.lit(""))
    return d.join(lab, "doc_id", "left").select("doc_id", note.alias("note"))


QUERIES["hydrate_defaults"] = (
    hydrate_defaults,
    "SELECT d.doc_id, coalesce(nullif(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN '' END, ''), lang, '') AS note FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)",
)


def glob_expansion(spark, sf):
    paths = table(spark, sf, "pages").select(E.normal_path(F.col("url")).alias("path"))
    globs = spark.range(1).select(F.explode(F.array(F.struct(F.lit("english").alias("service"), F.lit("/en/*").alias("glob")), F.struct(F.lit("html").alias("service"), F.lit("**/*.html").alias("glob")))).alias("g")).select("g.*")
    return files_source.expand_globs(globs, paths)


QUERIES["glob_expansion"] = (
    glob_expansion,
    """WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT 'english' AS service, path FROM p WHERE regexp_full_match(path, '/en/[^/]*') UNION ALL SELECT 'html', path FROM p WHERE path LIKE '%.html'""",
)
