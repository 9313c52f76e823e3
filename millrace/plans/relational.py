"""Queries of joins, aggregates, windows, set operations, upserts and state machines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import delta, graph, link, search
from ..sources import files as files_source
from .common import Query, table

QUERIES: dict[str, Query] = {}


def micros():
    """Microseconds since 1970, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def service_counts(spark, sf):
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    named = nation.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return graph.hierarchy_counts(named, customer, ("n_nationkey", "c_nationkey"), ["r_name", "n_name"], "n_files")


QUERIES["service_counts"] = (
    service_counts,
    """SELECT r_name, n_name, count(c_custkey) AS n_files FROM region JOIN nation ON n_regionkey = r_regionkey
    LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name""",
)


def repo_counts(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    out = region
    for name, child, key in (("customers", "customer", "c_nationkey"), ("suppliers", "supplier", "s_nationkey")):
        placed = table(spark, sf, child).join(nation, F.col(key) == F.col("n_nationkey")).select("n_regionkey")
        out = graph.hierarchy_counts(out, placed, ("r_regionkey", "n_regionkey"), [c for c in out.columns], name)
    out = graph.hierarchy_counts(out, nation, ("r_regionkey", "n_regionkey"), out.columns, "nations")
    return out.select("r_name", "nations", "customers", "suppliers")


QUERIES["repo_counts"] = (
    repo_counts,
    """SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations,
      (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS customers,
      (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS suppliers FROM region""",
)


def enclosing_interval(spark, sf):
    e = table(spark, sf, "events").withColumn("at", micros())
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("owner"), F.col("at").alias("lo"), (F.col("at") + F.floor(F.col("value") * 3_600_000_000).cast("long")).alias("hi"))
    clicks = e.where("event_type = 'click'").select("user_id", "event_id", "at")
    found = graph.innermost(clicks, spans, ["user_id"], "at", "lo", "hi", ["event_id"], [F.asc("lo"), F.asc("owner")], bucket=24 * 3_600_000_000)
    return found.select("event_id", "owner")


QUERIES["enclosing_interval"] = (
    enclosing_interval,
    """WITH s AS (SELECT user_id, event_id AS owner, epoch_us(ts) AS lo, epoch_us(ts) + floor(value * 3600000000)::BIGINT AS hi FROM events WHERE event_type = 'signup')
    SELECT c.event_id, s.owner FROM events c JOIN s ON c.user_id = s.user_id AND epoch_us(c.ts) BETWEEN s.lo AND s.hi
    WHERE c.event_type = 'click' QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY s.hi - s.lo, s.lo, s.owner) = 1""",
)


def first_enclosing(spark, sf):
    e = table(spark, sf, "events").withColumn("at", micros())
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("owner"), F.col("at").alias("lo"), (F.col("at") + 86_400_000_000).alias("hi"))
    views = e.where("event_type = 'view'").select("user_id", "event_id", "at")
    return graph.first_enclosing(views, spans, ["user_id"], "at", "lo", "hi", ["event_id"], [F.asc("owner")]).select("event_id", "owner")


QUERIES["first_enclosing"] = (
    first_enclosing,
    """SELECT v.event_id, min(p.event_id) AS owner FROM events v JOIN events p ON v.user_id = p.user_id
      AND epoch_us(v.ts) BETWEEN epoch_us(p.ts) AND epoch_us(p.ts) + 86400000000
    WHERE v.event_type = 'view' AND p.event_type = 'purchase' GROUP BY v.event_id""",
)

_FQ = "p_brand || '::' || p_name || '::' || p_partkey"


def tiered_resolution(spark, sf):
    part, item = table(spark, sf, "part"), table(spark, sf, "lineitem")
    fq = F.expr(_FQ)
    symbols = part.select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), fq.alias("fqname"), F.col("p_partkey").alias("ord"))
    imports = part.groupBy(F.col("p_brand").alias("file"), F.concat(F.lit("Brand#"), F.col("p_size")).alias("target")).agg(F.min("p_partkey").alias("pos"))
    callers = part.select("p_partkey", F.col("p_brand").alias("file"), fq.alias("caller"))
    names = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    calls = item.join(callers, F.col("l_partkey") == F.col("p_partkey")).join(names, F.col("l_suppkey") == F.col("k"))
    calls = calls.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("call_id"), "file", "caller", "name").dropDuplicates(["call_id"])
    return graph.resolve_calls(calls, symbols, imports)


QUERIES["tiered_resolution"] = (
    tiered_resolution,
    f"""WITH s AS (SELECT p_brand AS file, p_name AS name, {_FQ} AS fq, p_partkey AS ord FROM part),
      byfile AS (SELECT file, name, arg_max(fq, ord) AS callee FROM s GROUP BY file, name),
      anyw AS (SELECT name, arg_min(fq, ord) AS callee FROM s GROUP BY name),
      imp AS (SELECT p_brand AS file, 'Brand#' || p_size AS target, min(p_partkey) AS pos FROM part GROUP BY 1, 2),
      c AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS call_id, a.p_brand AS file,
              a.p_brand || '::' || a.p_name || '::' || a.p_partkey AS caller, b.p_name AS name
            FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_suppkey = b.p_partkey),
      u AS (SELECT call_id, caller, callee, 1 AS tier, 0 AS pos FROM c JOIN byfile USING (file, name)
        UNION ALL SELECT call_id, caller, callee, 2, i.pos FROM c JOIN imp i ON i.file = c.file JOIN byfile b ON b.file = i.target AND b.name = c.name
        UNION ALL SELECT call_id, caller, callee, 3, 0 FROM c JOIN anyw USING (name))
    SELECT call_id, caller, callee, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM u WHERE caller <> callee
    QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY tier, pos, callee) = 1""",
)


def import_resolution(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source", F.concat("source", F.lit("/doc"), "doc_id", F.lit(".py")).alias("path"))
    names = d.select(F.col("path").alias("file"), F.explode(F.array(F.concat("source", F.lit(".doc"), "n_chars"), F.concat(F.lit("./doc"), "n_chars", F.lit(".py")))).alias("name"))
    out = graph.resolve_imports(names, d.select("path"))
    return out.select("file", "name", "target")


QUERIES["import_resolution"] = (
    import_resolution,
    """WITH d AS (SELECT doc_id, n_chars, source, source || '/doc' || doc_id || '.py' AS path FROM documents),
      m AS (SELECT d.path AS file, d.source, d.n_chars, t.path AS target FROM d JOIN d t ON t.source = d.source AND t.doc_id = d.n_chars WHERE t.path <> d.path)
    SELECT file, source || '.doc' || n_chars AS name, target FROM m UNION SELECT file, './doc' || n_chars || '.py', target FROM m""",
)


def decisions_exists_or(spark, sf):
    nodes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), "o_orderdate")
    mentions = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("target"))
    wanted = table(spark, sf, "part").where("p_size <= 2").select(F.col("p_partkey").alias("target"))
    return graph.mentioned_or_unlinked(nodes, mentions, wanted).select("node", "o_orderdate")


QUERIES["decisions_exists_or"] = (
    decisions_exists_or,
    """SELECT o_orderkey AS node, o_orderdate FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND p_size <= 2)
      OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')""",
)


def observations_exists(spark, sf):
    nodes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), "o_orderdate")
    mentions = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("target"))
    wanted = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("target"))
    found = graph.mentioned_or_unlinked(nodes, mentions, wanted, keep_unlinked=False)
    return found.orderBy(F.desc_nulls_last("o_orderdate"), "node").limit(5).select("node", "o_orderdate")


QUERIES["observations_exists"] = (
    observations_exists,
    """SELECT o_orderkey AS node, o_orderdate FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o.o_orderkey AND p_size = 7)
    ORDER BY o_orderdate DESC NULLS LAST, node LIMIT 5""",
)


def _trade_sets(spark, sf):
    item, nation = table(spark, sf, "lineitem"), table(spark, sf, "nation")
    token = F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("token")
    sell = item.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    buy = item.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    buy = buy.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return sell.select(F.col("n_name").alias("repo"), token).distinct(), buy.select(F.col("n_name").alias("repo"), token).distinct()


def overlap_edges(spark, sf):
    e = link.overlap_edges(*_trade_sets(spark, sf), "http")
    return e.withColumn("evidence", F.array_join("evidence", ","))


_SETS = """emit AS (SELECT DISTINCT n_name AS repo, lpad(l_partkey::VARCHAR, 12, '0') AS token FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
  con AS (SELECT DISTINCT n_name AS repo, lpad(l_partkey::VARCHAR, 12, '0') AS token FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
QUERIES["overlap_edges"] = (
    overlap_edges,
    f"""WITH {_SETS}, z AS (SELECT repo, count(*) AS size FROM emit GROUP BY repo),
      p AS (SELECT e.repo AS src, c.repo AS dst, list_sort(list(e.token)) AS ev, count(*) AS n FROM emit e JOIN con c USING (token) WHERE e.repo <> c.repo GROUP BY 1, 2)
    SELECT src, dst, 'http' AS via, array_to_string(ev[1:10], ',') AS evidence, n, round(least(1.0::DOUBLE, n::DOUBLE / size), 6) AS confidence FROM p JOIN z ON z.repo = p.src""",
)


def shared_edges(spark, sf):
    pages = table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("repo"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("token"))
    return link.shared_edges(pages.distinct()).withColumn("evidence", F.array_join("evidence", ","))


QUERIES["shared_edges"] = (
    shared_edges,
    """WITH s AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS token FROM pages),
      z AS (SELECT repo, count(*) AS size FROM s GROUP BY repo),
      p AS (SELECT a.repo AS src, b.repo AS dst, list_sort(list(a.token)) AS ev, count(*) AS n FROM s a JOIN s b USING (token) WHERE a.repo < b.repo GROUP BY 1, 2)
    SELECT src, dst, 'shared_collection' AS via, array_to_string(ev[1:10], ',') AS evidence, n, round(n::DOUBLE / (x.size + y.size - n), 6) AS confidence
    FROM p JOIN z x ON x.repo = src JOIN z y ON y.repo = dst""",
)


def edges_of_project(spark, sf):
    e = link.overlap_edges(*_trade_sets(spark, sf), "http").where(F.col("confidence") >= 0.6)
    return link.edges_of(e, "NATION_3").select("src", "dst", "confidence")


QUERIES["edges_of_project"] = (
    edges_of_project,
    f"""WITH {_SETS}, z AS (SELECT repo, count(*) AS size FROM emit GROUP BY repo),
      p AS (SELECT e.repo AS src, c.repo AS dst, count(*) AS n FROM emit e JOIN con c USING (token) WHERE e.repo <> c.repo GROUP BY 1, 2)
    SELECT src, dst, round(n::DOUBLE / size, 6) AS confidence FROM p JOIN z ON z.repo = p.src WHERE round(n::DOUBLE / size, 6) >= 0.6 AND (src = 'NATION_3' OR dst = 'NATION_3')""",
)


def snapshot_diff(spark, sf):
    prev = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("hash"))
    cur = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.max("l_linestatus").alias("hash"))
    return delta.snapshot_diff(prev, cur)


QUERIES["snapshot_diff"] = (
    snapshot_diff,
    """WITH c AS (SELECT l_orderkey, max(l_linestatus) AS h FROM lineitem GROUP BY 1)
    SELECT coalesce(o_orderkey, l_orderkey) AS path, CASE WHEN o_orderkey IS NULL THEN 'added' WHEN l_orderkey IS NULL THEN 'deleted' ELSE 'modified' END AS change
    FROM orders FULL JOIN c ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_orderkey IS NULL OR o_orderstatus IS DISTINCT FROM h""",
)


def _people(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c, s


def upsert_merge(spark, sf):
    c, s = _people(spark, sf)
    return delta.upsert(c, s, ["key"], create_only=("balance",))


QUERIES["upsert_merge"] = (
    upsert_merge,
    """SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, coalesce(c_acctbal, s_acctbal) FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey""",
)


def partial_update(spark, sf):
    c, s = _people(spark, sf)
    return delta.partial_update(c, s, ["key"], ["nation"])


QUERIES["partial_update"] = (
    partial_update,
    "SELECT c_custkey AS key, c_name AS name, coalesce(s_nationkey, c_nationkey) AS nation, c_acctbal AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
)


def prune_stale(spark, sf):
    current = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    c, _ = _people(spark, sf)
    return delta.prune(c, current, ["key"])


QUERIES["prune_stale"] = (prune_stale, "SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")


def replace_partition(spark, sf):
    c, s = _people(spark, sf)
    _, gone = delta.replace_partition(c, s.where("balance > 5000"), "nation")
    return gone.select("nation", F.col("pruned").cast("long").alias("pruned"))


QUERIES["replace_partition"] = (
    replace_partition,
    "SELECT c_nationkey AS nation, count(*) AS pruned FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1",
)


def cascade_delete(spark, sf):
    removed = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    left = delta.cascade_delete({"item": (table(spark, sf, "lineitem"), "l_orderkey")}, removed, "o_orderkey")["item"]
    return left.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


QUERIES["cascade_delete"] = (
    cascade_delete,
    "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
)


def edge_merge_max(spark, sf):
    i = table(spark, sf, "lineitem")
    primary = i.select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), F.col("l_discount").alias("confidence"))
    secondary = i.select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), F.col("l_tax").alias("confidence"))
    return graph.merge_edges(primary, secondary)


QUERIES["edge_merge_max"] = (edge_merge_max, "SELECT l_suppkey AS caller, l_partkey AS callee, max(greatest(l_discount, l_tax)) AS confidence FROM lineitem GROUP BY 1, 2")


def override_merge(spark, sf):
    c, s = _people(spark, sf)
    return graph.merge_overrides(c.withColumn("ord", F.col("key")), s.select("key", "name", "nation", "balance"), "key", "ord")


QUERIES["override_merge"] = (
    override_merge,
    """SELECT coalesce(s_suppkey, c_custkey) AS key, c_custkey AS ord, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name, CASE WHEN s_suppkey IS NULL THEN c_nationkey ELSE s_nationkey END AS nation,
      CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS balance, s_suppkey IS NOT NULL AS overridden FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""",
)


def census(spark, sf):
    return graph.census(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


QUERIES["census"] = (census, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1, 2")


def conditional_counters(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(
        *(F.count_if(F.col("event_type") == k).cast("long").alias(k) for k in ("signup", "error", "click", "view", "purchase")), F.bool_and(F.col("value") > 1).alias("all_ok")
    )


QUERIES["conditional_counters"] = (
    conditional_counters,
    "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("signup", "error", "click", "view", "purchase")) + ", bool_and(value > 1) AS all_ok FROM events GROUP BY 1",
)


def first_last_index(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.min_by("p_brand", "p_partkey").alias("first_brand"), F.max_by("p_brand", "p_partkey").alias("last_brand"))


QUERIES["first_last_index"] = (first_last_index, "SELECT p_name, arg_min(p_brand, p_partkey) AS first_brand, arg_max(p_brand, p_partkey) AS last_brand FROM part GROUP BY 1")


def newest_keep(spark, sf):
    o = table(spark, sf, "orders").withColumn("stamp", F.struct("o_orderdate", "o_orderkey"))
    return files_source.newest(o, 3, ["o_custkey"], "stamp").select("o_custkey", "o_orderkey")


QUERIES["newest_keep"] = (newest_keep, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")


def set_operations(spark, sf):
    buy = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    own = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"))
    tag = lambda d, n: d.withColumn("op", F.lit(n))
    return tag(own.subtract(buy), "except").unionByName(tag(own.intersect(buy), "intersect")).unionByName(tag(own.union(buy).distinct(), "union"))


QUERIES["set_operations"] = (
    set_operations,
    """SELECT key, 'except' AS op FROM (SELECT s_suppkey AS key FROM supplier EXCEPT SELECT o_custkey FROM orders)
    UNION ALL SELECT key, 'intersect' FROM (SELECT s_suppkey AS key FROM supplier INTERSECT SELECT o_custkey FROM orders)
    UNION ALL SELECT key, 'union' FROM (SELECT s_suppkey AS key FROM supplier UNION SELECT o_custkey FROM orders)""",
)


def status_journal(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return delta.last_write(e, ["user_id"], [F.col("ts"), F.col("event_id")])


QUERIES["status_journal"] = (status_journal, "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")


def backoff_series(spark, sf):
    e = delta.streaks(table(spark, sf, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error")
    return e.select("event_id", F.col("streak").cast("long").alias("streak"), delta.backoff_seconds(F.col("streak")).alias("wait"))


QUERIES["backoff_series"] = (
    backoff_series,
    """WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events),
      s AS (SELECT event_id, (sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id))::BIGINT AS streak FROM g)
    SELECT event_id, streak, CASE WHEN streak <= 0 THEN 0.0::DOUBLE ELSE least(300.0::DOUBLE, 15.0::DOUBLE * pow(2, streak - 1)) END AS wait FROM s""",
)


def circuit_breaker(spark, sf):
    e = delta.breaker_trips(table(spark, sf, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error", 4)
    return e.select("event_id", F.col("errors").cast("long").alias("errors"), "tripped")


QUERIES["circuit_breaker"] = (
    circuit_breaker,
    """SELECT event_id, (sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w)::BIGINT AS errors, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w >= 4 AS tripped
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
)


def due_jobs(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.floor(micros() / 1_000_000)).alias("last_run"), F.max("value").alias("interval_s"))
    return delta.due(last.withColumn("interval_s", F.floor(F.col("interval_s") * 60)), F.lit(1706590000)).select("user_id", "last_run")


QUERIES["due_jobs"] = (
    due_jobs,
    """SELECT user_id, last_run FROM (SELECT user_id, max(floor(epoch(ts)))::BIGINT AS last_run, floor(max(value) * 60)::BIGINT AS interval_s FROM events GROUP BY 1)
    WHERE 1706590000 >= last_run + interval_s""",
)


def tick_timeouts(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("l_suppkey", delta.tick_timeout(F.col("n"), floor=600, most=1300).cast("long").alias("timeout"))


QUERIES["tick_timeouts"] = (tick_timeouts, "SELECT l_suppkey, least(1300, greatest(600, (count(*) * 2)::INT))::BIGINT AS timeout FROM lineitem GROUP BY 1")


def candidate_whitelist(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return search.known_only(e, known, "user_id").select("event_id", "user_id")


QUERIES["candidate_whitelist"] = (candidate_whitelist, "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier)")


def score_decorate(spark, sf):
    score = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("value").alias("score"))
    c = table(spark, sf, "customer")
    return search.decorate(c.select("c_custkey"), score, "c_custkey")


QUERIES["score_decorate"] = (
    score_decorate,
    "SELECT c_custkey, coalesce(score, 0.0::DOUBLE) AS score FROM customer LEFT JOIN (SELECT user_id, max(value) AS score FROM events GROUP BY 1) ON user_id = c_custkey",
)


def memory_list(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.orderBy(F.desc_nulls_last("turn"), "conv_id").limit(50).select("conv_id", "turn", T.token_count(F.col("text")).cast("long").alias("tokens"))


QUERIES["memory_list"] = (memory_list, "SELECT conv_id, turn, (length(text) // 4)::BIGINT AS tokens FROM conversations WHERE role = 'assistant' ORDER BY turn DESC NULLS LAST, conv_id LIMIT 50")


def supersede(spark, sf):
    from ..operators import memory

    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat_ws(":", "conv_id", F.col("turn") - 2).alias("old"), F.lit("active").alias("status"))
    out = memory.supersede(c.select("id", "status"), c.select(F.col("old").alias("id")))
    return out.select("id", "status")


QUERIES["supersede"] = (
    supersede,
    """SELECT conv_id || ':' || turn AS id, CASE WHEN EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 2) THEN 'superseded' ELSE 'active' END AS status FROM conversations c""",
)


def activity_windows(spark, sf):
    from ..streaming.ingest import activity

    return activity(table(spark, sf, "events"), "1 day").select("start", "event_type", F.col("n").cast("long").alias("n"))


QUERIES["activity_windows"] = (activity_windows, "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")


def stream_journal(spark, sf):
    """The newest event of each user, kept by a stream that runs until its input is used up."""
    import uuid

    from ..sources.store import Store
    from ..streaming.ingest import stream_upserts

    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    root = f"{base.rstrip('/')}/millrace/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")
    alone = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet" if alone else "*.parquet")
    source = reader.parquet(sf if alone else f"{sf}/events.parquet")
    rows = source.select(F.col("user_id").cast("string").alias("repo"), F.col("event_id").cast("string").alias("head_sha"), F.col("event_type").alias("branch"), F.col("ts").alias("last_seen"))
    store = Store(spark, root)
    query = stream_upserts(rows, store, "git_state", f"{root}/_stream", ["repo"], "last_seen")
    query.awaitTermination()
    return store.read("git_state").select(F.col("repo").cast("long").alias("user_id"), F.col("last_seen").cast("timestamp_ntz").alias("ts"), F.col("branch").alias("event_type"))


QUERIES["stream_journal"] = (stream_journal, "SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
