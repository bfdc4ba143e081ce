"""Queries over program facts (events seen as call graphs), each beside the SQL that must give the same rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import exprs
from factweave.operators import aggregates, features, gating, graph, leads, relational
from factweave.sources import facts
from factweave.sources.store import large, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SINKS, SOURCES = ["__k1", "__k7"], ["__k7", "__k3"]
CODE_SQL = """,
code AS (SELECT item_id, fn AS func, fn || '(a1)' || chr(10) || '{' || chr(10) || chr(9) || ' v1 = ' || (min(k) % 3) || ';' || chr(10) || '  p = ' || CASE WHEN max(k) % 2 = 0 THEN ' alloca(8)' ELSE '0' END || ';' || chr(10) || '}' AS pcode FROM ev GROUP BY item_id, fn),
uses AS (SELECT DISTINCT item_id, caller, '__k' || substr(callee, 5) AS api FROM calls WHERE cat = 'IMPORT_API')
"""
REACH_SQL = """,
reach AS (SELECT item_id, entry AS name FROM entries UNION SELECT r.item_id, e.dst FROM reach r JOIN edges e ON e.item_id = r.item_id AND e.src = r.name)
"""
PATHS_SQL = """,
paths AS (SELECT item_id, [entry] AS path, entry AS last FROM entries
  UNION ALL SELECT p.item_id, list_append(p.path, e.dst), e.dst FROM paths p JOIN edges e ON e.item_id = p.item_id AND e.src = p.last WHERE NOT list_contains(p.path, e.dst))
"""
MUTUAL_SQL = """,
fnodes AS (SELECT item_id, src AS name FROM edges UNION SELECT item_id, dst FROM edges),
closure AS (SELECT item_id, name AS a, name AS b FROM fnodes UNION SELECT c.item_id, c.a, e.dst FROM closure c JOIN edges e ON e.item_id = c.item_id AND e.src = c.b),
comps AS (SELECT x.item_id, x.a AS name, min(x.b) AS comp FROM closure x JOIN closure y ON x.item_id = y.item_id AND x.a = y.b AND x.b = y.a GROUP BY ALL)
"""


def query(name: str, sql: str | None = None, head: str = ""):
    """Registers a query and, where given, its oracle behind the facts' common table expressions."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {facts.FACTS_SQL}{head} {sql}"
        return f

    return put


class Facts:
    """The adapters of one run. Events and calls, which most operators read several times, are written once."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    @cached_property
    def events(self) -> DataFrame:
        return stored(facts.events(self.spark, self.d), "events")

    @cached_property
    def calls(self) -> DataFrame:
        return stored(facts.calls(self.events), "calls")

    @property
    def entries(self) -> DataFrame:
        return facts.entries(self.events)

    @property
    def sizes(self) -> DataFrame:
        return facts.sizes(self.events)

    @cached_property
    def edges(self) -> DataFrame:
        return stored(graph.user_graph(self.calls), "edges")

    @property
    def starts(self) -> DataFrame:
        return self.entries.select("item_id", F.col("entry").alias("name"))

    @property
    def code(self) -> DataFrame:
        grab = F.when(F.max("k") % 2 == 0, " alloca(8)").otherwise("0")
        pcode = F.concat(F.col("fn"), F.lit("(a1)\n{\n\t v1 = "), (F.min("k") % 3).cast("string"), F.lit(";\n  p = "), grab, F.lit(";\n}"))
        return self.events.groupBy("item_id", "fn").agg(pcode.alias("pcode")).withColumnRenamed("fn", "func")

    @property
    def uses(self) -> DataFrame:
        return self.calls.where("cat = 'IMPORT_API'").select("item_id", "caller", exprs.norm_api(F.col("callee")).alias("api")).distinct()

    @cached_property
    def paths(self) -> DataFrame:
        return stored(graph.simple_paths(self.edges, self.starts), "paths")


def _apis(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "api string")


def _text(c: str = "path"):
    return F.array_join(c, "->")


@query("flagship_reach_imports", "SELECT r.item_id, count(DISTINCT r.name) AS n_reach, count(DISTINCT c.callee) AS n_apis, count(c.ln) AS n_calls FROM reach r LEFT JOIN calls c ON c.item_id = r.item_id AND c.caller = r.name AND c.cat = 'IMPORT_API' GROUP BY r.item_id", REACH_SQL)
def flagship(spark, d):
    f = Facts(spark, d)
    reach = graph.reachable(f.edges, f.entries).select("item_id", "name")
    per = f.calls.where("cat = 'IMPORT_API'").groupBy("item_id", F.col("caller").alias("name")).agg(F.collect_set("callee").alias("apis"), F.count(F.lit(1)).alias("n"))
    both = reach.join(per, ["item_id", "name"], "left")
    return both.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_reach"), F.size(F.array_distinct(F.flatten(F.collect_list("apis")))).cast("long").alias("n_apis"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_calls")).orderBy("item_id")


@query("g1_call_subgraph", "SELECT item_id, caller AS src, count(*) FILTER (cat = 'USER_DEF') AS n_internal, count(*) FILTER (cat = 'IMPORT_API') AS n_import, string_agg(callee, ',' ORDER BY ln, callee) FILTER (cat = 'USER_DEF') AS internal FROM calls GROUP BY ALL")
def g1(spark, d):
    f = Facts(spark, d)
    sub = graph.call_subgraph(f.calls, f.sizes)
    names = F.array_join(F.transform("internal_edges", lambda x: x["dst"]), ",")
    return sub.select("item_id", "src", F.size("internal_edges").cast("long").alias("n_internal"), F.size("import_edges").cast("long").alias("n_import"), F.when(F.size("internal_edges") > 0, names).alias("internal"))


@query("g2_adjacency", "SELECT item_id, src, dst, count(*) AS n FROM (SELECT item_id, caller AS src, callee AS dst FROM calls WHERE cat = 'USER_DEF' AND item_id % 2 = 0 UNION ALL SELECT item_id, src, dst FROM edges WHERE item_id % 2 = 1 OR item_id NOT IN (SELECT item_id FROM calls WHERE cat = 'USER_DEF')) GROUP BY ALL")
def g2(spark, d):
    f = Facts(spark, d)
    # Items of even number have a subgraph, the others fall back to their reachable graph.
    own = f.calls.where("cat = 'USER_DEF' and item_id % 2 = 0").select("item_id", F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.adjacency(own, f.edges).groupBy("item_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("g3_user_graph", "SELECT item_id, src, dst FROM edges")
def g3(spark, d):
    return Facts(spark, d).edges


@query("g4_reachable", "SELECT item_id, name FROM reach", REACH_SQL)
def g4(spark, d):
    f = Facts(spark, d)
    return graph.reachable(f.edges, f.entries).select("item_id", "name")


@query("g4_induced_edges", "SELECT e.item_id, e.src, e.dst FROM edges e JOIN reach a ON a.item_id = e.item_id AND a.name = e.src JOIN reach b ON b.item_id = e.item_id AND b.name = e.dst", REACH_SQL)
def g4_induced(spark, d):
    f = Facts(spark, d)
    return graph.induced(f.edges, graph.reachable(f.edges, f.entries))


@query("g5_simple_paths", "SELECT item_id, path[1] AS start, last AS \"end\", array_to_string(path, '->') AS path FROM paths", PATHS_SQL)
def g5(spark, d):
    f = Facts(spark, d)
    return graph.simple_paths(f.edges, f.starts).withColumn("path", _text())


@query("g6_complete_chains", "SELECT item_id, array_to_string(path, '->') AS path FROM paths p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.item_id = p.item_id AND e.src = p.last AND NOT list_contains(p.path, e.dst))", PATHS_SQL)
def g6(spark, d):
    f = Facts(spark, d)
    return graph.complete_chains(f.edges, f.starts).select("item_id", _text().alias("path"))


@query("g7_scc", "SELECT item_id, name, comp FROM comps", MUTUAL_SQL)
def g7(spark, d):
    return graph.scc(Facts(spark, d).edges)


CONDENSED = "SELECT DISTINCT e.item_id, a.comp AS ci, b.comp AS cj FROM edges e JOIN comps a ON a.item_id = e.item_id AND a.name = e.src JOIN comps b ON b.item_id = e.item_id AND b.name = e.dst WHERE a.comp <> b.comp"


def trade(name: str, sql: str, head: str = ""):
    """As ``query``, over the sparse graphs of ``facts.trade``."""

    def put(f):
        QUERIES[name] = f
        ORACLES[name] = f"WITH RECURSIVE {facts.TRADE_SQL}{head} {sql}"
        return f

    return put


def _trade(spark, d) -> tuple[DataFrame, DataFrame]:
    li = facts.trade(spark, d)
    return stored(li.select("item_id", "src", "dst").distinct(), "trade"), facts.trade_entries(li)


@trade("g8_condensation", CONDENSED, MUTUAL_SQL)
def g8(spark, d):
    edges, _ = _trade(spark, d)
    return graph.condensation(edges, graph.scc(edges))


@trade("g7_scc_sparse", "SELECT item_id, name, comp FROM comps", MUTUAL_SQL)
def g7_sparse(spark, d):
    return graph.scc(_trade(spark, d)[0])


@trade("g4_reachable_sparse", "SELECT item_id, name FROM reach", REACH_SQL)
def g4_sparse(spark, d):
    return graph.reachable(*_trade(spark, d)).select("item_id", "name")


@trade("p1_reachable_functions", "SELECT n.item_id, n.name FROM fnodes n JOIN reach r USING (item_id, name)", REACH_SQL + ", fnodes AS (SELECT item_id, src AS name FROM edges UNION SELECT item_id, dst FROM edges)")
def p1(spark, d):
    edges, entries = _trade(spark, d)
    return relational.reachable_functions(graph.nodes(edges), graph.reachable(edges, entries), entries).select("item_id", "name")


@trade("g13_local_taint", "SELECT DISTINCT item_id, name AS var FROM t", """,
calls AS (SELECT DISTINCT item_id, seq // 10 % 199 AS call_id, src AS var FROM li),
flow AS (SELECT item_id, src AS a, dst AS b FROM edges UNION SELECT x.item_id, x.var, y.var FROM calls x JOIN calls y ON y.item_id = x.item_id AND y.call_id = x.call_id),
t AS (SELECT item_id, entry AS name, 0 AS n FROM entries UNION SELECT t.item_id, f.b, t.n + 1 FROM t JOIN flow f ON f.item_id = t.item_id AND f.a = t.name WHERE t.n < 2)
""")
def g13(spark, d):
    # Line items of one order number are the arguments of one call; two passes leave much untainted.
    li = facts.trade(spark, d)
    named = li.select("item_id", F.lit("f").alias("func"), "src", "dst", (F.floor(F.col("seq") / 10) % 199).alias("call_id"))
    assigns = named.select("item_id", "func", F.col("dst").alias("lhs"), F.col("src").alias("rhs"))
    args = named.select("item_id", "func", "call_id", F.col("src").alias("var"))
    seeds = facts.trade_entries(li).select("item_id", F.lit("f").alias("func"), F.col("entry").alias("var"))
    return graph.local_taint(assigns, args, seeds, 2).select("item_id", "var")


@trade("g9_dag_metrics_sparse", f""", cond AS ({CONDENSED}),
walk AS (SELECT n.item_id, c.comp, 1 AS len FROM entries n JOIN comps c ON c.item_id = n.item_id AND c.name = n.entry
  UNION ALL SELECT w.item_id, k.cj, w.len + 1 FROM walk w JOIN cond k ON k.item_id = w.item_id AND k.ci = w.comp)
SELECT w.item_id, CAST(count(*) AS DOUBLE) AS path_count, CAST(min(len) AS BIGINT) AS min_len, CAST(max(len) AS BIGINT) AS max_len, round(avg(len), 6) AS avg_len, count(DISTINCT comp) AS leaves
FROM walk w WHERE NOT EXISTS (SELECT 1 FROM cond k WHERE k.item_id = w.item_id AND k.ci = w.comp) GROUP BY w.item_id""", MUTUAL_SQL)
def g9_sparse(spark, d):
    return graph.dag_metrics(*_trade(spark, d)).select("item_id", "path_count", "min_len", "max_len", F.round("avg_len", 6).alias("avg_len"), "leaves")


@query(
    "g9_dag_metrics",
    f""", cond AS ({CONDENSED}),
    walk AS (SELECT n.item_id, coalesce(c.comp, n.entry) AS comp, 1 AS len FROM entries n LEFT JOIN comps c ON c.item_id = n.item_id AND c.name = n.entry
      UNION ALL SELECT w.item_id, k.cj, w.len + 1 FROM walk w JOIN cond k ON k.item_id = w.item_id AND k.ci = w.comp)
    SELECT w.item_id, CAST(count(*) AS DOUBLE) AS path_count, CAST(min(len) AS BIGINT) AS min_len, CAST(max(len) AS BIGINT) AS max_len, round(avg(len), 6) AS avg_len, count(DISTINCT comp) AS leaves
    FROM walk w WHERE NOT EXISTS (SELECT 1 FROM cond k WHERE k.item_id = w.item_id AND k.ci = w.comp) GROUP BY w.item_id""",
    MUTUAL_SQL,
)
def g9(spark, d):
    f = Facts(spark, d)
    return graph.dag_metrics(f.edges, f.entries).select("item_id", "path_count", "min_len", "max_len", F.round("avg_len", 6).alias("avg_len"), "leaves")


WL_SQL = """,
multi AS (SELECT item_id, caller AS src, callee AS dst FROM calls WHERE cat = 'USER_DEF'),
l0 AS (SELECT f.item_id, f.name, CASE WHEN f.name = n.entry THEN 'ROOT|' ELSE '' END || 'S' || (CASE WHEN f.size <= 0 THEN 0 ELSE CAST(floor(log2(f.size)) AS BIGINT) + 1 END) || '|O' || coalesce((SELECT count(*) FROM multi m WHERE m.item_id = f.item_id AND m.src = f.name), 0) AS label FROM funcs f JOIN entries n USING (item_id)),
l1 AS (SELECT a.item_id, a.name, substr(md5(a.label || '|OUT:' || coalesce((SELECT string_agg(b.label, ',' ORDER BY b.label) FROM multi m JOIN l0 b ON b.item_id = m.item_id AND b.name = m.dst WHERE m.item_id = a.item_id AND m.src = a.name), '') || '|IN:' || coalesce((SELECT string_agg(b.label, ',' ORDER BY b.label) FROM multi m JOIN l0 b ON b.item_id = m.item_id AND b.name = m.src WHERE m.item_id = a.item_id AND m.dst = a.name), '')), 1, 12) AS label FROM l0 a),
l2 AS (SELECT a.item_id, a.name, substr(md5(a.label || '|OUT:' || coalesce((SELECT string_agg(b.label, ',' ORDER BY b.label) FROM multi m JOIN l1 b ON b.item_id = m.item_id AND b.name = m.dst WHERE m.item_id = a.item_id AND m.src = a.name), '') || '|IN:' || coalesce((SELECT string_agg(b.label, ',' ORDER BY b.label) FROM multi m JOIN l1 b ON b.item_id = m.item_id AND b.name = m.src WHERE m.item_id = a.item_id AND m.dst = a.name), '')), 1, 12) AS label FROM l1 a),
wl AS (SELECT item_id, substr(md5(string_agg(label, ',' ORDER BY label)), 1, 16) AS wl FROM l2 GROUP BY item_id)
"""


def _wl(f: Facts) -> DataFrame:
    edges = f.calls.where("cat = 'USER_DEF'").select("item_id", F.col("caller").alias("src"), F.col("callee").alias("dst"))
    out = edges.groupBy("item_id", F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    base = f.sizes.join(large(f.entries), "item_id").join(large(out), ["item_id", "name"], "left")
    label = F.concat(F.when(F.col("name") == F.col("entry"), "ROOT|").otherwise(""), F.lit("S"), exprs.bucket_log2(F.col("size")).cast("string"), F.lit("|O"), F.coalesce("n", F.lit(0)).cast("string"))
    return graph.wl_signature(edges, base.select("item_id", "name", label.alias("label")))


@query("g10_wl_signature", "SELECT item_id, wl FROM wl", WL_SQL)
def g10(spark, d):
    return _wl(Facts(spark, d))


@query("g12_table_edges", "SELECT DISTINCT a.item_id, a.fn AS src, b.fn AS dst FROM ev a JOIN ev b ON b.item_id = a.item_id AND b.k = a.k + 1")
def g12(spark, d):
    ev = Facts(spark, d).events
    tables = ev.select("item_id", F.col("fn").alias("src"), F.array(F.col("k") + 1).alias("slots"))
    return graph.table_edges(tables, ev.select("item_id", F.col("k").alias("start_ea"), F.col("fn").alias("name")))


SINK_NAMES = ["error", "purchase"]


@query("g14_taint_paths", "SELECT item_id, array_to_string(path, '->') AS path FROM (SELECT *, row_number() OVER (PARTITION BY item_id, last ORDER BY len(path), path) AS k FROM paths WHERE last IN ('error', 'purchase') AND NOT list_has_any(path[1:len(path) - 1], ['error', 'purchase'])) WHERE k = 1", PATHS_SQL)
def g14(spark, d):
    f = Facts(spark, d)
    sinks = graph.nodes(f.edges).where(F.col("name").isin(*SINK_NAMES)).unionByName(f.starts.where(F.col("name").isin(*SINK_NAMES)))
    return graph.taint_paths(f.edges, f.starts, sinks).select("item_id", _text().alias("path"))


@query("g15_splice", "SELECT p.item_id, array_to_string(list_concat(p.path[1:len(p.path) - 1], [p.last, 'end']), '->') AS path FROM (SELECT *, row_number() OVER (PARTITION BY item_id, last ORDER BY len(path), path) AS k FROM paths) p WHERE k = 1", PATHS_SQL)
def g15(spark, d):
    f = Facts(spark, d)
    best = stored(graph.shortest_paths(f.edges, f.starts), "g15")
    return graph.splice(best, best.select("item_id", F.array("end", F.lit("end")).alias("path"))).select("item_id", _text().alias("path"))


@query("g16_chain_package", "SELECT item_id, array_to_string(path, '->') AS chain, CAST(len(path) AS BIGINT) AS n_code FROM paths p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.item_id = p.item_id AND e.src = p.last AND NOT list_contains(p.path, e.dst))", PATHS_SQL)
def g16(spark, d):
    f = Facts(spark, d)
    chains = graph.complete_chains(f.edges, f.starts).dropDuplicates(["item_id", "path"]).withColumnRenamed("path", "call_chain").withColumn("lead_id", F.xxhash64("item_id", _text("call_chain")))
    full = relational.chain_code(chains, f.code)
    return full.select("item_id", _text("call_chain").alias("chain"), F.size(F.array_compact("pcode_list")).cast("long").alias("n_code"))


@query("a3_import_counts", "SELECT item_id, '__k' || substr(callee, 5) AS api, count(*) AS n FROM calls WHERE cat = 'IMPORT_API' GROUP BY ALL")
def a3(spark, d):
    return aggregates.import_counts(Facts(spark, d).calls)


@query("a4_used_imports", "SELECT item_id, string_agg(DISTINCT '__k' || substr(callee, 5), ',' ORDER BY '__k' || substr(callee, 5)) AS apis FROM calls WHERE cat = 'IMPORT_API' GROUP BY ALL")
def a4(spark, d):
    return aggregates.used_imports(Facts(spark, d).calls).select("item_id", F.array_join("apis", ",").alias("apis"))


@query("a5_size_stats", "SELECT item_id, round(avg(size), 6) AS avg_size, max(size) AS max_size, min(size) AS min_size, count(*) AS n FROM funcs WHERE size > 0 GROUP BY ALL")
def a5(spark, d):
    return aggregates.size_stats(Facts(spark, d).sizes).withColumn("avg_size", F.round("avg_size", 6))


@query("a6_degrees", ", m AS (SELECT item_id, caller AS src, callee AS dst FROM calls WHERE cat = 'USER_DEF'), n AS (SELECT item_id, src AS name FROM m UNION SELECT item_id, dst FROM m), o AS (SELECT n.item_id, n.name, count(m.src) AS d FROM n LEFT JOIN m ON m.item_id = n.item_id AND m.src = n.name GROUP BY ALL) SELECT item_id, max(d) AS max_out, round(avg(d), 6) AS avg_out, count(*) FILTER (d = 0) AS leaves, count(*) AS n_nodes, CAST(sum(d) AS BIGINT) AS n_edges FROM o GROUP BY item_id")
def a6(spark, d):
    edges = Facts(spark, d).calls.where("cat = 'USER_DEF'").select("item_id", F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.degrees(edges).withColumn("avg_out", F.round("avg_out", 6))


@query("a11_call_sites", "SELECT item_id, caller, callee, ln, CASE WHEN bool_or(call_type = 'INDIRECT') THEN 'INDIRECT' ELSE 'DIRECT' END AS call_type FROM calls GROUP BY ALL")
def a11(spark, d):
    return aggregates.call_sites(Facts(spark, d).calls)


@query("a12_smoke_rollup", ", t AS (SELECT l_orderkey AS item_id, l_linenumber AS ln, l_returnflag AS r, count(*) OVER (PARTITION BY l_orderkey) AS total, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS first FROM lineitem) SELECT item_id, CASE WHEN max(first) IS NOT NULL THEN 'signal' WHEN count(*) FILTER (r = 'A') = max(total) THEN 'timeout' ELSE 'normal' END AS status, count(*) AS executed, count(*) FILTER (r = 'A') AS timeouts, CAST(CASE WHEN max(first) IS NOT NULL THEN 11 END AS INTEGER) AS signal FROM t WHERE first IS NULL OR ln <= first GROUP BY item_id")
def a12(spark, d):
    li = facts.table(spark, d, "lineitem")
    outcome = F.when(F.col("l_returnflag") == "R", "signal").when(F.col("l_returnflag") == "A", "timeout").otherwise("normal")
    return aggregates.smoke_rollup(li.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("seq"), outcome.alias("outcome"), F.lit(11).alias("signal")))


@query("a13_global_refs", "SELECT item_id, k AS addr_ea, count(DISTINCT (fn, ln % 7)) AS n_refs FROM ev GROUP BY ALL")
def a13(spark, d):
    ev = Facts(spark, d).events
    return aggregates.global_references(ev.select("item_id", F.col("k").alias("addr_ea"), F.col("fn").alias("function_name"), (F.col("ln") % 7).alias("decompiled_line"))).drop("refs")


@query("a16_usage_lines", "SELECT item_id, fn AS func, 'k' || (k % 5) AS var, string_agg(DISTINCT CAST(ln AS VARCHAR), ',' ORDER BY CAST(ln AS VARCHAR)) AS lines FROM ev GROUP BY ALL")
def a16(spark, d):
    ev = Facts(spark, d).events
    uses = ev.select("item_id", F.col("fn").alias("func"), F.concat(F.lit("k"), F.col("k") % 5).alias("var"), "ln")
    return aggregates.usage_lines(uses).select("item_id", "func", "var", F.array_join(F.array_sort(F.transform("usage_lines", lambda x: x.cast("string"))), ",").alias("lines"))


@query("p3_api_uses", ", o AS (SELECT item_id, caller, callee AS api, min(ln) AS ln FROM calls WHERE cat = 'IMPORT_API' GROUP BY ALL) SELECT item_id, caller, api, CAST(row_number() OVER (PARTITION BY item_id, caller ORDER BY ln, api) AS INTEGER) AS seq FROM o")
def p3(spark, d):
    return relational.api_uses(Facts(spark, d).calls)


@query("p4_last_by_name", "SELECT item_id, fn AS name, arg_max(k, ln) AS k FROM ev GROUP BY ALL")
def p4(spark, d):
    ev = Facts(spark, d).events
    return relational.last_by_name(ev.select("item_id", F.col("fn").alias("name"), F.col("ln").alias("seq"), "k")).select("item_id", "name", "k")


@query("p5_prefixed_code", "SELECT item_id, md5('Real symbol name: ' || func || chr(10) || pcode) AS h FROM code", CODE_SQL)
def p5(spark, d):
    return Facts(spark, d).code.select("item_id", F.md5(relational.prefixed(F.col("func"), F.col("pcode"))).alias("h"))


@query("p6_writes_memory", "SELECT item_id, func, len(list_filter(string_split(pcode, chr(10)), lambda x: regexp_matches(x, '^\\s*[^=]+ = .+') AND NOT regexp_matches(x, '^\\s*[^=]+ = (0($|;)|0x0($|;)|0\\.0($|;)|0d($|;)|__readfsqword)'))) > 0 AS writes FROM code", CODE_SQL)
def p6(spark, d):
    return Facts(spark, d).code.select("item_id", "func", relational.writes_memory(F.col("pcode")).alias("writes"))


@query("p11_meaningful_lines", "SELECT item_id, func, array_to_string(list_filter(list_transform(string_split(pcode, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x NOT IN ('', '{', '}', 'else', 'do')), '|') AS lines FROM code", CODE_SQL)
def p11(spark, d):
    return Facts(spark, d).code.select("item_id", "func", F.array_join(relational.meaningful_lines(F.col("pcode")), "|").alias("lines"))


@query("j1_source_sink_pairs", "SELECT DISTINCT s.item_id, s.api AS source_api, t.api AS sink_api, s.caller AS source_caller, t.caller AS sink_caller FROM uses s JOIN uses t ON t.item_id = s.item_id JOIN all_paths p ON p.item_id = s.item_id AND p.a = s.caller AND p.b = t.caller WHERE s.api IN ('__k7', '__k3') AND t.api IN ('__k1', '__k7') AND (s.api = t.api OR t.api <> '__k7')", CODE_SQL + ", all_paths AS (SELECT item_id, src AS a, src AS b FROM edges UNION SELECT item_id, dst, dst FROM edges UNION SELECT c.item_id, c.a, e.dst FROM all_paths c JOIN edges e ON e.item_id = c.item_id AND e.src = c.b)")
def j1(spark, d):
    f = Facts(spark, d)
    roles = facts.roles(spark, [("121", a, "source", "") for a in SOURCES] + [("121", a, "sink", "") for a in SINKS])
    callers = f.uses.join(_apis(spark, SOURCES), "api", "left_semi").select("item_id", F.col("caller").alias("name")).distinct()
    paths = graph.reachable_pairs(f.edges, callers)
    return relational.source_sink_pairs(f.uses, roles, paths).select("item_id", "source_api", "sink_api", "source_caller", "sink_caller")


@query("j2_api_callers", "SELECT item_id, api, string_agg(caller, ',' ORDER BY caller) AS callers FROM uses GROUP BY ALL", CODE_SQL)
def j2(spark, d):
    return relational.api_callers(Facts(spark, d).uses).select("item_id", "api", F.array_join("callers", ",").alias("callers"))


@query("j3_sink_paths", "SELECT p.item_id, u.api AS sink_api, p.last AS sink_caller, array_to_string(p.path, '->') AS path FROM paths p JOIN uses u ON u.item_id = p.item_id AND u.caller = p.last WHERE u.api IN ('__k1', '__k7')", CODE_SQL + PATHS_SQL)
def j3(spark, d):
    f = Facts(spark, d)
    return relational.sink_paths(f.uses, _apis(spark, SINKS), f.paths).withColumn("path", _text())


@query("j4_capped_paths", "SELECT item_id, sink_api, sink_caller, array_to_string(path, '->') AS path FROM (SELECT p.item_id, u.api AS sink_api, p.last AS sink_caller, p.path, row_number() OVER (PARTITION BY p.item_id, p.last, u.api ORDER BY len(p.path), p.path) AS k FROM paths p JOIN uses u ON u.item_id = p.item_id AND u.caller = p.last WHERE u.api IN ('__k1', '__k7')) WHERE k <= 5", CODE_SQL + PATHS_SQL)
def j4(spark, d):
    f = Facts(spark, d)
    found = relational.sink_paths(f.uses, _apis(spark, SINKS), f.paths)
    return relational.capped_paths(found, 5).withColumn("path", _text())


@query("j4_first_paths", "SELECT item_id, last AS \"end\", array_to_string(path, '->') AS path FROM (SELECT *, row_number() OVER (PARTITION BY item_id, last ORDER BY len(path), path) AS k FROM paths WHERE last IN ('error', 'purchase') AND NOT list_has_any(path[1:len(path) - 1], ['error', 'purchase'])) WHERE k <= 2", PATHS_SQL)
def j4_first(spark, d):
    f = Facts(spark, d)
    ends = graph.nodes(f.edges).where(F.col("name").isin(*SINK_NAMES)).unionByName(f.starts.where(F.col("name").isin(*SINK_NAMES)))
    return graph.first_paths(f.edges, f.starts, ends, 2).select("item_id", "end", _text().alias("path"))


@query("j6_alias_lookup", "SELECT DISTINCT a.item_id, a.fn AS name, coalesce(x.n, y.n) AS n FROM ev a LEFT JOIN (SELECT item_id, fn, count(*) AS n FROM ev WHERE k > 50 GROUP BY ALL) x ON x.item_id = a.item_id AND x.fn = a.fn LEFT JOIN (SELECT item_id, count(*) AS n FROM ev WHERE k > 50 AND fn = 'view' GROUP BY ALL) y ON y.item_id = a.item_id")
def j6(spark, d):
    ev = Facts(spark, d).events
    names = ev.select("item_id", F.col("fn").alias("name")).distinct()
    lists = ev.groupBy("item_id", F.col("fn").alias("name")).agg(F.collect_list(F.when(F.col("k") > 50, F.col("k"))).alias("ks"))
    alias = names.select("item_id", "name", F.lit("view").alias("real"))
    return relational.with_alias(names, lists, alias, "ks").select("item_id", "name", F.when(F.col("ks").isNotNull(), F.size("ks").cast("long")).alias("n"))


@query("j7_local_lookup", "SELECT a.item_id, a.fn AS func, b.k IS NULL AS not_found, b.k AS lvar_size FROM (SELECT DISTINCT item_id, fn FROM ev) a LEFT JOIN (SELECT item_id, fn, min(k) AS k FROM ev WHERE k % 2 = 1 GROUP BY ALL) b ON b.item_id = a.item_id AND b.fn = a.fn")
def j7(spark, d):
    ev = Facts(spark, d).events
    asked = ev.select("item_id", F.col("fn").alias("func"), F.lit("odd").alias("var")).distinct()
    locals_ = ev.where("k % 2 = 1").groupBy("item_id", F.col("fn").alias("func")).agg(F.min("k").alias("lvar_size")).withColumn("var", F.lit("odd")).withColumn("lvar_idx", F.lit(0))
    return relational.local_lookup(asked, locals_).select("item_id", "func", "not_found", "lvar_size")


@query("j8_global_lookup", "SELECT a.item_id, a.fn AS var, coalesce(b.type, 'UnknownGlobalVar') AS type, coalesce(b.size_bytes, -1) AS size_bytes FROM (SELECT DISTINCT item_id, fn FROM ev) a LEFT JOIN (SELECT item_id, fn, 'int' AS type, max(k) AS size_bytes FROM ev WHERE k > 80 GROUP BY ALL) b ON b.item_id = a.item_id AND b.fn = a.fn")
def j8(spark, d):
    ev = Facts(spark, d).events
    known = ev.where("k > 80").groupBy("item_id", F.col("fn").alias("name")).agg(F.max("k").alias("size_bytes")).withColumn("type", F.lit("int"))
    return relational.global_lookup(ev.select("item_id", F.col("fn").alias("var")).distinct(), known).select("item_id", "var", "type", "size_bytes")


@query("j10_append_new", "SELECT item_id, array_to_string(path, '->') AS chain FROM paths", PATHS_SQL)
def j10(spark, d):
    # Short chains are known; all come twice again, and each item gets its own longer ones once.
    paths = Facts(spark, d).paths.select("item_id", F.col("path").alias("call_chain"), F.size("path").alias("seq"))
    got = relational.append_new(paths.where(F.size("call_chain") <= 2), paths.unionByName(paths))
    return got.select("item_id", _text("call_chain").alias("chain"))


@query("j11_without_prefixes", "SELECT item_id, array_to_string(path, '->') AS path FROM paths p WHERE NOT EXISTS (SELECT 1 FROM paths q WHERE q.item_id = p.item_id AND len(q.path) > len(p.path) AND q.path[1:len(p.path)] = p.path)", PATHS_SQL)
def j11(spark, d):
    paths = Facts(spark, d).paths.select("item_id", "path")
    return relational.without_prefixes(paths).select("item_id", _text().alias("path"))


@query("d2_first_call", "SELECT item_id, callee, min(ln) AS ln FROM calls GROUP BY ALL")
def d2(spark, d):
    return relational.first_by(Facts(spark, d).calls, ["item_id", "callee"], ["ln", "caller"]).select("item_id", "callee", "ln")


@query("d7_unique_names", "SELECT item_id, ln, CASE WHEN row_number() OVER w = 1 THEN fn ELSE fn || '_' || row_number() OVER w END AS unique_name FROM ev WINDOW w AS (PARTITION BY item_id, fn ORDER BY ln)")
def d7(spark, d):
    ev = Facts(spark, d).events
    return relational.unique_names(ev.select("item_id", F.col("fn").alias("name"), F.col("ln").alias("off"))).select("item_id", F.col("off").alias("ln"), "unique_name")


def _leads(f: Facts, spark) -> DataFrame:
    return stored(leads.sink_leads(f.uses, _apis(spark, SINKS), f.edges, f.entries, f.code), "leads")


# The path stops at its first sink caller; equal leaf bodies under equal prefixes keep one lead.
LEADS_SQL = """,
ends AS (SELECT DISTINCT item_id, caller AS name FROM uses WHERE api IN ('__k1', '__k7')),
stops AS (SELECT item_id, [entry] AS path, entry AS last, entry IN (SELECT name FROM ends e WHERE e.item_id = entries.item_id) AS stop FROM entries
  UNION ALL SELECT p.item_id, list_append(p.path, e.dst), e.dst, e.dst IN (SELECT name FROM ends x WHERE x.item_id = p.item_id) FROM stops p JOIN edges e ON e.item_id = p.item_id AND e.src = p.last WHERE NOT p.stop AND NOT list_contains(p.path, e.dst)),
raw AS (SELECT s.item_id, s.path, s.last, u.api FROM stops s JOIN uses u ON u.item_id = s.item_id AND u.caller = s.last WHERE s.stop AND u.api IN ('__k1', '__k7')),
bodied AS (SELECT r.*, substr(c.pcode, strpos(c.pcode, chr(10)) + 1) AS body FROM raw r JOIN code c ON c.item_id = r.item_id AND c.func = r.last)
"""


FIRST_LEAF = "row_number() OVER (PARTITION BY item_id, path[1:len(path) - 1], body ORDER BY len(path), path, api) = 1"


@query("l1_sink_leads", f"SELECT item_id, api AS sink_api, array_to_string(path, '->') AS chain, len(path) AS n_code FROM bodied QUALIFY {FIRST_LEAF}", CODE_SQL + LEADS_SQL)
def l1(spark, d):
    return _leads(Facts(spark, d), spark).select("item_id", "sink_api", _text("call_chain").alias("chain"), F.size(F.array_compact("pcode_list")).cast("long").alias("n_code"))


WRITES = "len(list_filter(string_split(pcode, chr(10)), lambda x: regexp_matches(x, '^\\s*[^=]+ = .+') AND NOT regexp_matches(x, '^\\s*[^=]+ = (0($|;)|0x0($|;)|0\\.0($|;)|0d($|;)|__readfsqword)'))) > 0"


@query("l2_write_leads", f"SELECT item_id, last AS sink_caller, array_to_string(path, '->') AS chain FROM bodied QUALIFY {FIRST_LEAF}", CODE_SQL + f""",
ends AS (SELECT item_id, func AS name FROM code WHERE {WRITES}),
stops AS (SELECT item_id, [entry] AS path, entry AS last, entry IN (SELECT name FROM ends e WHERE e.item_id = entries.item_id) AS stop FROM entries
  UNION ALL SELECT p.item_id, list_append(p.path, e.dst), e.dst, e.dst IN (SELECT name FROM ends x WHERE x.item_id = p.item_id) FROM stops p JOIN edges e ON e.item_id = p.item_id AND e.src = p.last WHERE NOT p.stop AND NOT list_contains(p.path, e.dst)),
bodied AS (SELECT s.item_id, s.path, s.last, '' AS api, substr(c.pcode, strpos(c.pcode, chr(10)) + 1) AS body FROM stops s JOIN code c ON c.item_id = s.item_id AND c.func = s.last WHERE s.stop)
""")
def l2(spark, d):
    f = Facts(spark, d)
    return leads.write_leads(f.edges, f.entries, f.code).select("item_id", "sink_caller", _text("call_chain").alias("chain"))


@query("l3_fallback", "SELECT n.item_id, coalesce((SELECT bool_and(api IN ('__k7', '__k3')) FROM raw r WHERE r.item_id = n.item_id), true) AS fallback FROM entries n", CODE_SQL + LEADS_SQL)
def l3(spark, d):
    f = Facts(spark, d)
    callers = f.uses.join(_apis(spark, SINKS), "api", "left_semi").select("item_id", F.col("caller").alias("name")).distinct()
    paths = graph.shortest_paths(f.edges, f.starts, callers)  # whether there is a lead needs one path only
    return leads.needs_fallback(relational.sink_paths(f.uses, _apis(spark, SINKS), paths), f.entries, _apis(spark, SOURCES))


@query("l4_static_leads", "SELECT item_id, array_to_string(path, '->') AS chain FROM (SELECT p.item_id, p.path, row_number() OVER (PARTITION BY p.item_id ORDER BY len(p.path), p.path) AS k FROM stop2 p WHERE p.last = 'purchase') WHERE k <= 20", ", stop2 AS (SELECT item_id, [entry] AS path, entry AS last FROM entries UNION ALL SELECT p.item_id, list_append(p.path, e.dst), e.dst FROM stop2 p JOIN edges e ON e.item_id = p.item_id AND e.src = p.last WHERE p.last <> 'purchase' AND NOT list_contains(p.path, e.dst))")
def l4(spark, d):
    f = Facts(spark, d)
    sinks = f.entries.select("item_id", F.lit("purchase").alias("caller"), F.lit("popen").alias("api"))
    return leads.static_leads(sinks, f.edges, f.entries, f.code).select("item_id", _text("call_chain").alias("chain"))


@query("l5_edge_leads", "SELECT p.item_id, s.api AS source_api, t.api AS sink_api, array_to_string(p.path, '->') AS chain FROM froms p JOIN uses s ON s.item_id = p.item_id AND s.caller = p.path[1] JOIN uses t ON t.item_id = p.item_id AND t.caller = p.last WHERE s.api IN ('__k7', '__k3') AND t.api IN ('__k1', '__k7') AND (s.api = t.api OR t.api <> '__k7')", CODE_SQL + """,
froms AS (SELECT DISTINCT item_id, [caller] AS path, caller AS last FROM uses WHERE api IN ('__k7', '__k3')
  UNION ALL SELECT p.item_id, list_append(p.path, e.dst), e.dst FROM froms p JOIN edges e ON e.item_id = p.item_id AND e.src = p.last WHERE NOT list_contains(p.path, e.dst))
""")
def l5(spark, d):
    f = Facts(spark, d)
    roles = facts.roles(spark, [("121", a, "source", "") for a in SOURCES] + [("121", a, "sink", "") for a in SINKS])
    return leads.edge_leads(f.uses, roles, f.edges).select("item_id", "source_api", "sink_api", _text("call_chain").alias("chain"))


@query("l6_first_confirmed", "SELECT item_id, event_id, coalesce(event_id <= min(CASE WHEN fn = 'error' THEN event_id END) OVER (PARTITION BY item_id), true) AS evaluated FROM ev")
def l6(spark, d):
    ev = Facts(spark, d).events
    return gating.first_confirmed(ev.select("item_id", "event_id", (F.col("fn") == "error").alias("is_vuln")), "event_id").select("item_id", "event_id", "evaluated")


def _gate_facts(f: Facts) -> tuple[DataFrame, DataFrame, DataFrame]:
    chains = f.paths.select("item_id", F.col("path").alias("call_chain")).withColumn("lead_id", F.concat_ws(":", "item_id", _text("call_chain")))
    locals_ = f.events.select("item_id", F.col("fn").alias("func"), F.when(F.col("k") <= 90, F.col("k")).alias("reg_id"))
    refs = f.events.where("k < 10").select("item_id", F.col("fn").alias("function_name"))
    return chains, locals_, refs


GATES_SQL = """,
fn AS (SELECT item_id, item_id || ':' || array_to_string(path, '->') AS lead_id, unnest(path) AS func FROM paths),
flags AS (SELECT lead_id, bool_or(EXISTS (SELECT 1 FROM calls c WHERE c.item_id = fn.item_id AND c.caller = fn.func AND c.call_type = 'INDIRECT')) AS has_indirect,
  bool_or(EXISTS (SELECT 1 FROM ev e WHERE e.item_id = fn.item_id AND e.fn = fn.func AND e.k > 90)) AS has_stack,
  bool_or(EXISTS (SELECT 1 FROM ev e WHERE e.item_id = fn.item_id AND e.fn = fn.func AND e.k < 10)) AS has_global,
  bool_or(EXISTS (SELECT 1 FROM calls c WHERE c.item_id = fn.item_id AND c.caller = fn.func AND c.cat = 'USER_DEF')) AS has_inner,
  bool_or(EXISTS (SELECT 1 FROM code c WHERE c.item_id = fn.item_id AND c.func = fn.func AND contains(c.pcode, ' alloca('))) AS has_alloca FROM fn GROUP BY lead_id)
"""


@query("p8_lead_gates", "SELECT lead_id, has_indirect, has_stack, has_global, has_inner, has_alloca FROM flags", CODE_SQL + PATHS_SQL + GATES_SQL)
def p8(spark, d):
    f = Facts(spark, d)
    chains, locals_, refs = _gate_facts(f)
    return relational.lead_gates(chains, f.calls.withColumns({"call_type": F.lower("call_type"), "cat": F.lower("cat")}), locals_, refs, f.code)


@query(
    "o1_o3_gates",
    """SELECT lead_id, array_to_string(o1, ',') AS o1, array_to_string(o2, ',') AS o2, array_to_string(o3, ',') AS o3, array_to_string(o4, ',') AS o4, CAST(min(bit_count(b)) AS INTEGER) AS least_size FROM (
    SELECT f.lead_id, list_filter([CASE WHEN has_indirect THEN 'inner_call' END], lambda x: x IS NOT NULL) AS o1,
    list_filter([CASE WHEN has_global THEN 'global_var' END, CASE WHEN has_inner THEN 'fetch_pcode' END, CASE WHEN has_stack THEN 'stack_lvar' END], lambda x: x IS NOT NULL) AS o2,
    list_filter([CASE WHEN has_global THEN 'global_var' END, CASE WHEN has_inner THEN 'fetch_pcode' END], lambda x: x IS NOT NULL) AS o3,
    list_filter([CASE WHEN has_stack THEN 'stack_lvar' END, CASE WHEN has_alloca THEN 'fetch_disasm' END], lambda x: x IS NOT NULL) AS o4,
    has_stack, has_alloca, b, list_filter([CASE WHEN b & 1 > 0 THEN 'fetch_disasm' END, CASE WHEN b & 2 > 0 THEN 'fetch_pcode' END, CASE WHEN b & 4 > 0 THEN 'global_var' END, CASE WHEN b & 8 > 0 THEN 'inner_call' END, CASE WHEN b & 16 > 0 THEN 'stack_lvar' END], lambda x: x IS NOT NULL) AS s
    FROM flags f, range(32) t(b))
    WHERE (len(o1) = 0 OR list_has_any(o1, s)) AND (len(o2) = 0 OR list_has_any(o2, s)) AND (len(o3) = 0 OR list_has_any(o3, s)) AND (len(o4) = 0 OR list_has_any(o4, s)) AND (NOT has_stack OR list_contains(s, 'stack_lvar')) AND (NOT has_alloca OR list_contains(s, 'fetch_disasm')) GROUP BY ALL""",
    CODE_SQL + PATHS_SQL + GATES_SQL,
)
def o1(spark, d):
    f = Facts(spark, d)
    chains, locals_, refs = _gate_facts(f)
    flags = relational.lead_gates(chains, f.calls.withColumns({"call_type": F.lower("call_type"), "cat": F.lower("cat")}), locals_, refs, f.code).withColumn("cwe", F.lit("121"))
    got = gating.least_cover(gating.gates(flags))
    return got.select("lead_id", *[F.array_join(k, ",").alias(k.lower()) for k in gating.KEYS], "least_size")


@query("o4_refill", "SELECT lead_id, CASE WHEN has_global OR has_inner OR has_stack THEN 3 ELSE 0 END AS n2, CASE WHEN has_stack OR has_alloca THEN 2 ELSE 0 END AS n4 FROM flags", CODE_SQL + PATHS_SQL + GATES_SQL)
def o4(spark, d):
    f = Facts(spark, d)
    chains, locals_, refs = _gate_facts(f)
    flags = relational.lead_gates(chains, f.calls.withColumns({"call_type": F.lower("call_type"), "cat": F.lower("cat")}), locals_, refs, f.code).withColumn("cwe", F.lit("121"))
    return gating.refill(gating.gates(flags)).select("lead_id", F.size("O2").alias("n2"), F.size("O4").alias("n4"))


@query("a8_feature_counter")
def a8(spark, d):
    return _counter(spark, d)


def _counter(spark, d) -> DataFrame:
    f = Facts(spark, d)
    edges = f.calls.where("cat = 'USER_DEF'").select("item_id", F.col("caller").alias("src"), F.col("callee").alias("dst"))
    bits = f.entries.select("item_id", F.when(F.col("item_id") % 2 == 0, 64).otherwise(32).alias("bits"))
    tokens = f.events.select("item_id", F.col("fn").alias("func"), F.col("ln").alias("pos"), F.concat(F.lit("T"), F.col("k") % 6).alias("token"))
    return features.feature_counter(bits, _wl(f), graph.degrees(edges), graph.dag_metrics(f.edges, f.entries), aggregates.size_stats(f.sizes), f.sizes, aggregates.import_counts(f.calls), tokens, facts.api_categories(spark))


HASH_SQL = """,
apis AS (SELECT item_id, 'API:__k' || substr(callee, 5) AS feature, 2.0 * count(*) AS w FROM calls WHERE cat = 'IMPORT_API' GROUP BY ALL),
h AS (SELECT item_id, w, md5(feature) AS m FROM apis),
vec AS (SELECT item_id, CAST(('0x' || m[7:8] || m[5:6] || m[3:4] || m[1:2]) AS BIGINT) % 64 AS idx, sum(CASE WHEN CAST('0x' || m[10:10] AS BIGINT) % 2 = 0 THEN w ELSE -w END) AS val FROM h GROUP BY ALL HAVING val <> 0)
"""


def _api_vectors(spark, d) -> DataFrame:
    apis = aggregates.import_counts(Facts(spark, d).calls).select("item_id", F.concat(F.lit("API:"), "api").alias("feature"), (F.col("n") * 2.0).alias("w"))
    return features.hashed(apis, 64)


@query("v1_feature_hashing", "SELECT item_id, idx, CAST(val AS DOUBLE) AS val FROM vec", HASH_SQL)
def v1(spark, d):
    return _api_vectors(spark, d)


@query("a9_document_frequency", "SELECT idx, count(*) AS df FROM vec GROUP BY idx", HASH_SQL)
def a9(spark, d):
    return features.document_frequency(_api_vectors(spark, d))


@query("v2_idf_normalised", ", n AS (SELECT count(DISTINCT item_id) AS n FROM vec), f AS (SELECT idx, count(*) AS df FROM vec GROUP BY idx), x AS (SELECT item_id, idx, val * (ln((1.0 + n) / (1 + df)) + 1) AS v FROM vec JOIN f USING (idx), n) SELECT item_id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS val FROM x", HASH_SQL)
def v2(spark, d):
    vec = stored(_api_vectors(spark, d), "v2")
    return features.idf_normalised(vec, vec.select("item_id").distinct().count()).withColumn("val", F.round("val", 6))


@query("v3_cluster_key", "SELECT n.item_id, 'B' || CASE WHEN n.item_id % 2 = 0 THEN 64 ELSE 32 END || '|WL' || wl AS cluster FROM entries n JOIN wl USING (item_id)", WL_SQL)
def v3(spark, d):
    f = Facts(spark, d)
    bits = f.entries.select("item_id", F.when(F.col("item_id") % 2 == 0, 64).otherwise(32).alias("bits"))
    return features.cluster_key(bits, _wl(f))


@query("v7_stratified_sample")
def v7(spark, d):
    f = Facts(spark, d)
    bits = stored(f.entries.select("item_id", F.when(F.col("item_id") % 2 == 0, 64).otherwise(32).alias("bits")), "v7-bits")
    counter = stored(_counter(spark, d), "v7-counter")
    vec = stored(features.idf_normalised(features.hashed(counter, 256), bits.count()), "v7-vec")
    clusters = stored(bits.select("item_id", F.concat(F.lit("B"), F.col("bits").cast("string"), F.lit("|"), F.col("item_id") % 7).alias("cluster")), "v7-clusters")
    return features.stratified_sample(vec, clusters, bits, 20)


