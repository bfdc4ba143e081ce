"""Queries over the other tables: code text, names, runs, dialogue, vectors and offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import exprs
from factweave.operators import aggregates, features, gating, relational, reports
from factweave.sources.facts import table
from factweave.sources.store import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _runs(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))
    return o.select("o_orderkey", (F.col("o_orderstatus") != "F").alias("ok"), kind.alias("error_type"), (F.floor(F.col("o_totalprice") / 1000) % 3).cast("long").alias("vuln_count"))


RUNS = "(SELECT o_orderkey, o_orderstatus <> 'F' AS ok, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS error_type, CAST(floor(o_totalprice / 1000) AS BIGINT) % 3 AS vuln_count FROM orders)"


@query("a1_batch_summary", f"SELECT count(*) AS processed, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, CAST(sum(CASE WHEN ok THEN vuln_count END) AS BIGINT) AS total_vulns, count(*) FILTER (ok AND vuln_count > 0) AS samples_with_vulns FROM {RUNS}")
def a1(spark, d):
    return aggregates.batch_summary(_runs(spark, d))


@query("a1_error_histogram", f"SELECT coalesce(error_type, 'UnknownError') AS error_type, count(*) AS n FROM {RUNS} WHERE NOT ok GROUP BY 1")
def a1_errors(spark, d):
    return aggregates.error_histogram(_runs(spark, d))


@query("a2_merge_imports", "SELECT func, r.lib AS lib, r.proto AS proto FROM (SELECT func, list_reduce(list({'lib': lib, 'proto': proto} ORDER BY path, pos), lambda o, n: CASE WHEN len(trim(n.proto)) > len(trim(o.proto)) THEN n WHEN trim(o.lib) IN ('dynsym', '.dynsym') AND trim(n.lib) NOT IN ('', 'dynsym', '.dynsym') THEN n ELSE o END) AS r FROM (SELECT split_part(p_name, ' ', 1) AS func, CASE p_size % 5 WHEN 0 THEN 'dynsym' WHEN 1 THEN ' .dynsym ' WHEN 2 THEN '' ELSE p_brand END AS lib, CASE WHEN p_size % 2 = 0 THEN '   ' ELSE substr(p_type, 1, 4 + p_size % 3) END AS proto, p_type AS path, p_partkey AS pos FROM part) GROUP BY func)")
def a2(spark, d):
    # Few different entries a name, so that the same ones come again and again.
    p = table(spark, d, "part")
    lib = F.when(F.col("p_size") % 5 == 0, "dynsym").when(F.col("p_size") % 5 == 1, " .dynsym ").when(F.col("p_size") % 5 == 2, "").otherwise(F.col("p_brand"))
    proto = F.when(F.col("p_size") % 2 == 0, "   ").otherwise(F.substring(F.col("p_type"), F.lit(1), 4 + F.col("p_size") % 3))
    return aggregates.merge_imports(p.select(F.substring_index("p_name", " ", 1).alias("func"), lib.alias("lib"), proto.alias("proto"), F.col("p_type").alias("path"), F.col("p_partkey").alias("pos")))


@query("k3_import_list", "SELECT split_part(p_name, ' ', 1) AS func, '{\"lib\":\"' || max(p_brand) || '\",\"proto\":\"' || max(p_type) || '\"}' AS json FROM part GROUP BY 1")
def k3(spark, d):
    catalog = table(spark, d, "part").groupBy(F.substring_index("p_name", " ", 1).alias("func")).agg(F.max("p_brand").alias("lib"), F.max("p_type").alias("proto"))
    return reports.import_map(catalog, as_list=True)


@query("k6_result_name", "SELECT o_custkey, 'prog_' || string_agg(o_orderpriority, '+' ORDER BY k) || '.json' AS file_name FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_custkey")
def k6(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    return lists.select("o_custkey", reports.result_name(F.lit("prog"), F.col("l.o_orderpriority")).alias("file_name"))


@query("k7_digest", "SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents")
def k7(spark, d):
    return table(spark, d, "documents").select("doc_id", reports.digest64(F.col("text")).alias("digest"))


@query("k10_gaps", "SELECT l_orderkey, l_linenumber, l_partkey - e AS gap, coalesce(l_partkey < e, false) AS overlap FROM (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey + CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, CAST(l_quantity AS BIGINT), l_linenumber) AS e FROM lineitem)")
def k10(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("off"), F.col("l_quantity").cast("long").alias("size"))
    return relational.gaps(li, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "gap", "overlap")


@query("f1_norm_api", "SELECT p_partkey, CASE WHEN x LIKE '\\_Z%' ESCAPE '\\' OR x LIKE '\\_\\_%' ESCAPE '\\' THEN x ELSE regexp_replace(x, '^_', '') END AS api FROM (SELECT p_partkey, regexp_replace(repeat('_', CAST(p_size % 5 AS INTEGER)) || CASE WHEN p_size % 7 = 0 THEN 'Z' ELSE '' END || p_name, '^_{3,}', '__') AS x FROM part)")
def f1(spark, d):
    name = F.concat(F.expr("repeat('_', p_size % 5)"), F.when(F.col("p_size") % 7 == 0, "Z").otherwise(""), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", exprs.norm_api(name).alias("api"))


@query("f3_bucket_log2", "SELECT o_orderkey, CASE WHEN v <= 0 THEN 0 ELSE CAST(floor(log2(v)) AS BIGINT) + 1 END AS b FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS v FROM orders)")
def f3(spark, d):
    return table(spark, d, "orders").select("o_orderkey", exprs.bucket_log2(F.floor("o_totalprice").cast("long") % 5000).alias("b"))


@query("f4_hash_feature", "SELECT doc_id, CAST('0x' || m[7:8] || m[5:6] || m[3:4] || m[1:2] AS BIGINT) % 4096 AS idx, CASE WHEN CAST('0x' || m[10:10] AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM (SELECT doc_id, md5(text) AS m FROM documents)")
def f4(spark, d):
    idx, sign = exprs.hash_feature(F.col("text"), 4096)
    return table(spark, d, "documents").select("doc_id", idx.alias("idx"), sign.alias("sign"))


OPERANDS = "(SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN '' WHEN 1 THEN '[rbp-8]' WHEN 2 THEN 'fs:28h' WHEN 3 THEN '-0x1F' WHEN 4 THEN 'eax' WHEN 5 THEN 'loc_' || p_size WHEN 6 THEN 'xmm3' ELSE '9zz' END AS op FROM part)"


@query("f5_operand_type", f"SELECT p_partkey, CASE WHEN op = '' THEN 'NONE' WHEN op LIKE '%[%' OR op LIKE '%]%' OR regexp_matches(op, '(?i)^[a-z]{{1,3}}:') THEN 'MEM' WHEN regexp_matches(op, '^-?(0x[0-9a-fA-F]+|[0-9]+)$') THEN 'IMM' WHEN op IN ('eax', 'xmm3') THEN 'REG' WHEN op LIKE 'loc\\_%' ESCAPE '\\' THEN 'SYM' ELSE 'OTHER' END AS kind FROM {OPERANDS}")
def f5(spark, d):
    op = F.expr("case p_size % 8 when 0 then '' when 1 then '[rbp-8]' when 2 then 'fs:28h' when 3 then '-0x1F' when 4 then 'eax' when 5 then concat('loc_', p_size) when 6 then 'xmm3' else '9zz' end")
    return table(spark, d, "part").select("p_partkey", exprs.operand_type(op).alias("kind"))


@query("f6_insn_tokens", "SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (tok = 'JCC') AS n_jcc, count(*) FILTER (tok = '') AS n_blank FROM (SELECT doc_id, CASE WHEN m IN ('jmp', 'jmpq', 'jmpl') THEN 'JMP' WHEN m[1:1] = 'j' THEN 'JCC' ELSE m END AS tok FROM (SELECT doc_id, line, lower(regexp_extract(line, '^([^ \\t]+)', 1)) AS m FROM (SELECT doc_id, trim(regexp_replace(trim(chr(9) || unnest(string_split(text, chr(10))) || chr(9), ' ' || chr(9) || chr(13)), ';.*$', ''), ' ' || chr(9) || chr(13)) AS line FROM documents) WHERE line <> '' AND line NOT LIKE '%:' AND line NOT LIKE '.%') WHERE m <> 'nop' AND NOT regexp_matches(m, '^(loc_|sub_|off_)')) GROUP BY doc_id")
def f6(spark, d):
    code = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.lit("f").alias("func"), F.regexp_replace("text", "(?m)^(.*)$", "\t$1\t").alias("disasm"))
    none = spark.createDataFrame([], "item_id bigint, api string"), spark.createDataFrame([], "item_id bigint, name string")
    return exprs.insn_tokens(code, *none).groupBy(F.col("item_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("token") == "JCC").alias("n_jcc"), F.count_if(F.col("token") == "").alias("n_blank"))


@query("a7_token_histogram", "SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY ALL")
def a7(spark, d):
    words = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.lit("f").alias("func"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return aggregates.token_histogram(words).select(F.col("item_id").alias("doc_id"), "token", "n")


@query("f10_clean_symbol", "SELECT p_partkey, CASE WHEN regexp_matches(x, '^[0-9]') THEN 'f_' || x ELSE x END AS name FROM (SELECT p_partkey, regexp_replace(CASE WHEN p_size % 2 = 0 THEN p_size || p_name ELSE p_name END, '[^A-Za-z0-9_]', '_', 'g') AS x FROM part)")
def f10(spark, d):
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", exprs.clean_symbol(name).alias("name"))


@query("f20_chunks", "SELECT o_orderkey, CAST(ntile(7) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS chunk FROM orders")
def f20(spark, d):
    return exprs.chunks(table(spark, d, "orders"), 7, "o_orderkey", by=("o_orderpriority",)).select("o_orderkey", "chunk")


@query("d5_body", "SELECT doc_id, md5(trim(array_to_string(CASE WHEN regexp_matches(l[1], '^[^;{=]*\\([^;]*\\)\\s*\\{?\\s*$') THEN l[2:] ELSE l END, chr(10)), ' ' || chr(9) || chr(10) || chr(13))) AS h FROM (SELECT doc_id, string_split(text || chr(10) || chr(9), chr(10)) AS l FROM documents)")
def d5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(relational.body(F.concat("text", F.lit("\n\t")))).alias("h"))


@query("f12_json_text", "SELECT event_id, props AS json FROM events")
def f12(spark, d):
    ev = table(spark, d, "events").select("event_id", F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```")).alias("reply"))
    return exprs.json_objects(ev, "reply", "json").select("event_id", "json")


@query("f13_first_object", "SELECT event_id, props AS json FROM events")
def f13(spark, d):
    ev = table(spark, d, "events").select("event_id", F.concat(F.lit("{\"k\": 0} before </think> <think>{}</think> {bad} "), "props", F.lit(" tail")).alias("reply"))
    return exprs.json_objects(ev, "reply", "json", ("k",)).select("event_id", "json")


def _dialogue(spark, d):
    """Turns with statuses that depend on their text, and an evidence row a turn."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("lead_id"), F.col("turn").cast("int").alias("turn"), F.length("text").cast("int").alias("n"), "role")
    word = lambda m: F.when(F.col("n") % m == 0, "Satisfied").when(F.col("n") % (m + 3) == 1, "Violated").otherwise("Unknown")
    turns = c.select("lead_id", "turn", *[word(m).alias(k) for k, m in zip(gating.KEYS, (2, 3, 4, 5), strict=True)], F.array((F.col("n") % 4)).cast("array<int>").alias("update_from"))
    evidence = c.select("lead_id", F.col("turn").alias("evid_id"), F.when(F.col("role") == "user", "fetch_pcode").otherwise("stack_lvar").alias("type"))
    gated = c.select("lead_id").distinct().select("lead_id", *[F.array(*[F.lit(x) for x in gating.TEMPLATE[k]]).alias(k) for k in gating.KEYS])
    return turns, evidence, gated


def _status(m: int) -> str:
    return f"CASE WHEN n % {m} = 0 THEN 'Satisfied' WHEN n % {m + 3} = 1 THEN 'Violated' ELSE 'Unknown' END"


@query(
    "o7_gated_replay",
    f"""WITH RECURSIVE c AS (SELECT conv_id AS lead_id, CAST(turn AS INTEGER) AS turn, length(text) AS n, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    t AS (SELECT c.*, [{', '.join(_status(m) for m in (2, 3, 4, 5))}] AS st, (SELECT CASE WHEN e.role = 'user' THEN 'fetch_pcode' ELSE 'stack_lvar' END FROM c e WHERE e.lead_id = c.lead_id AND e.turn = c.n % 4 AND e.turn <= c.turn) AS got FROM c),
    f AS (SELECT lead_id, i, turn, st, true AS accepted, false AS gating_flag FROM t WHERE i = 1
      UNION ALL SELECT t.lead_id, t.i, t.turn, CASE WHEN ok THEN t.st ELSE prev END, ok, flag OR NOT ok FROM (SELECT t.*, f.st AS prev, f.gating_flag AS flag,
        len(list_filter([1, 2, 3, 4], lambda x: f.st[x] = 'Unknown' AND t.st[x] <> 'Unknown')) = 0 OR (t.got IS NOT NULL AND len(list_filter([1, 2, 3, 4], lambda x: f.st[x] = 'Unknown' AND t.st[x] <> 'Unknown' AND NOT (CASE x WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN t.got = 'fetch_pcode' ELSE t.got = 'stack_lvar' END))) = 0) AS ok
        FROM f JOIN t ON t.lead_id = f.lead_id AND t.i = f.i + 1) t)
    SELECT lead_id, turn, st[1] AS O1, st[2] AS O2, st[3] AS O3, st[4] AS O4, accepted, gating_flag FROM f""",
)
def o7(spark, d):
    return gating.replay(*_dialogue(spark, d)).drop("regressed")


@query("o6_citations", "WITH c AS (SELECT conv_id AS lead_id, CAST(turn AS INTEGER) AS turn, length(text) AS n, role FROM conversations) SELECT c.lead_id, c.turn, e.turn IS NULL AS invalid, coalesce(CASE WHEN e.role = 'user' THEN 'fetch_pcode' WHEN e.role IS NOT NULL THEN 'stack_lvar' END, '') AS kinds FROM c LEFT JOIN c e ON e.lead_id = c.lead_id AND e.turn = c.n % 4")
def o6(spark, d):
    turns, evidence, _ = _dialogue(spark, d)
    return relational.cited(turns, evidence).withColumn("kinds", F.array_join("kinds", ","))


@query("o5_changed", f"WITH c AS (SELECT conv_id, turn, n, lag(n) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT *, length(text) AS n FROM conversations)), s AS (SELECT conv_id, turn, p, {_status(2)} AS a, {_status(3)} AS b, {_status(2).replace('n %', 'p %')} AS pa, {_status(3).replace('n %', 'p %')} AS pb FROM c) SELECT conv_id AS lead_id, CAST(turn AS INTEGER) AS turn, array_to_string(list_filter([CASE WHEN (p IS NULL OR pa = 'Unknown') AND a <> 'Unknown' THEN 'O1' END, CASE WHEN (p IS NULL OR pb = 'Unknown') AND b <> 'Unknown' THEN 'O2' END], lambda x: x IS NOT NULL), ',') AS changed FROM s")
def o5(spark, d):
    from pyspark.sql import Window

    turns, _, _ = _dialogue(spark, d)
    w = Window.partitionBy("lead_id").orderBy("turn")
    now = turns.select("lead_id", "turn", F.create_map(F.lit("O1"), "O1", F.lit("O2"), "O2").alias("m"))
    none = F.create_map(F.lit("O1"), F.lit("Unknown"))
    return now.withColumn("before", F.coalesce(F.lag("m").over(w), none)).select("lead_id", "turn", F.array_join(gating.changed(F.col("before"), F.col("m")), ",").alias("changed"))


@query("o9_useful_citations", "SELECT conv_id AS lead_id, CAST(turn AS INTEGER) AS turn, CASE WHEN EXISTS (SELECT 1 FROM conversations e WHERE e.conv_id = c.conv_id AND e.turn = length(c.text) % 4 AND e.role = 'user') THEN 1 ELSE 0 END AS n FROM conversations c")
def o9(spark, d):
    turns, evidence, _ = _dialogue(spark, d)
    known = evidence.select("lead_id", "evid_id", (F.col("type") == "fetch_pcode").alias("known"))
    return gating.useful_citations(turns, known).select("lead_id", "turn", F.size("update_from").alias("n"))


@query("o10_one_shot", f"SELECT conv_id AS lead_id, {_status(2).replace('n %', 'length(text) %')} AS O1 FROM conversations WHERE turn = 0")
def o10(spark, d):
    turns, _, _ = _dialogue(spark, d)
    return gating.one_shot(turns.withColumn("valid", F.lit(True))).select("lead_id", "O1")


# Fixed values, stated once more from the definition: weakness classes and their titles.
TITLES = [("121", "Stack-based Buffer Overflow"), ("122", "Heap-based Buffer Overflow"), ("78", "OS Command Injection"), ("134", "Use of Externally-Controlled Format String"), ("789", "Memory Allocation with Excessive Size Value"), ("787", "Out-of-bounds Write"), ("125", "Out-of-bounds Read"), ("476", "NULL Pointer Dereference"), ("369", "Divide By Zero"), ("190", None)]


@query("f16_cwe_title", "SELECT p_partkey, CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN 'CWE-{c}{': ' + t if t else ''}'" for k, (c, t) in enumerate(TITLES)) + " END AS title FROM part")
def f16(spark, d):
    code = F.get(F.array(*[F.lit(c) for c, _ in TITLES]), F.col("p_partkey").cast("int") % 10)
    return table(spark, d, "part").select("p_partkey", exprs.cwe_title(code).alias("title"))


CODES = ["x = alloca(8)", "malloca(8)", "SLOBYTE (v1)", "BYTE1(v2)", "my_HIWORD(v3)", "operator  new(4)", "__readfsqword(0x28)", "DWORDn(v)"]
CODE_AT = "list_extract([" + ", ".join(f"'{c}'" for c in CODES) + "], CAST(doc_id % 8 + 1 AS INTEGER))"


@query("p12_hints", f"SELECT doc_id, cwe = '121' AND contains(t, '__readfsqword(') AS reads_guard, cwe = '121' AND regexp_matches(t, '(^|[^A-Za-z0-9])alloca\\(') AS uses_alloca, cwe = '121' AND regexp_matches(t, '(^|[^A-Za-z0-9_])S?(LO|HI)?(BYTE|WORD|DWORD)([0-9]+|n)?\\s*\\(') AS partial_word, cwe = '122' AND regexp_matches(t, 'operator\\s+new\\(') AS uses_new FROM (SELECT doc_id, text || ' ' || {CODE_AT} AS t, CASE WHEN doc_id % 3 = 0 THEN '122' ELSE '121' END AS cwe FROM documents)")
def p12(spark, d):
    docs = table(spark, d, "documents")
    said = F.concat("text", F.lit(" "), F.get(F.array(*[F.lit(c) for c in CODES]), (F.col("doc_id") % 8).cast("int")))
    h = relational.hints(said, F.when(F.col("doc_id") % 3 == 0, "122").otherwise("121"))
    return docs.select("doc_id", *[c.alias(k) for k, c in h.items()])


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    long = stored(e.select(F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("idx", "x")).select("item_id", "idx", F.col("x").cast("double").alias("val")), "vec")
    return long, e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("cluster"))


VEC = "v AS (SELECT vec_id, label, unnest(range(len(embedding))) AS idx, unnest(embedding)::DOUBLE AS val FROM embeddings), cen AS (SELECT label, idx, sum(val) / count(*) AS c FROM v GROUP BY label, idx), nrm AS (SELECT label, sqrt(sum(c * c)) AS n FROM cen GROUP BY label), dots AS (SELECT label, vec_id, sum(val * c) AS d FROM v JOIN cen USING (label, idx) GROUP BY label, vec_id), sim AS (SELECT label, vec_id, d / n AS s FROM dots JOIN nrm USING (label)), med AS (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS k FROM sim)"


@query("a10_centroids", f"WITH {VEC} SELECT label AS cluster, CAST(idx AS INTEGER) AS idx, round(c, 5) AS val, weight FROM cen JOIN (SELECT label, count(*) AS weight FROM embeddings GROUP BY label) USING (label)")
def a10(spark, d):
    v, c = _vectors(spark, d)
    return features.centroids(v, c).withColumn("val", F.round("val", 5))


@query("v5_medoids", f"WITH {VEC} SELECT label AS cluster, vec_id AS item_id, round(s, 6) AS sim FROM med WHERE k = 1")
def v5(spark, d):
    v, c = _vectors(spark, d)
    return features.medoids(v, c).withColumn("sim", F.round("sim", 6))


@query("v8_nearest_chosen", f"WITH {VEC}, m AS (SELECT vec_id AS c FROM med WHERE k = 1) SELECT a.vec_id AS item_id, round(max(d), 6) AS sim FROM (SELECT a.vec_id, b.vec_id AS c, sum(a.val * b.val) AS d FROM v a JOIN v b ON a.idx = b.idx AND b.vec_id IN (SELECT c FROM m) GROUP BY ALL) a GROUP BY a.vec_id")
def v8(spark, d):
    v, c = _vectors(spark, d)
    return features.nearest_chosen(v, features.medoids(v, c)).withColumn("sim", F.round("sim", 6))


@query("a17_coverage", f"WITH {VEC}, m AS (SELECT vec_id AS c FROM med WHERE k = 1), n AS (SELECT vec_id, max(d) AS s FROM (SELECT a.vec_id, b.vec_id AS c, sum(a.val * b.val) AS d FROM v a JOIN v b ON a.idx = b.idx AND b.vec_id IN (SELECT c FROM m) GROUP BY ALL) GROUP BY vec_id) SELECT round(avg(1 - s), 6) AS mean_dist, round(quantile_cont(1 - s, 0.5), 6) AS p50_dist, round(quantile_cont(1 - s, 0.9), 6) AS p90_dist, round(max(1 - s), 6) AS max_dist, round(avg(s), 6) AS mean_sim, round(quantile_cont(s, 0.1), 6) AS p10_sim FROM n")
def a17(spark, d):
    v, c = _vectors(spark, d)
    got = aggregates.coverage(features.nearest_chosen(v, features.medoids(v, c)))
    return got.select(*[F.round(x, 6).alias(x) for x in got.columns])


@query("v4_farthest_first")
def v4(spark, d):
    e = table(spark, d, "embeddings")
    return features.farthest_first(e.select(F.col("vec_id").alias("key"), (F.col("label") + 1.0).alias("weight"), F.col("embedding").alias("vec")), 8)


@query("v9_principal_components")
def v9(spark, d):
    return features.principal_components(table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec")))


@query("s8_digest", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def s8(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query("s9_dynsym", "SELECT p_partkey, CASE WHEN contains(x, '@@') THEN split_part(x, '@@', 2) END AS lib, split_part(x, '@@', 1) AS func FROM (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '@@' || p_brand ELSE '' END AS x FROM part)")
def s9(spark, d):
    from factweave.sources.facts import dynsym_parts

    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("@@"), "p_brand")).otherwise("")).alias("func"))
    lib, func = dynsym_parts()
    return p.select("p_partkey", lib.alias("lib"), func.alias("func"))


@query("p2_slim_code", "SELECT doc_id AS item_id, md5(text) AS disasm_md5 FROM documents")
def p2(spark, d):
    code = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.md5("text").alias("disasm_md5"), F.upper("text").alias("pcode"))
    return relational.slim(code)


@query("p7_place", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'Stack' ELSE 'Register' END AS by_distance, CASE WHEN p_size % 2 = 0 THEN 'Register' ELSE 'Stack' END AS by_register FROM part")
def p7(spark, d):
    dist, reg = F.when(F.col("p_size") % 3 != 0, F.col("p_size")), F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    a, b = relational.place(dist, reg)
    return table(spark, d, "part").select("p_partkey", a.alias("by_distance"), b.alias("by_register"))


@query("p9_socket_split", "SELECT page_id, contains(lower(url), 'example.com') AS skipped FROM pages")
def p9(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower("url").contains("example.com").alias("skipped"))


@query("p10_blank_guard", "SELECT event_id FROM events WHERE CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END <> ''")
def p10(spark, d):
    named = table(spark, d, "events").withColumn("name", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")))
    return named.where("name is not null and name <> ''").select("event_id")


@query("d1_ordered_distinct", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY k) AS seen FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_custkey")
def d1(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    return lists.select("o_custkey", F.array_join(F.array_distinct("l.o_orderpriority"), ",").alias("seen"))


@query("f2_api_category", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'mem_copy' WHEN 1 THEN 'str_len' WHEN 2 THEN 'mem_cmp' ELSE 'other' END AS category FROM part")
def f2(spark, d):
    from factweave.sources.facts import api_categories

    named = table(spark, d, "part").select("p_partkey", F.expr("case p_size % 4 when 0 then '_memcpy' when 1 then 'strlen' when 2 then 'memcmp' else 'frobnicate' end").alias("api"))
    return exprs.api_category(named, api_categories(spark)).select("p_partkey", "category")


@query("f7_strip_prefix", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(x, '^\\.', ''), '^_imp_', ''), '^__imp_', '') AS name FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '..' WHEN 1 THEN '__imp_' WHEN 2 THEN '._imp_' ELSE '' END || p_name AS x FROM part)")
def f7(spark, d):
    name = F.concat(F.expr("case p_size % 4 when 0 then '..' when 1 then '__imp_' when 2 then '._imp_' else '' end"), "p_name")
    return table(spark, d, "part").select("p_partkey", exprs.strip_prefix(name).alias("name"))


@query("f11_int_ascii", "SELECT p_partkey, CASE WHEN a BETWEEN 32 AND 126 AND b BETWEEN 32 AND 126 THEN chr(CAST(a AS INTEGER)) || chr(CAST(b AS INTEGER)) END AS text FROM (SELECT p_partkey, (256 + p_partkey % 32000) // 256 AS a, (256 + p_partkey % 32000) % 256 AS b FROM part)")
def f11(spark, d):
    return table(spark, d, "part").select("p_partkey", exprs.int_ascii(F.lit(256) + F.col("p_partkey") % 32000).alias("text"))


@query(
    "f14_evidence_text",
    """SELECT p_partkey, CASE p_size % 5
      WHEN 0 THEN p_partkey || '.stack_lvar for Function: f | Variable: v' || chr(10) || 'The local variable is stored in the ' || place || '.' || chr(10) || 'Its data type is ' || p_type || ', with a size of ' || p_size || ' bytes.' || CASE WHEN place = 'Stack' THEN chr(10) || 'It is located ' || p_size || ' bytes away from the return address and has an offset of None from the stack pointer.' ELSE '' END
      WHEN 1 THEN p_partkey || '.global_var for Variable: v' || chr(10) || 'The global variable has type ' || p_type || ' and size ' || p_size || ' bytes, located at address 0x10.' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'It is referenced by the following functions: a, ' || p_brand ELSE '' END
      WHEN 2 THEN p_partkey || '.inner_call for Function: f' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'It internally calls a, which is classified as USER_DEF.' || chr(10) || 'It internally calls ' || p_brand || ', which is classified as OTHER.' ELSE '' END
      WHEN 3 THEN p_partkey || '.fetch_pcode for Function: f' || chr(10) || 'The function''s decompiled P-code is: ' || p_name
      ELSE p_partkey || '.fetch_disasm for Function: f' || chr(10) || 'The function''s disassembly is: ' || p_name END AS said
    FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'Stack' ELSE 'Register' END AS place FROM part)""",
)
def f14(spark, d):
    kinds = ["stack_lvar", "global_var", "inner_call", "fetch_pcode", "fetch_disasm"]
    even, size = F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")
    given = {"reg_or_stack": F.when(even, "Stack").otherwise("Register"), "lvar_type": F.col("p_type"), "lvar_size": size, "dist_to_ret": size, "global_var_type": F.col("p_type"), "global_var_size": size, "addr_ea": F.lit("0x10"), "pcode": F.concat("p_name", F.lit("\n\n")), "ehasm": F.col("p_name")}
    params = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), v)])
    call = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("kind"))
    calls = F.when(even, F.array(call(F.lit("a"), "USER_DEF"), call(F.col("p_brand"), "OTHER"))).otherwise(F.array().cast("array<struct<name:string,kind:string>>"))
    refs = F.when(even, F.array(F.lit("a"), "p_brand")).otherwise(F.array().cast("array<string>"))
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), F.col("p_size").cast("int") % 5)
    return table(spark, d, "part").select("p_partkey", exprs.render_evidence(F.col("p_partkey"), kind, F.lit("f"), F.lit("v"), params, calls, refs).alias("said"))


@query("f15_import_sentences", "SELECT p_brand, string_agg('The ' || p_name || ' API comes from ' || CASE WHEN p_size % 3 = 0 THEN 'UNKNOWN' ELSE p_type END || '; its function prototype is ' || chr(39) || CASE WHEN p_size % 2 = 0 THEN 'UNKNOWN' ELSE p_type END || chr(39) || ';', chr(10) ORDER BY p_partkey) AS said FROM part GROUP BY p_brand")
def f15(spark, d):
    one = F.struct("p_partkey", F.col("p_name").alias("func"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("lib"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")).alias("proto"))
    lists = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(one)).alias("l"))
    return lists.select("p_brand", exprs.import_sentences(F.col("l")).alias("said"))


@query("f15_code_text", "SELECT conv_id, rtrim(string_agg(text, chr(10) || chr(10) ORDER BY turn), chr(10)) AS said FROM conversations GROUP BY conv_id")
def f15_code(spark, d):
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return lists.select("conv_id", exprs.code_text(F.concat(F.col("l.text"), F.array(F.lit("")))).alias("said"))


@query("f17_render", "SELECT page_id, 'Page ' || page_id || ' at ' || url || '.' AS text FROM pages")
def f17(spark, d):
    text = exprs.render("Page {{ id }} at {{ url }}.", {"id": F.col("page_id"), "url": F.col("url")})
    return table(spark, d, "pages").select("page_id", text.alias("text"))


@query("f18_signal_name", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'SIGSEGV' WHEN 1 THEN 'SIGABRT' ELSE 'SIG77' END AS name FROM part")
def f18(spark, d):
    return table(spark, d, "part").select("p_partkey", exprs.signal_name(F.expr("case p_size % 3 when 0 then 11 when 1 then 6 else 77 end")).alias("name"))


@query("f19_gate_text", "SELECT p_partkey, 'Minimum Primitive Set for Satisfying Obligation Requirements:' || chr(10) || 'O1''s minimum primitive set: [' || array_to_string(list_sort(list_distinct([p_brand, p_type, p_brand])), ', ') || ']' || chr(10) || 'O2''s minimum primitive set: [' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END || ']' AS text FROM part")
def f19(spark, d):
    gates = F.create_map(F.lit("O2"), F.when(F.col("p_size") % 2 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>")), F.lit("O1"), F.array("p_brand", "p_type", "p_brand"))
    return table(spark, d, "part").select("p_partkey", exprs.gate_text(gates).alias("text"))


@query("f22_error_hint", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || chr(10) WHEN p_size % 3 = 1 THEN p_name || chr(10) || chr(10) || 'Obligation-status update gate check failed for O2; please re-update ONLY these obligations and ensure update_from cites at least one evidence ID whose query_type matches each obligation''s minimum primitive set.' ELSE p_name || chr(10) || chr(10) || 'Obligation-status update gate check failed for O4,O1; please re-update ONLY these obligations and ensure update_from cites at least one evidence ID whose query_type matches each obligation''s minimum primitive set.' END AS text FROM part")
def f22(spark, d):
    failed = F.expr("case p_size % 3 when 0 then cast(array() as array<string>) when 1 then array('O2') else array('O4', 'O1') end")
    return table(spark, d, "part").select("p_partkey", exprs.error_hint(F.concat("p_name", F.lit("\n")), failed).alias("text"))


@query("a15_sinks_in_sources", "SELECT count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_sink_in_source, count(*) AS n_leads FROM orders")
def a15(spark, d):
    sources = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "api string")
    return aggregates.sinks_in_sources(table(spark, d, "orders").select(F.col("o_orderpriority").alias("sink_api")), sources)


@query("a18_variable_accesses", "SELECT l_orderkey, l_returnflag AS kind, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS lines FROM lineitem GROUP BY ALL")
def a18(spark, d):
    li = table(spark, d, "lineitem")
    accesses = li.select(F.col("l_orderkey").alias("item_id"), F.lit("f").alias("func"), F.lit("v").alias("var"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("citem"))
    lines = li.select(F.col("l_orderkey").alias("item_id"), F.lit("f").alias("func"), F.col("l_linenumber").alias("citem"), F.col("l_linenumber").alias("ln")).distinct()
    got = aggregates.variable_accesses(accesses, lines)
    return got.select(F.col("item_id").alias("l_orderkey"), "kind", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("k1_feature_documents", "SELECT p_partkey AS item_id, '{\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}' AS json FROM part")
def k1(spark, d):
    return reports.feature_documents(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_size"))


@query("k8_scatter", "SELECT vec_id AS item_id, round(CAST(embedding[1] AS DOUBLE), 5) AS pc1, vec_id % 10 = 0 AS selected FROM embeddings")
def k8(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.round(F.col("embedding")[0].cast("double"), 5).alias("pc1"))
    return reports.scatter(e, e.where("item_id % 10 = 0").select("item_id"))


@query("s2_class_decode", "SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN 32 WHEN 2 THEN 64 ELSE 0 END AS bits FROM part")
def s2(spark, d):
    magic = F.expr("concat(X'7F454C46', case p_size % 3 when 1 then X'01' when 2 then X'02' else X'00' end)")
    kind = F.hex(F.substring(magic, 5, 1))
    return table(spark, d, "part").select("p_partkey", F.when(kind == "01", 32).when(kind == "02", 64).otherwise(0).alias("bits"))
