"""Sources: binaries, fact documents, role and category tables, and adapters over the driver's tables.

Schemas are declared, absent fields become null, malformed documents land in ``_corrupt_record``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESOURCES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "resources")

CALL = "array<struct<name:string,cat:string,ln:bigint,call_type:string>>"
EDGE = "array<struct<dst:string,ln:bigint,call_type:string>>"
SCHEMAS = {
    "entry": "entry_func string, enrty_func string",
    "func_internal_list": "name string, start_ea string, size string",
    "import_api": "lib string, func string, proto string",
    "func_call": f"calls map<string,{CALL}>",
    "func_dis": "code map<string,struct<disasm:string,pcode:string>>",
    "stack_vars": "funcs map<string,array<struct<name:string,type:string,size_bytes:bigint,dist_from_ret_addr:bigint,reg_id:bigint,usage_lines:array<bigint>>>>",
    "global_refs": "vars map<string,struct<type:string,size_bytes:bigint,addr_ea:string,references:array<struct<function_name:string,decompiled_line:string>>>>",
    "reachable_callgraph": "entry string, reachable_funcs array<string>, edges map<string,array<string>>",
    "item": "meta struct<idx:bigint,path:string,file_name:string,sha256:string,elf_bits:string>, error string,"
    " entry struct<entry_func:string,enrty_func:string>, func_internal_list array<struct<name:string,start_ea:string,size:string>>,"
    " import_api_list array<struct<lib:string,func:string,proto:string>>,"
    f" func_call_dict map<string,{CALL}>, disasm_dict map<string,struct<disasm:string>>,"
    f" reachable_callgraph struct<entry:string,reachable_funcs:array<string>,edges:map<string,array<string>>>,"
    f" call_subgraph struct<internal_funcs:array<string>,used_imports:array<string>,internal_edges:map<string,{EDGE}>,import_edges:map<string,{EDGE}>>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elf_files(spark: SparkSession, path: str, recursive: bool = True, limit: int = 0, pattern: str | None = None) -> DataFrame:
    """Path, bits (32, 64, else 0) and sha256 of the files that start with the ELF magic, by path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).where(F.substring("content", 1, 4) == F.unhex(F.lit("7F454C46")))
    kind = F.hex(F.substring("content", 5, 1))
    out = files.select("path", F.when(kind == "01", 32).when(kind == "02", 64).otherwise(0).alias("bits"), F.sha2("content", 256).alias("sha256")).orderBy("path")
    return out.limit(limit) if limit > 0 else out


def executables(path: str, recursive: bool = True, magic: bool = False, limit: int = 0) -> list[str]:
    """Executable regular files without a dot in their name, sorted. X_OK is only visible to the driver."""
    found = []
    for folder, _, names in os.walk(path):
        for name in names:
            full = os.path.join(folder, name)
            if "." in name or not os.path.isfile(full) or not os.access(full, os.X_OK):
                continue
            if magic:
                with open(full, "rb") as f:
                    if f.read(4) != b"\x7fELF":
                        continue
            found.append(full)
        if not recursive:
            break
    found.sort()
    return found[:limit] if limit > 0 else found


def document(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON documents of one kind, whole files."""
    return spark.read.schema(SCHEMAS[kind] + ", _corrupt_record string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A features document's items, one row each, with their order: by length of the key, then the key."""
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.explode(F.from_json("value", f"items map<string,struct<{_struct(SCHEMAS['item'])}>>")["items"]).alias("item_id", "item"))
    return items.withColumn("item_order", F.struct(F.length("item_id"), "item_id"))


def _struct(ddl: str) -> str:
    """``a int, b map<x,y>`` as the inside of struct<>: the first blank of each field becomes a colon."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[start:k].strip().replace(" ", ":", 1))
            start = k + 1
    return ",".join(out)


def dynsym_parts(func: str = "func") -> tuple:
    """name@@version into (lib, func); without a version the library stays null."""
    parts = F.split(F.col(func), "@@", 2)
    return F.get(parts, F.lit(1)), F.get(parts, F.lit(0))


def calls_of(items: DataFrame) -> DataFrame:
    """calls (item_id, caller, callee, cat, ln, call_type) of corpus items."""
    rows = items.select("item_id", F.explode("item.func_call_dict").alias("caller", "list")).select("item_id", "caller", F.explode("list").alias("c"))
    return rows.select("item_id", "caller", F.col("c.name").alias("callee"), "c.cat", "c.ln", "c.call_type")


def functions_of(items: DataFrame) -> DataFrame:
    """functions (item_id, name, start_ea, size): hex strings parsed."""
    rows = items.select("item_id", F.explode("item.func_internal_list").alias("f"))
    number = lambda c: F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10).cast("long")
    return rows.select("item_id", "f.name", number("f.start_ea").alias("start_ea"), number("f.size").alias("size"))


def imports_of(items: DataFrame) -> DataFrame:
    """imports (item_id, lib, api, proto)."""
    return items.select("item_id", F.explode("item.import_api_list").alias("i")).select("item_id", "i.lib", F.col("i.func").alias("api"), "i.proto")


def code_of(items: DataFrame) -> DataFrame:
    """code (item_id, func, disasm, pcode) of corpus items; they carry disassembly alone, pcode is null."""
    rows = items.select("item_id", F.explode("item.disasm_dict").alias("func", "d"))
    return rows.select("item_id", "func", F.col("d.disasm").alias("disasm"), F.lit(None).cast("string").alias("pcode"))


def import_edges_of(items: DataFrame) -> DataFrame:
    """import_edges (item_id, src, dst, ln, call_type) of the items' call subgraphs."""
    rows = items.select("item_id", F.explode("item.call_subgraph.import_edges").alias("src", "list")).select("item_id", "src", F.explode("list").alias("e"))
    return rows.select("item_id", "src", "e.dst", "e.ln", "e.call_type")


def entries_of(items: DataFrame) -> DataFrame:
    """(item_id, entry), under either spelling of the field; items without one are left out."""
    rows = items.select("item_id", F.coalesce("item.entry.entry_func", "item.entry.enrty_func").alias("entry"))
    return rows.where("entry is not null and entry <> ''")


def locals_of(documents: DataFrame) -> DataFrame:
    """locals (item_id, func, var, lvar_idx, type, size_bytes, dist_from_ret_addr, reg_id, usage_lines) of ``stack_vars`` documents.

    ``documents``: item_id and funcs, as ``document`` reads them.
    """
    rows = documents.select("item_id", F.explode("funcs").alias("func", "vars")).select("item_id", "func", F.posexplode("vars").alias("lvar_idx", "v"))
    return rows.select("item_id", "func", F.col("v.name").alias("var"), "lvar_idx", "v.type", "v.size_bytes", "v.dist_from_ret_addr", "v.reg_id", "v.usage_lines")


def global_refs_of(documents: DataFrame) -> DataFrame:
    """global_refs (item_id, name, type, size_bytes, addr_ea, function_name, decompiled_line) of ``global_refs`` documents (item_id, vars)."""
    rows = documents.select("item_id", F.explode("vars").alias("name", "g")).select("item_id", "name", "g.type", "g.size_bytes", "g.addr_ea", F.explode_outer("g.references").alias("r"))
    return rows.select("item_id", "name", "type", "size_bytes", "addr_ea", "r.function_name", "r.decompiled_line")


def roles(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """(cwe, api, role, reason); an api may have several roles."""
    return spark.createDataFrame(rows, "cwe string, api string, role string, reason string")


def api_categories(spark: SparkSession) -> DataFrame:
    """(api, category) of the resource table; its size is that of the file."""
    with open(os.path.join(RESOURCES, "api_categories.txt")) as f:
        lines = [line.strip().split(": ") for line in f if ": " in line and not line.startswith("#")]
    return spark.createDataFrame([(api, category) for category, apis in lines for api in apis.split()], "api string, category string")


# Adapters: the driver's tables seen as program facts. A user's events in order are an item's control flow.


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, fn, k, value, event_id, ln): ln is the place among the user's events."""
    ev = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("fn"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value", "event_id", F.row_number().over(w).cast("long").alias("ln"))


def calls(ev: DataFrame) -> DataFrame:
    """calls facts of ``events``: each event's type calls the next one's (USER_DEF) and an API named by its k (IMPORT_API)."""
    w = Window.partitionBy("item_id").orderBy("ln")
    kind = F.when(F.col("k") % 3 == 0, "INDIRECT").otherwise("DIRECT")
    user = ev.withColumn("callee", F.lead("fn").over(w)).where("callee is not null").select("item_id", F.col("fn").alias("caller"), "callee", F.lit("USER_DEF").alias("cat"), "ln", kind.alias("call_type"))
    api = ev.select("item_id", F.col("fn").alias("caller"), F.concat(F.lit("___k"), F.col("k") % 10).alias("callee"), F.lit("IMPORT_API").alias("cat"), "ln", kind.alias("call_type"))
    return user.unionByName(api)


def entries(ev: DataFrame) -> DataFrame:
    """(item_id, entry): the type of each user's first event."""
    return ev.where("ln = 1").select("item_id", F.col("fn").alias("entry"))


def sizes(ev: DataFrame) -> DataFrame:
    """functions facts: (item_id, name, size), size the whole part of the largest value of the type."""
    return ev.groupBy("item_id", F.col("fn").alias("name")).agg(F.floor(F.max("value")).cast("long").alias("size"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, src, dst, seq): a supplier's line items as the edges of a sparse graph: several components, seldom a cycle."""
    li = table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("f"), F.col(c) % 701)
    return li.select(F.col("l_suppkey").alias("item_id"), name("l_partkey").alias("src"), name("l_orderkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def trade_entries(edges: DataFrame) -> DataFrame:
    return edges.groupBy("item_id").agg(F.min_by("src", F.struct("seq", "src")).alias("entry"))


#: The same adapters for the oracle, as the head of a WITH.
FACTS_SQL = """
ev AS (SELECT user_id AS item_id, event_type AS fn, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ln FROM events),
nxt AS (SELECT *, lead(fn) OVER (PARTITION BY item_id ORDER BY ln) AS callee FROM ev),
calls AS (SELECT item_id, fn AS caller, callee, 'USER_DEF' AS cat, ln, CASE WHEN k % 3 = 0 THEN 'INDIRECT' ELSE 'DIRECT' END AS call_type FROM nxt WHERE callee IS NOT NULL
  UNION ALL SELECT item_id, fn, '___k' || (k % 10), 'IMPORT_API', ln, CASE WHEN k % 3 = 0 THEN 'INDIRECT' ELSE 'DIRECT' END FROM ev),
entries AS (SELECT item_id, fn AS entry FROM ev WHERE ln = 1),
funcs AS (SELECT item_id, fn AS name, CAST(floor(max(value)) AS BIGINT) AS size FROM ev GROUP BY ALL),
edges AS (SELECT DISTINCT item_id, caller AS src, callee AS dst FROM calls WHERE cat = 'USER_DEF')
"""

TRADE_SQL = """
li AS (SELECT l_suppkey AS item_id, 'f' || (l_partkey % 701) AS src, 'f' || (l_orderkey % 701) AS dst, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
edges AS (SELECT DISTINCT item_id, src, dst FROM li),
entries AS (SELECT item_id, src AS entry FROM li QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seq, src) = 1)
"""
