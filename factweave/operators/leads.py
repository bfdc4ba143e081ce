"""Lead generation L1-L5 as compositions of graph, join and dedup operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, relational

MEMORY_WRITES = "memory write operations"


def _numbered(found: DataFrame) -> DataFrame:
    """lead_id from what makes a lead, so that ids need no global order."""
    return found.withColumn("lead_id", F.xxhash64("item_id", "sink_api", F.array_join("call_chain", "\x1f")))


def sink_leads(uses: DataFrame, sinks: DataFrame, edges: DataFrame, entries: DataFrame, code: DataFrame) -> DataFrame:
    """L1: leads from the entry to every caller of a sink, with code, equal leaves once."""
    callers = uses.join(sinks.select("api").distinct(), "api", "left_semi").select("item_id", F.col("caller").alias("name")).distinct()
    paths = graph.simple_paths(edges, entries.select("item_id", F.col("entry").alias("name")), callers)
    found = relational.sink_paths(uses, sinks, paths).withColumnRenamed("path", "call_chain")
    return relational.leaf_distinct(relational.chain_code(_numbered(found), code), relational.LEAD_ORDER)


def write_leads(edges: DataFrame, entries: DataFrame, code: DataFrame) -> DataFrame:
    """L2: leads to functions that write memory, of greatest coverage, equal leaves once."""
    writers = code.where(relational.writes_memory(F.col("pcode"))).select("item_id", F.col("func").alias("name")).distinct()
    paths = graph.simple_paths(edges, entries.select("item_id", F.col("entry").alias("name")), writers)
    longest = relational.without_prefixes(paths.select("item_id", "path")).withColumnRenamed("path", "call_chain")
    found = longest.select("item_id", F.lit(MEMORY_WRITES).alias("sink_api"), F.element_at("call_chain", -1).alias("sink_caller"), "call_chain")
    return relational.leaf_distinct(relational.chain_code(_numbered(found), code), relational.LEAD_ORDER)


def needs_fallback(leads: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """L3: (item_id, fallback): no lead, or only leads whose sink is a source."""
    src = sources.select(F.col("api").alias("sink_api"), F.lit(True).alias("src")).distinct()
    seen = leads.join(src, "sink_api", "left").groupBy("item_id").agg(F.bool_and(F.coalesce("src", F.lit(False))).alias("only_sources"))
    return items.select("item_id").join(seen, "item_id", "left").select("item_id", F.coalesce("only_sources", F.lit(True)).alias("fallback"))


def with_fallback(first: DataFrame, second: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """L3: L1's leads, and L2's new ones for the items that need them."""
    wanted = needs_fallback(first, items, sources).where("fallback").select("item_id")
    return relational.append_new(first, second.join(wanted, "item_id", "left_semi"), order="lead_id")


def static_leads(static_sinks: DataFrame, edges: DataFrame, entries: DataFrame, code: DataFrame, most: int = 20) -> DataFrame:
    """L4: leads to given (item_id, caller, api) sinks, the first ``most`` paths each, repeats once."""
    ends = static_sinks.select("item_id", F.col("caller").alias("name")).distinct()
    paths = graph.first_paths(edges, entries.select("item_id", F.col("entry").alias("name")), ends, most)
    found = paths.join(static_sinks.distinct().select("item_id", F.col("caller").alias("end"), F.col("api").alias("sink_api")), ["item_id", "end"])
    capped = relational.capped_paths(found.select("item_id", "sink_api", F.col("end").alias("sink_caller"), "path"), most)
    return relational.chain_code(_numbered(capped.dropDuplicates(["item_id", "sink_caller", "sink_api", "path"]).withColumnRenamed("path", "call_chain")), code)


def edge_leads(uses: DataFrame, roles: DataFrame, edges: DataFrame) -> DataFrame:
    """Leads from each source's caller to each sink's, a pair in one function being its own chain."""
    starts = uses.join(roles.where("role = 'source'").select("api").distinct(), "api", "left_semi").select("item_id", F.col("caller").alias("name")).distinct()
    paths = graph.simple_paths(edges, starts)
    pairs = relational.source_sink_pairs(uses, roles, paths)
    joined = pairs.join(paths.select("item_id", F.col("start").alias("source_caller"), F.col("end").alias("sink_caller"), F.col("path").alias("call_chain")), ["item_id", "source_caller", "sink_caller"])
    return _numbered(joined)
