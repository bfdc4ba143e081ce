"""Aggregations A1-A17."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.exprs import norm_api, stripped


def batch_summary(runs: DataFrame) -> DataFrame:
    """A1: one row: processed, ok, failed, vulnerabilities of ok runs and how many have some."""
    ok = F.col("ok")
    vuln = F.coalesce("vuln_count", F.lit(0))
    return runs.agg(F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, vuln)), F.lit(0)).alias("total_vulns"), F.count_if(ok & (vuln > 0)).alias("samples_with_vulns"))


def error_histogram(runs: DataFrame) -> DataFrame:
    """A1: failed runs by error type; a missing one is UnknownError."""
    return runs.where(~F.col("ok")).groupBy(F.coalesce("error_type", F.lit("UnknownError")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def merge_imports(rows: DataFrame) -> DataFrame:
    """A2: one (lib, proto) per func by the ordered fold over (path, pos): a prototype beats none, a longer one wins,
    a real library replaces dynsym's, else the old one stays. Blank ends don't count.

    The fold isn't associative and an entry can win at a later place, so all entries of a name are folded in
    order; a list holds one name's entries.
    """
    entry = F.struct("path", "pos", F.coalesce("lib", F.lit("")).alias("lib"), F.coalesce("proto", F.lit("")).alias("proto"))
    listed = rows.groupBy("func").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    pair = lambda x: F.struct(x["lib"].alias("lib"), x["proto"].alias("proto"))
    unnamed = lambda lib: lib.isin("dynsym", ".dynsym")

    def better(old, new):
        lib, was = stripped(new["lib"]), stripped(old["lib"])
        longer = F.length(stripped(new["proto"])) > F.length(stripped(old["proto"]))
        return F.when(longer | (unnamed(was) & (lib != "") & ~unnamed(lib)), pair(new)).otherwise(old)

    best = F.aggregate(F.slice("all", F.lit(2), F.size("all")), pair(F.col("all")[0]), better)
    return listed.select("func", best.alias("b")).select("func", "b.lib", "b.proto")


def import_counts(calls: DataFrame, import_edges: DataFrame | None = None) -> DataFrame:
    """A3: (item_id, api, n) of API calls by normalised name; items without any fall back to their import edges."""
    main = calls.where("cat = 'IMPORT_API'").select("item_id", norm_api(F.col("callee")).alias("api"))
    if import_edges is not None:
        rest = import_edges.join(main.select("item_id").distinct(), "item_id", "left_anti")
        main = main.unionByName(rest.select("item_id", norm_api(F.col("dst")).alias("api")))
    return main.groupBy("item_id", "api").agg(F.count(F.lit(1)).alias("n"))


def used_imports(calls: DataFrame) -> DataFrame:
    """A4: the set of APIs each item calls."""
    return calls.where("cat = 'IMPORT_API'").groupBy("item_id").agg(F.sort_array(F.collect_set(norm_api(F.col("callee")))).alias("apis"))


def size_stats(functions: DataFrame) -> DataFrame:
    """A5: mean, largest and least size over functions of a size."""
    return functions.where("size > 0").groupBy("item_id").agg(F.avg("size").alias("avg_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"), F.count(F.lit(1)).alias("n"))


def token_histogram(tokens: DataFrame) -> DataFrame:
    """Counts of token kinds (before the colon) per function."""
    return tokens.groupBy("item_id", "func", F.substring_index("token", ":", 1).alias("token")).agg(F.count(F.lit(1)).alias("n"))


def call_sites(calls: DataFrame) -> DataFrame:
    """One row per call site; INDIRECT wins over DIRECT."""
    return calls.groupBy("item_id", "caller", "callee", "ln").agg(F.when(F.bool_or(F.coalesce(F.col("call_type") == "INDIRECT", F.lit(False))), "INDIRECT").otherwise("DIRECT").alias("call_type"))


def smoke_rollup(attempts: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Per program its first signal ends it; all planned attempts timed out is timeout; else normal.

    attempts (item_id, seq, outcome, signal), outcome signal, timeout or normal. planned (item_id, planned) defaults
    to the attempts there are. Attempts after the first signal don't count.
    """
    w = Window.partitionBy("item_id")
    first = F.min(F.when(F.col("outcome") == "signal", F.col("seq"))).over(w)
    rows = attempts.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("first", first).where("first is null or seq <= first")
    got = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("executed"), F.count_if(F.col("outcome") == "timeout").alias("timeouts"), F.min_by(F.when(F.col("outcome") == "signal", F.col("signal")), F.when(F.col("outcome") == "signal", F.col("seq"))).alias("signal"), F.max(F.col("first").isNotNull()).alias("crashed"), F.max("total").alias("total"))
    if planned is not None:
        got = got.join(planned, "item_id").withColumn("total", F.col("planned"))
    status = F.when(F.col("crashed"), "signal").when(F.col("timeouts") == F.col("total"), "timeout").otherwise("normal")
    return got.select("item_id", status.alias("status"), "executed", "timeouts", "signal")


def global_references(refs: DataFrame) -> DataFrame:
    """References of each address, without repeats of (function, line)."""
    one = refs.dropDuplicates(["item_id", "addr_ea", "function_name", "decompiled_line"])
    return one.groupBy("item_id", "addr_ea").agg(F.count(F.lit(1)).alias("n_refs"), F.array_sort(F.collect_list(F.struct("function_name", "decompiled_line"))).alias("refs"))


def allocation(strata: list[tuple[int, int]], k: int) -> dict[int, int]:
    """K places among strata (bits, count): in proportion, rounded half to even, one at least, then trimmed or topped up."""
    total = sum(n for _, n in strata)
    if not total:
        return {}
    out = {b: max(1, round(k * n / total)) if n else 0 for b, n in strata}
    while sum(out.values()) > k and any(v > 1 for v in out.values()):
        out[max(out, key=lambda b: (out[b], -b))] -= 1
    room = {b: n for b, n in strata}
    while sum(out.values()) < min(k, total):
        open_ = [b for b in out if out[b] < room[b]]
        if not open_:
            break
        out[max(open_, key=lambda b: (room[b] - out[b], -b))] += 1
    return {b: min(v, room[b]) for b, v in out.items()}


def sinks_in_sources(leads: DataFrame, sources: DataFrame) -> DataFrame:
    """How many leads' sinks are sources too."""
    marked = leads.join(sources.select(F.col("api").alias("sink_api"), F.lit(True).alias("src")).distinct(), "sink_api", "left")
    return marked.agg(F.count_if(F.col("src")).alias("n_sink_in_source"), F.count(F.lit(1)).alias("n_leads"))


def usage_lines(uses: DataFrame) -> DataFrame:
    """The lines that use each local, sorted, once each."""
    return uses.groupBy("item_id", "func", "var").agg(F.sort_array(F.collect_set("ln")).alias("usage_lines"))


def coverage(near: DataFrame) -> DataFrame:
    """Statistics of the similarity ``sim`` of all items to their nearest chosen one; exact percentiles."""
    d = 1 - F.col("sim")
    return near.agg(F.avg(d).alias("mean_dist"), F.percentile(d, 0.5).alias("p50_dist"), F.percentile(d, 0.9).alias("p90_dist"), F.max(d).alias("max_dist"), F.avg("sim").alias("mean_sim"), F.percentile("sim", 0.1).alias("p10_sim"))


def variable_accesses(accesses: DataFrame, lines: DataFrame) -> DataFrame:
    """Per local and kind of access (reads, writes, ptr_writes) the source lines its tree items lie on."""
    return accesses.join(lines, ["item_id", "func", "citem"]).groupBy("item_id", "func", "var", "kind").agg(F.sort_array(F.collect_set("ln")).alias("lines"))
