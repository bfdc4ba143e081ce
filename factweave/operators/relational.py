"""Projections P1-P12, joins J1-J14 and order-preserving dedups D1-D7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.exprs import stripped
from factweave.sources.store import large


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def reachable_functions(functions: DataFrame, reach: DataFrame, entries: DataFrame) -> DataFrame:
    """Functions reachable from the entry; the entry stays anyway."""
    keep = reach.select("item_id", "name").unionByName(entries.select("item_id", F.col("entry").alias("name"))).distinct()
    return functions.join(large(keep), ["item_id", "name"], "left_semi")


def slim(code: DataFrame) -> DataFrame:
    """Without pseudo-code."""
    return code.drop("pcode")


def api_uses(calls: DataFrame) -> DataFrame:
    """The distinct APIs of each caller, in first-seen order (item_id, caller, api, seq)."""
    one = first_by(calls.where("cat = 'IMPORT_API'"), ["item_id", "caller", "callee"], ["ln"])
    w = Window.partitionBy("item_id", "caller").orderBy("ln", "callee")
    return one.select("item_id", "caller", F.col("callee").alias("api"), F.row_number().over(w).alias("seq"))


def last_by_name(globals_: DataFrame, order: str = "seq") -> DataFrame:
    """Of equal names the last one wins."""
    rest = [c for c in globals_.columns if c not in ("item_id", "name")]
    got = globals_.groupBy("item_id", "name").agg(F.max_by(F.struct(*rest), order).alias("s"))
    return got.select("item_id", "name", *[F.col("s")[c].alias(c) for c in rest])


def prefixed(name: Column, pcode: Column) -> Column:
    """P5: pseudo-code under its real name; a missing body is an empty one."""
    return F.concat(F.lit("Real symbol name: "), name, F.lit("\n"), F.coalesce(pcode, F.lit("")))


def writes_memory(text: Column) -> Column:
    """Some line assigns something other than zero or the stack guard."""
    return F.exists(F.split(text, r"\R"), lambda x: x.rlike(r"^\s*[^=]+ = .+") & ~x.rlike(r"^\s*[^=]+ = (0($|;)|0x0($|;)|0\.0($|;)|0d($|;)|__readfsqword)"))


def place(dist: Column, reg: Column) -> tuple[Column, Column]:
    """The two tests of the two readers: by the distance from the return address, and by the register."""
    return F.when(dist.isNotNull(), "Stack").otherwise("Register"), F.when(reg.isNotNull(), "Register").otherwise("Stack")


def lead_gates(leads: DataFrame, calls: DataFrame, locals_: DataFrame, global_refs: DataFrame, code: DataFrame) -> DataFrame:
    """Five booleans per lead over its chain's functions. A null call type is not indirect; a local without a
    register (reg_id) lies on the stack."""
    fn = leads.select("lead_id", "item_id", F.explode(F.array_distinct("call_chain")).alias("func"))
    by_call = calls.groupBy("item_id", F.col("caller").alias("func")).agg(F.bool_or(F.coalesce(F.upper("call_type") == "INDIRECT", F.lit(False))).alias("ind"), F.bool_or(F.upper("cat").isin("USER_DEF", "OTHER")).alias("inner"))
    by_local = locals_.groupBy("item_id", "func").agg(F.bool_or(F.col("reg_id").isNull()).alias("stack"))
    by_global = global_refs.select("item_id", F.col("function_name").alias("func"), F.lit(True).alias("glob")).distinct()
    by_code = code.select("item_id", "func", F.col("pcode").contains(" alloca(").alias("alloca"))
    both = fn
    for side in (by_call, by_local, by_global, by_code):
        both = both.join(side, ["item_id", "func"], "left")
    any_of = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    return both.groupBy("lead_id").agg(any_of("ind", "has_indirect"), any_of("stack", "has_stack"), any_of("glob", "has_global"), any_of("inner", "has_inner"), any_of("alloca", "has_alloca"))


def meaningful_lines(text: Column) -> Column:
    """The lines that say something, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: stripped(x)), lambda x: ~x.isin("", "{", "}", "else", "do"))


# What hints are given for.
ALLOCA = r"(?<![A-Za-z0-9])alloca\("
PARTIAL_WORD = r"(?<![A-Za-z0-9_])(?:S)?(?:LO|HI)?(?:BYTE|WORD|DWORD)(?:\d+|n)?\s*\("
OPERATOR_NEW = r"operator\s+new\("


def hints(text: Column, cwe: Column) -> dict[str, Column]:
    """What a lead's joined code mentions, where its weakness class asks for it."""
    return {
        "reads_guard": (cwe == "121") & text.contains("__readfsqword("),
        "uses_alloca": (cwe == "121") & text.rlike(ALLOCA),
        "partial_word": (cwe == "121") & text.rlike(PARTIAL_WORD),
        "uses_new": (cwe == "122") & text.rlike(OPERATOR_NEW),
    }


def api_callers(uses: DataFrame) -> DataFrame:
    """The callers of each API."""
    return uses.groupBy("item_id", "api").agg(F.sort_array(F.collect_set("caller")).alias("callers"))


def source_sink_pairs(uses: DataFrame, roles: DataFrame, paths: DataFrame) -> DataFrame:
    """(item_id, source_api, sink_api, source_caller, sink_caller) joined by a path; an API that is source and
    sink is a sink only of itself."""
    flags = roles.groupBy("api").agg(F.bool_or(F.col("role") == "source").alias("is_source"), F.bool_or(F.col("role") == "sink").alias("is_sink"))
    used = uses.join(flags, "api")
    src = used.where("is_source").select("item_id", F.col("api").alias("source_api"), F.col("caller").alias("source_caller"))
    snk = used.where("is_sink").select("item_id", F.col("api").alias("sink_api"), F.col("caller").alias("sink_caller"), F.col("is_source").alias("__both"))
    ends = paths.select("item_id", F.col("start").alias("source_caller"), F.col("end").alias("sink_caller")).distinct()
    pairs = src.join(ends, ["item_id", "source_caller"]).join(snk, ["item_id", "sink_caller"])
    return pairs.where((F.col("source_api") == F.col("sink_api")) | ~F.col("__both")).drop("__both").distinct()


def sink_paths(uses: DataFrame, sinks: DataFrame, paths: DataFrame) -> DataFrame:
    """Every path to a function with each sink API it calls."""
    hits = uses.join(sinks.select("api").distinct(), "api", "left_semi").select("item_id", F.col("caller").alias("end"), F.col("api").alias("sink_api"))
    return paths.join(hits, ["item_id", "end"]).select("item_id", "sink_api", F.col("end").alias("sink_caller"), "path")


def capped_paths(found: DataFrame, most: int = 20) -> DataFrame:
    """The first paths of each (caller, api) by length, then path."""
    w = Window.partitionBy("item_id", "sink_caller", "sink_api").orderBy(F.size("path"), "path")
    return found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def chain_code(chains: DataFrame, code: DataFrame) -> DataFrame:
    """Adds pcode_list in the chain's order, null where there is no code. Needs lead_id, item_id, call_chain."""
    rows = chains.select("lead_id", "item_id", F.posexplode("call_chain").alias("pos", "func"))
    rows = rows.join(code.select("item_id", "func", "pcode"), ["item_id", "func"], "left")
    lists = rows.groupBy("lead_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pcode"))), lambda x: x["pcode"]).alias("pcode_list"))
    return chains.join(lists, "lead_id", "left")


def with_alias(names: DataFrame, facts: DataFrame, alias: DataFrame, value: str) -> DataFrame:
    """Facts by name, else by the name's alias; an empty list counts as nothing."""
    some = F.when(F.size(value) > 0, F.col(value))
    direct = facts.select("item_id", "name", some.alias("__a"))
    other = alias.join(facts.select("item_id", F.col("name").alias("real"), some.alias("__b")), ["item_id", "real"]).select("item_id", "name", "__b")
    return names.join(direct, ["item_id", "name"], "left").join(other, ["item_id", "name"], "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def local_lookup(asked: DataFrame, locals_: DataFrame, compat_last: bool = False) -> DataFrame:
    """A function's local by name, with not_found; ``compat_last`` answers a miss with the last local instead."""
    cols = [c for c in locals_.columns if c not in ("item_id", "func", "var")]
    by_name = locals_.select("item_id", "func", "var", F.struct(*cols).alias("hit"))
    out = asked.join(by_name, ["item_id", "func", "var"], "left").withColumn("not_found", F.col("hit").isNull())
    if compat_last:
        last = locals_.groupBy("item_id", "func").agg(F.max_by(F.struct(*cols), "lvar_idx").alias("last"))
        out = out.join(last, ["item_id", "func"], "left").withColumn("hit", F.coalesce("hit", "last")).drop("last")
    return out.select(*asked.columns, "not_found", *[F.col("hit")[c].alias(c) for c in cols])


def global_lookup(asked: DataFrame, globals_: DataFrame) -> DataFrame:
    """A global by name, with UnknownGlobalVar and -1 for a miss."""
    out = asked.join(globals_.select("item_id", F.col("name").alias("var"), "type", "size_bytes"), ["item_id", "var"], "left")
    return out.withColumns({"type": F.coalesce("type", F.lit("UnknownGlobalVar")), "size_bytes": F.coalesce("size_bytes", F.lit(-1))})


def append_new(old: DataFrame, new: DataFrame, chain: str = "call_chain", order: str = "seq") -> DataFrame:
    """``old`` and the new rows whose chain is neither empty, nor in ``old``, nor repeated among the new of its item."""
    key = ["item_id", chain]
    rest = [c for c in old.columns if c not in (*key, order)]
    known = old.select(*key, F.lit(None).cast(new.schema[order].dataType).alias(order), *[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in rest], F.lit(True).alias("__old"))
    both = new.where(F.size(chain) > 0).select(*key, order, *rest, F.lit(False).alias("__old")).unionByName(known)
    # One grouping by hash: sorting long chains took memory, and so would a join with the old ones.
    least = F.when(F.max(~F.col("__old") & F.col(order).isNull()), None).otherwise(F.min(order))  # null comes first
    first = least.alias(order) if not rest else F.min(F.when(~F.col("__old"), F.struct(order, *rest))).alias("__s")
    fresh = both.groupBy(*key).agg(first, F.max("__old").alias("__old")).where(~F.col("__old"))
    return old.unionByName((fresh.select(*key, "__s.*") if rest else fresh).select(*old.columns))


def without_prefixes(chains: DataFrame, chain: str = "path") -> DataFrame:
    """Drops chains that are a proper prefix of another of their item: an anti join on exploded prefixes."""
    cut = chains.where(F.size(chain) > 1).select("item_id", F.explode(F.sequence(F.lit(1), F.size(chain) - 1)).alias("n"), chain)
    prefixes = cut.select("item_id", F.slice(chain, F.lit(1), F.col("n")).alias(chain)).distinct()
    return chains.join(prefixes, ["item_id", chain], "left_anti")


def cited(turns: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per turn whether some cited evidence id does not exist (yet), and the types of those that do."""
    ids = turns.select("lead_id", "turn", F.explode_outer("update_from").alias("evid_id"))
    rows = ids.join(evidence.select("lead_id", "evid_id", F.col("type").alias("kind")), ["lead_id", "evid_id"], "left")
    return rows.groupBy("lead_id", "turn").agg(F.coalesce(F.bool_or(F.col("evid_id").isNotNull() & F.col("kind").isNull()), F.lit(False)).alias("invalid"), F.sort_array(F.collect_set("kind")).alias("kinds"))


def body(pcode: Column) -> Column:
    """A body without its name line and signature; null stays null, empty stays empty."""
    lines = F.filter(F.split(pcode, r"\R"), lambda x: ~x.startswith("Real symbol name:"))
    signed = F.get(lines, F.lit(0)).rlike(r"^[^;{=]*\([^;]*\)\s*\{?\s*$")
    return stripped(F.array_join(F.when(signed, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines), "\n"))


#: Leads come in the order in which capped paths are taken: the shortest chain first, then by names.
LEAD_ORDER = ("n_chain", "call_chain", "sink_api")


def leaf_distinct(leads: DataFrame, order: tuple[str, ...] = ("lead_id",)) -> DataFrame:
    """Of leads that differ only in the name of an equal leaf body the first stays; empty chains and null bodies all stay."""
    known = leads.withColumn("__b", body(F.try_element_at("pcode_list", F.lit(-1))))
    loose = (F.size("call_chain") == 0) | F.col("__b").isNull()
    by = [F.size("call_chain") if c == "n_chain" else F.col(c) for c in order]
    w = Window.partitionBy("item_id", F.slice("call_chain", F.lit(1), F.greatest(F.size("call_chain") - 1, F.lit(0))), "__b").orderBy(*by)
    firm = known.where(~loose).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return firm.unionByName(known.where(loose)).drop("__b")


def unique_names(symbols: DataFrame, order: str = "off") -> DataFrame:
    """The second and later bearers of a name get _2, _3 and so on."""
    w = Window.partitionBy("item_id", "name").orderBy(order)
    k = F.row_number().over(w)
    return symbols.withColumn("unique_name", F.when(k == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), k.cast("string"))))


def gaps(spans: DataFrame, by: list[str], off: str = "off", size: str = "size") -> DataFrame:
    """Gap to the end of the span before, and whether the two overlap."""
    w = Window.partitionBy(*by).orderBy(off, size)
    end = F.lag(F.col(off) + F.col(size)).over(w)
    return spans.withColumn("gap", F.col(off) - end).withColumn("overlap", F.coalesce(F.col(off) < end, F.lit(False)))
