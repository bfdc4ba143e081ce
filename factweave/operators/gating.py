"""Evidence gating O1-O10: obligations, the least set of primitives, and the gated replay of recorded replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("O1", "O2", "O3", "O4")
# The primitives that can support each obligation.
TEMPLATE = {"O1": ["inner_call"], "O2": ["global_var", "fetch_pcode", "stack_lvar"], "O3": ["global_var", "fetch_pcode"], "O4": ["stack_lvar", "fetch_disasm"]}
PRIMITIVES = ("fetch_disasm", "fetch_pcode", "global_var", "inner_call", "stack_lvar")
STACK_CLASSES = ("121", "122", "125", "787")


def gates(flags: DataFrame) -> DataFrame:
    """O1, O2: adds O1..O4 (arrays of primitives that apply to the lead) and mandatory.

    ``flags`` has lead_id, cwe and the five booleans of ``relational.lead_gates``.
    """
    on = {"inner_call": F.col("has_indirect"), "global_var": F.col("has_global"), "fetch_pcode": F.col("has_inner"), "stack_lvar": F.col("has_stack"), "fetch_disasm": F.col("has_alloca")}
    out = flags
    for key, names in TEMPLATE.items():
        out = out.withColumn(key, F.array_compact(F.array(*[F.when(on[n], F.lit(n)) for n in names])))
    must = F.array_compact(F.array(F.when(F.col("cwe").isin(*STACK_CLASSES) & F.col("has_stack"), F.lit("stack_lvar")), F.when(F.col("has_alloca"), F.lit("fetch_disasm"))))
    return out.withColumn("mandatory", must)


def least_cover(gated: DataFrame) -> DataFrame:
    """O3: adds least_size: how few primitives meet every non-empty obligation and all mandatory ones; null if none do.

    All 32 subsets are tried inside the row, so nothing is joined.
    """
    subsets = F.array(*[F.array(*[F.lit(p) for i, p in enumerate(PRIMITIVES) if b >> i & 1]).cast("array<string>") for b in range(32)])

    def good(s: Column) -> Column:
        met = F.size(F.array_except("mandatory", s)) == 0
        for key in KEYS:
            met = met & ((F.size(key) == 0) | F.arrays_overlap(F.col(key), s))
        return met

    return gated.withColumn("least_size", F.array_min(F.transform(F.filter(subsets, good), lambda s: F.size(s))))


def refill(gated: DataFrame) -> DataFrame:
    """Obligations that apply at all get their whole template back."""
    for key, names in TEMPLATE.items():
        gated = gated.withColumn(key, F.when(F.size(key) > 0, F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>")))
    return gated


def changed(before: Column, after: Column) -> Column:
    """Obligations that went from Unknown to something known; both are maps."""
    return F.filter(F.array(*[F.lit(k) for k in KEYS]), lambda k: (F.coalesce(before[k], F.lit("Unknown")) == "Unknown") & (F.coalesce(after[k], F.lit("Unknown")) != "Unknown"))


def replay(turns: DataFrame, evidence: DataFrame, gated: DataFrame) -> DataFrame:
    """Per turn the accepted state after it, whether it was accepted, the sticky gating_flag and regressed.

    turns (lead_id, turn, O1..O4 statuses, update_from); evidence (lead_id, evid_id, type), of which a turn may cite ids
    up to its own number; gated (lead_id, O1..O4 requirements). The first turn is accepted as it is. Later ones pass if
    every newly known obligation has a cited evidence of a required type (no requirement passes), no cited id
    is invalid, or nothing changed. A rejected turn keeps the old state. The fold runs inside one lead's turns.
    """
    kinds = evidence.groupBy("lead_id").agg(F.map_from_entries(F.collect_list(F.struct("evid_id", "type"))).alias("kinds"))
    rows = turns.join(kinds, "lead_id", "left").join(gated.select("lead_id", *[F.col(k).alias(f"need_{k}") for k in KEYS]), "lead_id", "left")
    cite = F.coalesce("update_from", F.array().cast("array<int>"))
    known = F.coalesce("kinds", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")))
    got = F.transform(cite, lambda i: F.when(i <= F.col("turn"), F.try_element_at(known, i)))
    meets = F.array(*[F.coalesce(F.size(f"need_{k}") == 0, F.lit(True)) | F.arrays_overlap(F.array_compact("got"), F.col(f"need_{k}")) for k in KEYS])
    rows = rows.withColumn("got", got).withColumn("invalid", F.exists("got", lambda x: x.isNull())).withColumn("meets", meets)
    one = F.struct("turn", F.array(*[F.coalesce(k, F.lit("Unknown")) for k in KEYS]).alias("st"), "invalid", "meets")
    listed = rows.groupBy("lead_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    blank = F.array(*[F.lit("Unknown")] * 4)
    step_type = "array<struct<turn:int,st:array<string>,accepted:boolean,gating_flag:boolean,regressed:boolean>>"
    spots = F.array(*[F.lit(i) for i in range(4)])

    def fold(acc: Column, t: Column) -> Column:
        first = F.size(acc["log"]) == 0
        new = F.filter(spots, lambda i: (acc["st"][i] == "Unknown") & (t["st"][i] != "Unknown"))
        passes = first | (F.size(new) == 0) | (~t["invalid"] & F.forall(new, lambda i: F.coalesce(t["meets"][i], F.lit(False))))
        state = F.when(passes, t["st"]).otherwise(acc["st"])
        flag = acc["flag"] | ~passes
        back = F.exists(spots, lambda i: (acc["st"][i] != "Unknown") & (state[i] != acc["st"][i]))
        entry = F.struct(t["turn"].cast("int").alias("turn"), state.alias("st"), passes.alias("accepted"), flag.alias("gating_flag"), back.alias("regressed"))
        return F.struct(state.alias("st"), flag.alias("flag"), F.concat(acc["log"], F.array(entry)).cast(step_type).alias("log"))

    start = F.struct(blank.alias("st"), F.lit(False).alias("flag"), F.array().cast(step_type).alias("log"))
    log = listed.select("lead_id", F.explode(F.aggregate("all", start, fold)["log"]).alias("s"))
    return log.select("lead_id", "s.turn", *[F.col("s.st")[i].alias(k) for i, k in enumerate(KEYS)], "s.accepted", "s.gating_flag", "s.regressed")


def dispatch(asked: DataFrame, answers: dict[str, DataFrame]) -> DataFrame:
    """(lead_id, turn, type, payload): each question by its query_type; the answers are keyed (item_id, func, var)."""
    out = None
    for kind, facts in answers.items():
        cols = [c for c in facts.columns if c not in ("item_id", "func", "var")]
        on = [c for c in ("item_id", "func", "var") if c in facts.columns]
        part = asked.where(F.col("query_type") == kind).join(facts, on, "left").select("lead_id", "turn", F.lit(kind).alias("type"), F.to_json(F.struct(*cols)).alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


def useful_citations(turns: DataFrame, evidence_status: DataFrame) -> DataFrame:
    """update_from without ids whose evidence brought no status; evidence_status (lead_id, evid_id, known)."""
    useful = evidence_status.where("known").groupBy("lead_id").agg(F.collect_set("evid_id").alias("useful"))
    kept = F.filter("update_from", lambda i: F.array_contains(F.coalesce("useful", F.array().cast("array<int>")), i))
    return turns.join(useful, "lead_id", "left").withColumn("update_from", kept).drop("useful")


def one_shot(turns: DataFrame) -> DataFrame:
    """The ungated variant: the first reply alone; leads without a valid one are left out."""
    return turns.where("turn = 0 and valid").drop("valid")


def first_confirmed(verdicts: DataFrame, order: str = "lead_id") -> DataFrame:
    """Adds evaluated: false for leads of an item after its first confirmed one."""
    from pyspark.sql import Window

    first = F.min(F.when(F.col("is_vuln"), F.col(order))).over(Window.partitionBy("item_id"))
    return verdicts.withColumn("evaluated", first.isNull() | (F.col(order) <= first))
