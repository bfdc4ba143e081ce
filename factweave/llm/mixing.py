"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Targets come from water-filling over per-source sums. A document's copies have the fractional expectation
target / source size; whole parts are kept and fractions are rounded by transfers between pairs: mass (in
words) moves from one document of a pair to the other, in a random direction that leaves both expectations
unchanged, until one of the two is integral. Pairs are met in a reduction tree: within blocks of bounded
size first, then among the blocks' residuals, until each source has one residual. What its rounding misses the
target by is handed down to smaller documents, so a source's words end within about half of a small document of its
target, and no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, keep

#: Units of mass a word: fractions are held as whole numbers, so transfers lose nothing.
UNITS = 1 << 16
#: Rows a block of the tree has on average.
BLOCK_ROWS = 64
#: No document is taken more often.
MOST_COPIES = 3
#: Rounded documents of each size class and decision that can take over what the last residual missed its target by.
SPARE = 8
#: How often a pair of these is looked for that lessens the miss.
PAIR_ROUNDS = 3


def _before(df: DataFrame, group: list[str]) -> DataFrame:
    """(group, part, before): how many rows of a group lie in lower parts. One row a part is all that a window sees."""
    parts = df.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"))
    lower = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*group, "part", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"))


def source_targets(sizes: DataFrame, most: int = MOST_COPIES, weights: int = 3) -> DataFrame:
    """source, source_size, target of every source of (source, size) rows; null is a source too.

    Sources by code point, null last, weigh 1..``weights``, repeating. The common level of target per weight is
    raised until no further source is over ``most`` times its size: each round is one sum over a row per source. Places
    in the order come from range partitions and the counts of those before, so no task sees all sources.
    """
    order = F.col("source").asc_nulls_last()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(order).withColumn("part", F.spark_partition_id())
    per = keep(per, "mix-sources")
    at = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    per = per.join(_before(per.withColumn("all", F.lit(1)), ["all"]).drop("all"), "part").withColumn("weight", (F.pmod(at, F.lit(weights)) + 1).cast("long"))
    per = keep(per.select("source", "source_size", "weight", (F.col("source_size") * most).alias("cap")), "mix-weights")
    total, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    level, n_capped = (total / weight if total else 0.0), 0
    while total:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        n, cap, held = per.where(over).agg(F.count(F.lit(1)), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == n_capped or held == weight:
            break
        level, n_capped = (total - cap) / (weight - held), n
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def _draw(seed: int, step: Column, a: Column, b: Column, most: Column) -> Column:
    """A whole number in [0, most), fixed by the seed and the pair."""
    return F.pmod(F.xxhash64(F.lit(seed), step, a, b), most)


def _fold(rows: Column, seed: int, level: int) -> Column:
    """Sequential transfers over an array of (uid, key, mass, full): struct(carry, done array of (uid, up)).

    ``mass`` of ``full`` units: 0 is no extra copy, full is one. The carry is the one unit left fractional.
    """
    unit = "struct<uid:bigint,key:bigint,mass:bigint,full:bigint>"
    done = "array<struct<uid:bigint,up:boolean>>"
    start = F.struct(F.lit(None).cast(unit).alias("carry"), F.array().cast(done).alias("done"))

    def settle(state_done: Column, x: Column) -> Column:
        return F.concat(state_done, F.array(F.struct(x["uid"].alias("uid"), (x["mass"] > 0).alias("up"))))

    def moved(x: Column, by: Column) -> Column:
        return F.struct(x["uid"].alias("uid"), x["key"].alias("key"), (x["mass"] + by).alias("mass"), x["full"].alias("full"))

    def whole(x: Column) -> Column:
        return (x["mass"] <= 0) | (x["mass"] >= x["full"])

    def place(state_done: Column, a: Column, b: Column) -> Column:
        """After a transfer at least one of the two is whole; both may be."""
        none = F.lit(None).cast(unit)
        return (
            F.when(whole(a) & whole(b), F.struct(none.alias("carry"), settle(settle(state_done, a), b).alias("done")))
            .when(whole(a), F.struct(b.alias("carry"), settle(state_done, a).alias("done")))
            .otherwise(F.struct(a.alias("carry"), settle(state_done, b).alias("done")))
        )

    def step(state: Column, x: Column) -> Column:
        a = state["carry"]
        to_a = F.least(a["full"] - a["mass"], x["mass"])  # what x can give to a
        to_x = F.least(a["mass"], x["full"] - x["mass"])  # what a can give to x
        # a gains to_a with odds to_x, or loses to_x with odds to_a: the expectations stay.
        by = F.when(_draw(seed, F.lit(level), a["key"], x["key"], to_a + to_x) < to_x, to_a).otherwise(-to_x)
        return (
            F.when(whole(x), F.struct(a.alias("carry"), settle(state["done"], x).alias("done")))
            .when(a.isNull(), F.struct(x.alias("carry"), state["done"].alias("done")))
            .otherwise(place(state["done"], moved(a, by), moved(x, -by)))
        )

    return F.aggregate(rows, start, step)


def pivotal_round(units: DataFrame, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(uid, up) for units (grp, uid, key, mass, full): ``up`` says the unit's fraction became a whole copy.

    Each level cuts a group's units into blocks of about ``block_rows`` by size class and a hash of key,
    folds every block, and hands the residual units, one a block, to the next. Group sums of mass
    are exact throughout; the last residual of a group goes to the nearer whole. uid must be unique; draws
    depend on key alone. The driver sees three counts a level; levels grow with the logarithm of the rows.
    """
    settled, level, pending = None, 0, units
    while True:
        # Blocks of neighbours in size lose the least to unequal sizes; their number follows the group's count.
        size_class = F.floor(F.log2(F.col("full") + 1)).cast("int") if level == 0 else F.lit(0)
        classed = pending.withColumn("cls", size_class)
        n = classed.groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("n"))
        n = keep(n.select("grp", "cls", F.ceil(F.col("n") / block_rows).cast("long").alias("blocks")), "mix-counts")
        blocks, groups = n.agg(F.sum("blocks"), F.countDistinct("grp")).first()
        dealt = classed.join(n, ["grp", "cls"]).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "key"), F.col("blocks")))
        rows = F.array_sort(F.collect_list(F.struct("full", "key", "uid", "mass")))
        rows = F.transform(rows, lambda r: F.struct(r["uid"].alias("uid"), r["key"].alias("key"), r["mass"].alias("mass"), r["full"].alias("full")))
        folded = dealt.groupBy("grp", "cls", "block").agg(rows.alias("rows")).select("grp", _fold(F.col("rows"), seed, level).alias("s"))
        folded = keep(folded, f"mix-level{level}")
        done = folded.select(F.explode("s.done").alias("d")).select("d.uid", "d.up")
        settled = done if settled is None else settled.unionByName(done)
        rest = folded.where(F.col("s.carry").isNotNull()).select("grp", "s.carry.*")
        if not blocks or blocks == groups:
            return settled.unionByName(rest.select("uid", (F.col("mass") * 2 >= F.col("full")).alias("up")))
        pending, level = rest, level + 1


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: id, row, source, size, source_size, target (its source's) and copies.

    Size is the number of words of the whole text (null and blank texts: 0, with 0 copies). A null
    source is a source of its own, last in order. Rows of one id are separate documents, told apart
    by ``row_col`` where given and by numbers of our own else. Draws depend only on the seed, ids,
    sources and sizes, so reruns agree: of rows that agree in all three the same number is taken each time. An
    empty table gives no rows; columns not named are not read.
    """
    sized = docs.select(
        col(id_col).alias("id"), col(source_col).alias("source"),
        F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
    ).withColumn("key", F.xxhash64(F.lit(seed), "id", "source", "size"))
    sized = keep(sized.withColumn("part", F.spark_partition_id()), "mix-sizes")
    repeated = keep(sized.groupBy("key").count().where(F.col("count") > block_rows).select("key", F.lit(True).alias("often")), "mix-repeated")
    if not repeated.isEmpty():
        # Rows that agree in all are numbered, part by part: whichever gets which number, the draws are the same.
        sized = sized.join(repeated, "key", "left")
        often = sized.where("often").drop("often")
        place = F.row_number().over(Window.partitionBy("key", "part").orderBy("row")) + F.col("before")
        numbered = often.join(_before(often, ["key"]), ["key", "part"]).withColumn("key", F.xxhash64("key", place)).drop("before")
        sized = keep(sized.where("often is null").drop("often").unionByName(numbered), "mix-numbered")
    targets = keep(source_targets(sized).withColumn("grp", F.xxhash64(F.col("source").isNull(), "source")), "mix-targets")
    joined = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(F.lit(0.0))
    base = F.floor(rate + 1e-12).cast("long")
    joined = joined.select(
        "d.id", "d.source", "d.size", "d.row", "d.key", "t.source_size", "t.target", "t.grp", base.alias("base"),
        F.greatest(F.lit(0), F.round((rate - base) * F.col("d.size") * UNITS).cast("long")).alias("mass"), (F.col("d.size") * UNITS).alias("full"),
    )
    units = joined.where((F.col("mass") > 0) & (F.col("mass") < F.col("full"))).select("grp", F.col("row").alias("uid"), "key", "mass", "full")
    ups = pivotal_round(units, seed, block_rows).where("up").select(F.col("uid").alias("row"), F.lit(1).alias("more"))
    more = F.coalesce(F.col("more"), F.when(F.col("mass") >= F.col("full"), 1).otherwise(0))
    unit = (F.col("mass") > 0) & (F.col("mass") < F.col("full"))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.col("base") + more, F.lit(MOST_COPIES))).cast("long")
    decided = joined.join(ups, "row", "left").select("id", "row", "key", "grp", "source", "size", "source_size", "target", taken.alias("copies"), F.when(unit, F.col("more").isNotNull()).alias("up"))
    decided = keep(decided, "mix-decided")
    out = decided.join(_handed_down(decided), "row", "left")
    copies = F.col("copies") + F.when(F.col("other").isNull(), 0).when(F.col("up"), -1).otherwise(1)
    return out.select(F.col("id").alias(id_col), "row", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def _handed_down(decided: DataFrame) -> DataFrame:
    """(row, other): the units to decide the other way, so that each source's words come nearest to its target.

    The last residual is rounded as a whole, which misses the target by up to half its size. The miss is handed
    down the size classes: from large to small, a unit is decided anew where that lessens it, and then the pair of units
    that lessens it most. ``SPARE`` units of each class and decision, by key, are enough for that, so a source's
    list is bounded whatever its size.
    """
    rank = Window.partitionBy("grp", "cls", "up").orderBy("key", "row")
    some = decided.where("up is not null").withColumn("cls", F.floor(F.log2("size"))).withColumn("k", F.row_number().over(rank)).where(F.col("k") <= SPARE)
    lists = some.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "row", F.when(F.col("up"), -F.col("size")).otherwise(F.col("size")).alias("adds")))).alias("units"))
    missing = decided.groupBy("grp").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss"))
    start = F.struct(F.col("miss").cast("double").alias("miss"), F.array().cast("array<bigint>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        after = acc["miss"] - x["adds"]
        return F.when(F.abs(after) < F.abs(acc["miss"]), F.struct(after.alias("miss"), F.concat(acc["rows"], F.array(x["row"])).alias("rows"))).otherwise(acc)

    got = lists.join(missing, "grp").select("units", F.aggregate("units", start, step).alias("s"))
    for _ in range(PAIR_ROUNDS):
        got = keep(got.select("units", "s.miss", "s.rows"), "mix-missing")
        now = F.transform("units", lambda x: F.struct(x["row"].alias("row"), F.when(F.array_contains("rows", x["row"]), -x["adds"]).otherwise(x["adds"]).alias("adds")))
        got = got.select("units", "miss", "rows", now.alias("now"))

        def both(x: Column, y: Column) -> Column:
            left = F.col("miss") - x["adds"] - y["adds"]
            return F.struct(F.abs(left).alias("far"), left.alias("miss"), F.array(x["row"], y["row"]).alias("rows"))

        pairs = F.transform("now", lambda x, i: F.array_min(F.transform(F.slice("now", i + 2, F.size("now")), lambda y: both(x, y))))
        got = keep(got.select("units", "miss", "rows", F.array_min(pairs).alias("best")), "mix-best")
        turned = F.concat(F.array_except("rows", "best.rows"), F.array_except("best.rows", "rows"))
        better = F.coalesce(F.col("best.far") < F.abs("miss"), F.lit(False))
        got = got.select("units", F.struct(F.when(better, F.col("best.miss")).otherwise(F.col("miss")).alias("miss"), F.when(better, turned).otherwise(F.col("rows")).alias("rows")).alias("s"))
    return keep(got.select(F.explode("s.rows").alias("row"), F.lit(True).alias("other")), "mix-handed")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The documents as the mix takes them: every row as often as its copies say, same columns.

    Where ids repeat, the rows are numbered and written first, so that each keeps its own decision.
    """
    if docs.groupBy(col(id_col)).count().where("count > 1 or `" + id_col.replace("`", "``") + "` is null").isEmpty():
        taken = mix(docs, id_col, text_col, source_col, seed=seed).where("copies > 0").select(F.col(id_col).alias("__id"), F.col("copies").alias("__copies"))
        joined = docs.join(taken, col(id_col) == F.col("__id"))
    else:
        docs = keep(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
        taken = mix(docs, id_col, text_col, source_col, "__row", seed).where("copies > 0").select(F.col("row").alias("__id"), F.col("copies").alias("__copies"))
        joined = docs.join(taken, F.col("__row") == F.col("__id"))
    repeated = joined.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return repeated.drop("__id", "__copies", "__n", "__row")
