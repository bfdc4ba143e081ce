"""Exact N-gram Jaccard self-join with set-relation skipping.

Texts are sets of word shingles; equal sets are one class. Every set indexes the prefix of its shingles in one
global order (seldom ones first, frequent ones, estimated from all texts, last): two sets that link
share a shingle of their prefixes, whatever the order. Two relations then save work:

* Index lists are cut into blocks of equal set size and position, and whole pairs of blocks are skipped where size
  or position rules a link out.
* Where a list is long, a few of its sets (leaders) are compared with all others first. Sets found similar to a
  leader get their further answers from the leader's: members of one component need no comparison, and
  overlaps with a common leader bound the overlap of a pair from both sides, so most pairs are decided unseen.

What is left is verified on the whole sets. No pair of different components is lost, and no group is expanded
into all its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, importable, keep
from .components import components

GRAM = 4
PERCENT = 85
#: Entries of the table of frequent shingles. It only orders shingles, so its bound costs time at worst, no links.
FREQUENT = 1 << 18
#: A shingle counts as frequent in a block of shingles from so many texts on.
LEAST_COUNT = 4
COUNT_BLOCK = 2_000_000
#: Lists of more sets go by leaders first; leaders of a list.
LONG_LIST, LEADERS = 8, 2
#: Sets that are compared with one leader in one task.
MEMBERS = 512
#: Leaders a set's bounds are taken from at most.
BOUNDS_FROM = 16
#: Sets of a long list that are compared at once.
CHUNK = 512
CHUNK_ENTRIES = 100_000


class Shingler:
    """Distinct 64-bit shingle hashes of a text, ascending."""

    MOST = 400_000

    def __init__(self, gram: int):
        self.gram = gram
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None):
        import numpy as np
        import xxhash

        # Bytes lower-case A-Z only and split at ASCII white space only, as the definition says.
        words = text.encode("utf-8", "replace").lower().split() if text else []
        if not words:
            return np.empty(0, np.int64)
        known = self.words
        if len(known) > self.MOST:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.gram, len(words))
        mixed = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            mixed = (mixed ^ h[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed.view(np.int64))


def _set_id(shingles) -> int:
    """Names a set by its contents, in 64 bits."""
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


def survey(docs: DataFrame, id_col: str, text_col: str, gram: int) -> DataFrame:
    """One pass over the texts: rows of kind 0 name each document's set, rows of kind 1 count frequent shingles."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("set_id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("token", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingle = Shingler(gram)
        names = [f.name for f in schema]

        def rows(kind, a, b, c, d, e):
            n = len(a if a is not None else d)
            cols = [pa.array([kind] * n, pa.int32())] + [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (a, b, c, d, e)]
            return pa.RecordBatch.from_arrays(cols, names=names)

        held, n_held = [], 0

        def counted():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LEAST_COUNT
            return rows(1, None, None, None, tokens[often], n[often])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingle(t) for t in part.column(1).to_pylist()]
                yield rows(0, part.column(0).cast(pa.int64()), [_set_id(s) for s in sets], [len(s) for s in sets], None, None)
                held += sets
                n_held += sum(map(len, sets))
                if n_held >= COUNT_BLOCK:
                    yield counted()
                    held, n_held = [], 0
        if held:
            yield counted()

    return docs.select(col(id_col).cast("long").alias("doc"), col(text_col)).mapInArrow(run, schema)


def index(docs: DataFrame, text_col: str, gram: int, percent: int, frequent) -> DataFrame:
    """(token, set_id, size, pos) of every set's prefix; a task names equal sets once."""
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("set_id", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("pos", T.IntegerType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingle, (often, counts) = Shingler(gram), frequent.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]]
                for text in batch.column(0).slice(start, 256).to_pylist():
                    s = shingle(text)
                    name = (_set_id(s), len(s))
                    if not len(s) or name in seen:
                        continue
                    seen.add(name)
                    p = prefix_length(len(s), percent)
                    first = s
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        first = s[np.argsort(np.where(often[at] == s, counts[at], 0), kind="stable")]
                    for k, x in enumerate((first[:p], np.full(p, name[0], np.int64), np.full(p, name[1], np.int32), np.arange(p, dtype=np.int32))):
                        out[k].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=[f.name for f in schema])

    return docs.select(col(text_col)).mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, gram: int) -> DataFrame:
    """(set_id, size, tokens) of the wanted (doc, set_id, size), from their texts again."""
    texts = docs.select(col(id_col).cast("long").alias("doc"), col(text_col).alias("text")).join(wanted, "doc").dropDuplicates(["set_id", "size"]).select("set_id", "size", "text")
    schema = T.StructType([T.StructField("set_id", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        shingle = Shingler(gram)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                tokens = pa.array([shingle(t) for t in part.column(2).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), tokens], names=["set_id", "size", "tokens"])

    return texts.mapInArrow(run, schema)


def _needed(percent: int, a, b):
    """The least overlap that links sets of sizes a and b: percent of the union at least."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - 1e-9).cast("long")


def _overlaps(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, gram: int, tag: str) -> DataFrame:
    """(a, a_size, b, b_size, overlap) of pairs, counted on the whole sets.

    The pairs of an ``a`` are dealt out ``MEMBERS`` at a time: its set goes once to each of these groups, however many
    pairs it has, and meets the sets of its partners there one by one.
    """
    ends = pairs.select(F.col("a").alias("set_id"), F.col("a_size").alias("size")).unionByName(pairs.select(F.col("b").alias("set_id"), F.col("b_size").alias("size"))).distinct()
    wanted = classes.join(ends, ["set_id", "size"], "left_semi").select(F.col("rep").alias("doc"), "set_id", "size")
    sets = keep(_sets(docs, wanted, id_col, text_col, gram), f"jac-sets-{tag}")
    groups = keep(pairs.groupBy("a", "a_size").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("groups")), f"jac-groups-{tag}")
    # A partner that many share can be a hot key of this join, which Spark splits.
    partners = pairs.select("a", "a_size", "b", "b_size").join(groups, ["a", "a_size"]).join(sets.select(F.col("set_id").alias("b"), F.col("size").alias("b_size"), "tokens"), ["b", "b_size"])
    partners = partners.select("a", "a_size", F.pmod(F.xxhash64("b", "b_size"), F.col("groups")).cast("int").alias("grp"), "b", "b_size", "tokens")
    firsts = groups.join(sets.select(F.col("set_id").alias("a"), F.col("size").alias("a_size"), "tokens"), ["a", "a_size"])
    firsts = firsts.select("a", "a_size", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("int").alias("b_size"), "tokens")
    dealt = firsts.unionByName(partners).repartition("a", "a_size", "grp").sortWithinPartitions("a", "a_size", "grp", F.col("b").asc_nulls_first())
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("a_size", T.IntegerType()), T.StructField("b", T.LongType()), T.StructField("b_size", T.IntegerType()), T.StructField("overlap", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        mine = None
        for batch in batches:
            out = []
            ids, sizes, bs, b_sizes = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            lists = batch.column(5)
            ends, values = np.asarray(lists.offsets), np.asarray(lists.values)
            for k, b in enumerate(bs):
                tokens = values[ends[k] : ends[k + 1]]
                if b is None:
                    mine = tokens.copy()
                    continue
                # Both ascend without repeats: where does each of the fewer lie among the more?
                few, many = (mine, tokens) if len(mine) < len(tokens) else (tokens, mine)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                out.append((ids[k], sizes[k], b, b_sizes[k], int((many[at] == few).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[f.name for f in schema])

    return keep(dealt.select("a", "a_size", "grp", "b", "b_size", "tokens").mapInArrow(run, schema), f"jac-overlap-{tag}")


def _stars(lists: DataFrame, percent: int) -> DataFrame:
    """(a, a_size, b, b_size) to compare first: the sets of long lists, b, with their lists' leaders, a.

    Only a way to find most links early: pairs passed over here come up again among the lists.
    """
    long = lists.where(F.col("n_list") > LONG_LIST)
    # Sets that lie in many long lists differ little from their neighbours: the best leaders.
    central = long.groupBy("set_id").agg(F.count(F.lit(1)).alias("score"))
    rank = Window.partitionBy("token").orderBy(F.desc("score"), "set_id")
    lead = long.join(central, "set_id").withColumn("k", F.row_number().over(rank)).where(F.col("k") <= LEADERS)
    lead = lead.select("token", F.col("set_id").alias("a"), F.col("size").alias("a_size"))
    star = long.select("token", F.col("set_id").alias("b"), F.col("size").alias("b_size")).join(lead, "token").where("a <> b")
    star = star.groupBy("a", "a_size", "b", "b_size").agg(F.count(F.lit(1)).alias("c"))
    least = F.least("a_size", "b_size")
    return star.where((least * 100 >= F.greatest("a_size", "b_size") * percent) & (F.col("c") * 4 >= (100 - percent) * least / 100)).drop("c")


def _labels(links: DataFrame) -> DataFrame:
    """(set_id, root): equal roots are joined by links, though not all that are joined have equal ones.

    A set's root is the least set linked to its least neighbour: two steps, whatever the links.
    """
    both = links.select(F.col("a").alias("set_id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("set_id"), F.col("a").alias("other")))
    near = keep(both.groupBy("set_id").agg(F.least(F.min("other"), F.col("set_id")).alias("root")), "jac-near")
    far = near.select(F.col("set_id").alias("root"), F.col("root").alias("far"))
    return near.join(far, "root").select("set_id", F.col("far").alias("root"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, class_id, class_size, component_id.

    Sets link when 100 * intersection >= ``percent`` * union. class_id is the least id with the same set,
    component_id the least id reachable by links. Null, empty and blank texts have no shingles, are
    alone in their class and link with nothing; texts of fewer than ``gram`` words are one shingle. Rows of one
    id are joined by their texts; a null id stays alone unless its text is shared. An empty table gives
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    importable(spark)
    seen = keep(survey(docs, id_col, text_col, gram), "jac-survey")
    named = seen.where("kind = 0").select("doc", "set_id", F.col("size").cast("int").alias("size"))
    top = seen.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT)
    classes = keep(named.where("size > 0").groupBy("set_id", "size").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("class_size")), "jac-classes")

    import numpy as np

    rows = top.toArrow()  # FREQUENT rows of 16 bytes at most
    tokens, counts = np.asarray(rows["token"], dtype=np.int64), np.asarray(rows["n"], dtype=np.int64)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], counts[order]))
    del rows, tokens, counts, order

    # Lists with two different sets at least; most shingles are in one set only.
    by_token = Window.partitionBy("token")
    entries = index(docs, text_col, gram, percent, frequent)
    entries = entries.withColumn("lo", F.min("set_id").over(by_token)).withColumn("hi", F.max("set_id").over(by_token)).where("lo <> hi").drop("lo", "hi").distinct()
    lists = keep(entries, "jac-entries")
    frequent.unpersist()
    lists = keep(lists.join(lists.groupBy("token").agg(F.count(F.lit(1)).alias("n_list")), "token"), "jac-lists")

    known = links = comps = None  # (a leader, b, overlap), links and roots so far
    star = keep(_stars(lists, percent), "jac-star")
    if not star.isEmpty():
        known = _overlaps(star, docs, classes, id_col, text_col, gram, "star")
        links = known.where(F.col("overlap") >= _needed(percent, F.col("a_size"), F.col("b_size"))).select("a", "b")
        comps = keep(_labels(links), "jac-roots")

    # Every other pair of sets that share an entry, with the number of entries they share; components are skipped whole.
    per_set = lists.groupBy("set_id").agg(F.count(F.lit(1)).cast("int").alias("n_set"))
    if comps is not None:
        per_set = per_set.join(comps, "set_id", "left")
    root = F.col("set_id") if comps is None else F.coalesce("root", "set_id")
    entries = keep(lists.join(per_set.withColumn("root", root), "set_id"), "jac-rooted")
    long = entries.where(F.col("n_list") > LONG_LIST)
    if comps is not None:  # lists of one component have nothing left to say
        open_lists = long.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
        long = long.join(open_lists, "token", "left_semi")
    pairs = _short_pairs(entries.where(F.col("n_list") <= LONG_LIST), percent).unionByName(_long_pairs(keep(long, "jac-long"), percent))
    pairs = pairs.groupBy("a", "a_size", "b", "b_size").agg(F.sum("c").alias("c"))
    # One of the two prefixes lies wholly before the other's end: its shingles that are not shared are lost for good.
    need = _needed(percent, F.col("a_size"), F.col("b_size"))
    left_over = lambda size: F.ceil(F.col(size) * percent / 100.0 - 1e-9) - 1 + F.col("c")  # noqa: E731  size - (prefix - c)
    pairs = keep(pairs.where((left_over("a_size") >= need) | (left_over("b_size") >= need)).drop("c"), "jac-found")
    if known is not None:
        pairs = _bounded(pairs, known, percent)
    pairs = keep(pairs, "jac-pairs")
    derived = "low >= need" if known is not None else "false"
    open_pairs = pairs.where(f"not ({derived})")
    if not open_pairs.isEmpty():
        got = _overlaps(open_pairs, docs, classes, id_col, text_col, gram, "rest")
        fresh = got.where(F.col("overlap") >= _needed(percent, F.col("a_size"), F.col("b_size"))).select("a", "b")
        links = fresh if links is None else links.unionByName(fresh)
    if known is not None:
        links = links.unionByName(pairs.where(derived).select("a", "b"))

    reps = classes.select("set_id", "rep")
    if links is None:
        roots = spark.createDataFrame([], "node long, root long")
    else:
        ends = links.join(reps.withColumnsRenamed({"set_id": "a", "rep": "ra"}), "a").join(reps.withColumnsRenamed({"set_id": "b", "rep": "rb"}), "b")
        roots = components(ends, "ra", "rb")
    out = named.join(classes, ["set_id", "size"], "left").join(roots, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("doc").alias(id_col), F.col("size").cast("long").alias("n_shingles"), F.coalesce("rep", "doc").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("root", "rep", "doc").alias("component_id"))


def _short_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, a_size, b, b_size, c = 1) for each shared entry of a short list, where size and position allow a link."""
    one, two = entries.alias("one"), entries.alias("two")
    s1, s2, p1, p2 = F.col("one.size"), F.col("two.size"), F.col("one.pos"), F.col("two.pos")
    reach = F.least(p1, p2) + 1 + F.least(s1 - p1 - 1, s2 - p2 - 1)
    on = (F.col("one.token") == F.col("two.token")) & (F.col("one.set_id") < F.col("two.set_id")) & (F.col("one.root") != F.col("two.root"))
    on = on & (F.least(s1, s2) * 100 >= F.greatest(s1, s2) * percent) & (reach >= _needed(percent, s1, s2))
    return one.join(two, on).select(F.col("one.set_id").alias("a"), s1.alias("a_size"), F.col("two.set_id").alias("b"), s2.alias("b_size"), F.lit(1).cast("long").alias("c"))


def _long_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, a_size, b, b_size, c) from long lists, c being the shared entries among the lists of one leader.

    Lists of one leader, their most central set, share most of their sets, so they are compared together: a pair
    comes out once a leader, not once an entry. A leader's sets are cut into chunks, and pairs of chunks are tasks
    of bounded size.
    """
    score = entries.groupBy("set_id").agg(F.count(F.lit(1)).alias("score"))
    lead = entries.join(score, "set_id").groupBy("token").agg(F.min_by("set_id", F.struct(-F.col("score"), "set_id")).alias("leader"))
    led = entries.join(lead, "token")
    sizes = led.groupBy("leader", "set_id").agg(F.count(F.lit(1)).alias("n")).groupBy("leader").agg(F.sum("n").alias("n_entries"), F.count(F.lit(1)).alias("n_sets"))
    sizes = sizes.select("leader", F.ceil(F.greatest(F.col("n_entries") / CHUNK_ENTRIES, F.col("n_sets") / CHUNK)).cast("int").alias("chunks"))
    dealt = led.join(sizes, "leader").withColumn("mine", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("leader", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "token", "set_id", "size", "pos", "root", "n_set")
    dealt = dealt.repartition("leader", "x", "y").sortWithinPartitions("leader", "x", "y")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("a_size", T.IntegerType()), T.StructField("b", T.LongType()), T.StructField("b_size", T.IntegerType()), T.StructField("c", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def groups():
            now, held = None, []
            for batch in batches:
                cols = [np.asarray(batch.column(k)) for k in range(10)]
                spot = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
                for a, b in zip([0, *spot], [*spot, batch.num_rows], strict=True):
                    if a == b:
                        continue
                    name = tuple(int(c[a]) for c in cols[:3])
                    if name != now and held:
                        yield now, held
                        held = []
                    now = name
                    held.append([c[a:b] for c in cols[3:]])
            if held:
                yield now, held

        for (_, x, y), held in groups():
            side, token, ids, size, pos, root, n_set = (np.concatenate([h[k] for h in held]).astype(np.int64) for k in range(7))
            got = _compare(x != y, side, token, ids, size, pos, root, n_set, percent)
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=[f.name for f in schema])

    return dealt.mapInArrow(run, schema)


def _compare(across, side, token, ids, size, pos, root, n_set, percent):
    """The pairs of one chunk pair that may link, with the entries they share; None if there are none.

    The arguments after ``across`` have a value an entry.
    """
    import numpy as np

    def needed(a, b):
        return -(-percent * (a + b) // (100 + percent))

    sets, at, of = np.unique(ids, return_index=True, return_inverse=True)
    size_of, root_of, side_of, n_of = size[at], root[at], side[at], n_set[at]
    if len(np.unique(root_of)) < 2:
        return None
    ok = (root_of[:, None] != root_of) & (np.minimum(size_of[:, None], size_of) * 100 >= np.maximum(size_of[:, None], size_of) * percent)
    if across:
        ok &= side_of[:, None] != side_of
    ok = np.triu(ok, 1)
    if not ok.any():
        return None
    # Within a list, blocks of equal size and position are ruled in or out as a whole.
    common = np.zeros(ok.shape, dtype=np.int32)
    order = np.argsort(token, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(token[order])) + 1):
        block, where = np.unique(np.stack([size[rows], pos[rows]], axis=1), axis=0, return_inverse=True)
        s, p = block[:, 0], block[:, 1]
        reach = np.minimum(p[:, None], p) + 1 + np.minimum((s - p)[:, None], s - p) - 1
        near = reach >= needed(s[:, None], s)
        where = where.reshape(-1)
        if near.all():
            common[np.ix_(of[rows], of[rows])] += 1
        elif near.any():
            common[np.ix_(of[rows], of[rows])] += near[where][:, where]
    # What the two share outside these lists is at most what each has outside them.
    rest = n_of - np.bincount(of, minlength=len(sets))
    base, need = -(-percent * size_of // 100) - 1, needed(size_of[:, None], size_of)
    most = common + np.minimum(rest[:, None], rest)
    ok &= (common > 0) & ((base[:, None] + most >= need) | (base + most >= need))
    i, j = np.nonzero(ok)
    if not len(i):
        return None
    return sets[i], size_of[i].astype(np.int32), sets[j], size_of[j].astype(np.int32), common[i, j].astype(np.int64)


def _bounded(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs with need and low, without those that their overlaps with common leaders rule out.

    A leader X with overlaps x and y with the two sets leaves |A & B| between x + y - |X| and
    min(x, y) + min(|A| - x, |B| - y).
    """
    each = known.select("a", "a_size", "b", "b_size", "overlap")
    entry = lambda m, l: each.select(F.col(m).alias("set_id"), F.struct(F.col(l).alias("l"), F.col(f"{l}_size").cast("long").alias("n"), F.col("overlap").alias("o")).alias("e"))  # noqa: E731, E741
    selfs = lambda m: each.select(F.col(m).alias("set_id"), F.struct(F.col(m).alias("l"), F.col(f"{m}_size").cast("long").alias("n"), F.col(f"{m}_size").cast("long").alias("o")).alias("e"))
    # A set met few leaders, but a leader met many sets: only what each set has with those it met as the other end, bounded.
    rows = entry("a", "b").unionByName(entry("b", "a")).unionByName(selfs("a")).unionByName(selfs("b")).distinct()
    rank = Window.partitionBy("set_id").orderBy(F.col("e.l"))
    rows = rows.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= BOUNDS_FROM)
    met = keep(rows.groupBy("set_id").agg(F.collect_list("e").alias("met")), "jac-met")
    both = pairs.join(met.withColumnsRenamed({"set_id": "a", "met": "ma"}), "a", "left").join(met.withColumnsRenamed({"set_id": "b", "met": "mb"}), "b", "left")
    shared = F.flatten(F.transform("ma", lambda x: F.transform(F.filter("mb", lambda y: y["l"] == x["l"]), lambda y: F.struct(x["n"].alias("n"), x["o"].alias("x"), y["o"].alias("y")))))
    both = both.withColumn("via", F.coalesce(shared, F.array().cast("array<struct<n:bigint,x:bigint,y:bigint>>"))).drop("ma", "mb")
    low = F.coalesce(F.array_max(F.transform("via", lambda v: v["x"] + v["y"] - v["n"])), F.lit(0))
    high = F.coalesce(F.array_min(F.transform("via", lambda v: F.least(v["x"], v["y"]) + F.least(F.col("a_size") - v["x"], F.col("b_size") - v["y"]))), F.least("a_size", "b_size").cast("long"))
    both = both.withColumn("need", _needed(percent, F.col("a_size"), F.col("b_size"))).withColumn("low", low)
    return both.where(high >= F.col("need")).drop("via")
