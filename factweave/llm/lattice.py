"""Embedding near-duplicates by lattice hashing.

Vectors are projected at random to eight dimensions, once a table, and decoded to the nearest point of the E8
lattice: its cell. A vector lies in its own cell and probes the nearest neighbouring cells; pairs that meet in
a cell are verified by cosine in double precision. With the defaults a pair at cosine 0.93 meets in one table
with probability 0.82 and in one of the four with 0.999 (simulated and tested).

Equal vectors are one class, so copies cost nothing. A cell of many vectors is cut into chunks, and pairs of
chunks are tasks of bounded size. Pairs are counted and joined up inside the tasks, each pair once (in the first
table where it meets), so what is emitted is linear in the vectors of a chunk, never its pairs.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, importable, keep
from .components import components

TABLES, PROBES, SCALE = 4, 8, 2.0
COSINE = 0.93
CHUNK = 512


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    halves = [np.asarray(c) for c in itertools.product((0.5, -0.5), repeat=8)]
    return np.asarray(out + [c for c in halves if (c < 0).sum() % 2 == 0])


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the worst entry the other way."""
    point = np.rint(x)
    off = x - point
    odd = np.flatnonzero(point.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is the even integer points and the same moved by a half in every direction."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@lru_cache(maxsize=8)
def projections(dim: int, tables: int, scale: float, seed: int = 11) -> np.ndarray:
    """tables x dim x 8: random orthonormal directions (Gaussian where there are fewer than eight dimensions)."""
    rng = np.random.default_rng((seed, dim))
    out = []
    for _ in range(tables):
        g = rng.normal(size=(dim, 8))
        out.append((np.linalg.qr(g)[0] * np.sqrt(dim / 8) if dim >= 8 else g / np.sqrt(8)) * scale)
    return np.asarray(out)


_ODD = np.random.default_rng(29).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _key(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit names of cells: (..., 8) lattice points, salted by group and table."""
    h = ((2 * points).astype(np.int64).view(np.uint64) * _ODD).sum(-1, dtype=np.uint64) ^ salt
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def cells(unit: np.ndarray, group: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """n x tables x (1 + probes) cell keys: the own cell, then the nearest of its neighbours' cells."""
    out = np.empty((len(unit), tables, 1 + probes), dtype=np.int64)
    for t, a in enumerate(projections(unit.shape[1], tables, scale)):
        x = unit @ a
        home = decode(x)
        near = (x - home) @ neighbours().T
        pick = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None], home[:, None] + neighbours()[pick]], axis=1)
        salt = (group.view(np.uint64) + np.uint64((t + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))[:, None]
        out[:, t] = _key(points, salt)
    return out


def _named(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, grp, ck, vec): grp names label and dimension, ck label and contents; null where a vector can't link."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("grp", T.LongType()), T.StructField("ck", T.StringType()), T.StructField("vec", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                rows = []
                for i, v, label in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    x = np.asarray(v, dtype=np.float64) if v and None not in v else None
                    if i is None or label is None or x is None or not np.isfinite(x).all() or not x.any():
                        rows.append((i, None, None, None))
                        continue
                    raw = (x + 0.0).tobytes()
                    grp = xxhash.xxh3_64_intdigest(f"{label}:{len(x)}") - (1 << 63)
                    rows.append((i, grp, xxhash.xxh3_128_hexdigest(raw + str(label).encode()), raw))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=[f.name for f in schema])

    return df.select(col(id_col).cast("long"), col(vec_col), col(label_col).cast("string")).mapInArrow(run, schema)


def _unit(vecs: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v, dtype=np.float64) for v in vecs])
    # Scaled by the largest entry first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _table(classes: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    """(key, id, home) of every class: its cells in all tables."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("home", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, groups = (np.asarray(part.column(k), dtype=np.int64) for k in (0, 1))
                vecs = part.column(2).to_pylist()
                for size in {len(v) for v in vecs}:
                    at = np.asarray([k for k, v in enumerate(vecs) if len(v) == size])
                    keys = cells(_unit([vecs[k] for k in at]), groups[at], tables, probes, scale)
                    home = np.zeros(keys.shape, dtype=bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[at], keys[0].size)), pa.array(home.ravel())], names=["key", "id", "home"])

    return classes.select("id", "grp", "vec").mapInArrow(run, schema)


def _first_meetings(k: np.ndarray, i: np.ndarray, j: np.ndarray, ids: np.ndarray, key: int) -> np.ndarray:
    """Which of the pairs (i, j), whose rows of ``k`` are their cells, are to be counted in cell ``key``.

    A pair meets where their own cells agree or one probes the other's own cell. It counts in the first
    table where it meets: in the common own cell; else in the own cell that the pair's lower id probes; else in the
    one that its upper id probes.
    """
    low, high = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
    where = np.zeros(len(i), dtype=np.int64)
    found = np.zeros(len(i), dtype=bool)
    for t in range(k.shape[1]):
        a, b = k[low, t], k[high, t]
        down, up = (a == b[:, :1]).any(1), (b == a[:, :1]).any(1)  # own cells that agree show in both
        hit = ~found & (down | up)
        where[hit] = np.where(down, b[:, 0], a[:, 0])[hit]
        found |= hit
    return found & (where == key)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable number of each of n nodes."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _meet(key: int, ids: np.ndarray, mult: np.ndarray, groups: np.ndarray, unit: np.ndarray, home: np.ndarray, side: np.ndarray, across: bool, how: tuple) -> tuple | None:
    """Links counted in one chunk pair of a cell: ids, numbers of linked vectors, and roots by links."""
    cosine, tables, probes, scale = how
    cos = unit @ unit.T
    ok = (cos >= cosine) & (home[:, None] | home[None]) & (groups[:, None] == groups[None])
    if across:
        ok &= side[:, None] != side[None]
    i, j = np.nonzero(np.triu(ok, 1))
    if not len(i):
        return None
    used = np.unique(np.concatenate([i, j]))
    order = used[np.argsort(ids[used])]
    short = np.empty(len(ids), dtype=np.int64)
    short[order] = np.arange(len(order))
    k = cells(unit[order], groups[order], tables, probes, scale)
    links = np.zeros(len(order), dtype=np.int64)
    for a in range(0, len(i), 1 << 17):
        x, y = short[i[a : a + (1 << 17)]], short[j[a : a + (1 << 17)]]
        counts = _first_meetings(k, x, y, ids[order], key)
        np.add.at(links, x[counts], mult[order][y[counts]])
        np.add.at(links, y[counts], mult[order][x[counts]])
    return ids[order], links, ids[order][_roots(len(order), short[i], short[j])]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (least id reachable), kept.

    Vectors are compared only within equal labels (and dimensions). A null id, label or vector, a null or
    non-finite component and the zero vector link with nothing and keep their own id. Copies link with each
    other. Rows that share an id are vectors of their own, each with its own links, and the id counts for the
    components of all of them. An empty table gives no rows; other columns are not read.
    """
    importable(df.sparkSession)
    how = (cosine, tables, probes, scale)
    named = keep(_named(df, id_col, vec_col, label_col), "lat-named")
    classes = named.where("ck is not null").groupBy("ck").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m"), F.first("grp").alias("grp"), F.first("vec").alias("vec"))
    # A class is named by half its contents' hash, as several can have the same least id.
    classes = keep(classes.withColumn("id", F.xxhash64("ck")), "lat-classes")
    keys = keep(_table(classes, tables, probes, scale), "lat-cells")
    # Cells where a pair can meet: one own cell at least, and company.
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where("n > 1 and any").select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    rows = keys.join(met, "key").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "home", "id").join(classes.select("id", "m", "grp", "vec"), "id")
    grouped = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").select("key", "x", "y", "mine", "home", "id", "m", "grp", "vec")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType())])

    def run(batches):
        import pyarrow as pa

        def groups():
            """Runs of equal (key, x, y) in the sorted rows, across batches."""
            now, held = None, []
            for batch in batches:
                cols = [np.asarray(batch.column(k)) for k in range(8)] + [batch.column(8).to_pylist()]
                spot = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
                for a, b in zip([0, *spot], [*spot, batch.num_rows], strict=True):
                    if a == b:
                        continue
                    name = tuple(c[a] for c in cols[:3])
                    if name != now and held:
                        yield now, held
                        held = []
                    now = name
                    held.append([c[a:b] for c in cols[3:]])
            if held:
                yield now, held

        out, n_out = [], 0
        for (key, x, y), held in groups():
            side, home, ids, mult, grp = (np.concatenate([h[k] for h in held]) for k in range(5))
            if len(ids) < 2:
                continue
            vecs = [v for h in held for v in h[5]]
            for size in {len(v) for v in vecs}:
                at = np.asarray([k for k, v in enumerate(vecs) if len(v) == size])
                got = _meet(int(key), ids[at], mult[at], grp[at], _unit([vecs[k] for k in at]), home[at].astype(bool), side[at], x != y, how)
                if got is not None:
                    out.append(got)
                    n_out += len(got[0])
            if n_out >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "links", "root"])
                out, n_out = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "links", "root"])

    found = keep(grouped.mapInArrow(run, schema), "lat-found")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    roots = keep(components(found.where("id <> root").select("id", "root").distinct(), "id", "root").withColumnsRenamed({"node": "rep"}), "lat-roots")
    ids = classes.select("ck", F.col("id").alias("rep"), "least", "m")
    firsts = roots.join(ids, "rep").groupBy("root").agg(F.min("least").alias("first"))
    reached = keep(roots.join(firsts, "root").select("rep", "first"), "lat-reached")
    out = named.select("id", "ck").join(ids, "ck", "left").join(links, "rep", "left").join(reached, "rep", "left")
    component = F.coalesce("first", "least", "id")
    return out.select(F.col("id").alias(id_col), (F.coalesce(F.col("m") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
