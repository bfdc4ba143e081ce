"""Feature vectors and representative sampling: A8-A10, V1-V9. Vectors stay in long sparse form (item_id, idx, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.exprs import api_category, bucket_log2, hash_feature
from factweave.sources.store import large, stored


def _one(df: DataFrame, name: str, value) -> DataFrame:
    return df.select("item_id", F.concat(F.lit(f"{name}:"), value.cast("string")).alias("feature"), F.lit(1.0).alias("w"))


def feature_counter(bits: DataFrame, wl: DataFrame, degree: DataFrame, dag: DataFrame, sizes: DataFrame, functions: DataFrame, apis: DataFrame, tokens: DataFrame, categories: DataFrame) -> DataFrame:
    """(item_id, feature, w): the item's weighted features, equal ones summed.

    Structure features weigh one each; each function adds its size bucket; API:x twice its calls; API_CAT:c its calls;
    tokens and neighbouring token pairs (within a function) one for each occurrence.
    """
    near_zero = lambda c: bucket_log2(F.col(c) + 1e-9)  # noqa: E731  averages carry a tiny offset
    out = _one(bits, "BITS", F.col("bits")).unionByName(_one(wl, "WL", F.col("wl")))
    for name, c in (("CG_NODES", "n_nodes"), ("CG_EDGES", "n_edges"), ("CG_LEAVES", "leaves"), ("CG_MAX_OUT", "max_out")):
        out = out.unionByName(_one(degree, name, bucket_log2(F.col(c))))
    out = out.unionByName(_one(degree, "CG_AVG_OUT_L2", near_zero("avg_out")))
    for name, v in (("PATH_COUNT_L2", bucket_log2(F.col("path_count"))), ("PATH_MIN_LEN", F.col("min_len")), ("PATH_MAX_LEN", F.col("max_len")), ("PATH_AVG_LEN_L2", near_zero("avg_len"))):
        out = out.unionByName(_one(dag, name, v))
    for name, v in (("FUNC_CNT_L2", bucket_log2(F.col("n"))), ("FUNC_AVG_SZ_L2", near_zero("avg_size")), ("FUNC_MAX_SZ_L2", bucket_log2(F.col("max_size"))), ("FUNC_MIN_SZ_L2", bucket_log2(F.col("min_size")))):
        out = out.unionByName(_one(sizes, name, v))
    out = out.unionByName(_one(functions.where("size > 0"), "FS_BIN", bucket_log2(F.col("size"))))
    totals = apis.groupBy("item_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("uniq"))
    out = out.unionByName(_one(totals, "API_TOTAL_CALLS_L2", bucket_log2(F.col("total")))).unionByName(_one(totals, "API_UNIQUE_L2", bucket_log2(F.col("uniq"))))
    out = out.unionByName(apis.select("item_id", F.concat(F.lit("API:"), "api").alias("feature"), (F.col("n") * 2.0).alias("w")))
    out = out.unionByName(api_category(apis, categories).select("item_id", F.concat(F.lit("API_CAT:"), "category").alias("feature"), F.col("n").cast("double").alias("w")))
    bare = tokens.withColumn("tok", F.substring_index("token", ":", 1))
    after = F.lead("tok").over(Window.partitionBy("item_id", "func").orderBy("pos"))
    out = out.unionByName(bare.select("item_id", F.concat(F.lit("INSN1:"), "tok").alias("feature"), F.lit(1.0).alias("w")))
    pairs = bare.withColumn("after", after).where("after is not null")
    out = out.unionByName(pairs.select("item_id", F.concat(F.lit("INSN2:"), "tok", F.lit("|"), "after").alias("feature"), F.lit(1.0).alias("w")))
    return out.groupBy("item_id", "feature").agg(F.sum("w").alias("w"))


def hashed(counter: DataFrame, dim: int = 4096) -> DataFrame:
    """V1: signed feature hashing."""
    idx, sign = hash_feature(F.col("feature"), dim)
    return counter.select("item_id", idx.alias("idx"), (sign * F.col("w")).alias("v")).groupBy("item_id", "idx").agg(F.sum("v").alias("val")).where("val <> 0")


def document_frequency(vectors: DataFrame) -> DataFrame:
    """Per hash bucket, not per feature."""
    return vectors.groupBy("idx").agg(F.count(F.lit(1)).alias("df"))


def idf_normalised(vectors: DataFrame, n_items: int) -> DataFrame:
    """V2: smoothed IDF ln((1 + n) / (1 + df)) + 1, then unit length (a zero vector stays)."""
    df = document_frequency(vectors)  # a row for each hash bucket at most
    scaled = vectors.join(F.broadcast(df), "idx").select("item_id", "idx", (F.col("val") * (F.log(F.lit(1.0 + n_items) / (1 + F.col("df"))) + 1)).alias("val"))
    norm = F.sqrt(F.sum(F.col("val") * F.col("val")).over(Window.partitionBy("item_id")))
    return scaled.select("item_id", "idx", (F.col("val") / F.when(norm == 0, 1.0).otherwise(norm)).alias("val"))


def cluster_key(bits: DataFrame, wl: DataFrame) -> DataFrame:
    """V3: clusters are equal keys B{bits}|WL{signature}."""
    return bits.join(large(wl), "item_id").select("item_id", F.concat(F.lit("B"), F.col("bits").cast("string"), F.lit("|WL"), "wl").alias("cluster"))


def centroids(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """A10: (cluster, idx, val, weight): means over all members, absent entries being zero."""
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("weight"))
    sums = vectors.join(large(clusters), "item_id").groupBy("cluster", "idx").agg(F.sum("val").alias("s"))
    return sums.join(large(size), "cluster").select("cluster", "idx", (F.col("s") / F.col("weight")).alias("val"), "weight")


def medoids(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """V5: of each cluster the member most similar to its centroid; ties and zero centroids go to the least id."""
    mean = centroids(vectors, clusters)
    norm = mean.groupBy("cluster").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    dots = vectors.join(large(clusters), "item_id").join(mean.select("cluster", "idx", F.col("val").alias("c")), ["cluster", "idx"]).groupBy("cluster", "item_id").agg(F.sum(F.col("val") * F.col("c")).alias("dot"))
    all_ = clusters.join(dots, ["cluster", "item_id"], "left").join(norm, "cluster", "left")
    sim = F.when(F.col("norm") > 0, F.coalesce("dot", F.lit(0.0)) / F.col("norm")).otherwise(0.0)
    w = Window.partitionBy("cluster").orderBy(F.round(sim, 9).desc(), "item_id")
    return all_.withColumn("sim", sim).withColumn("k", F.row_number().over(w)).where("k = 1").select("cluster", "item_id", "sim")


def farthest_first(points: DataFrame, k: int, beta: float = 0.5) -> DataFrame:
    """V4: (key, step) of k of the points (key, weight, vec): heaviest first, then greatest (1 - nearest cosine) * log1p(weight)^beta.

    Each step is one small aggregate over all points with the last choice broadcast (a single vector); what
    points keep between steps is one number each. Ties go to the least key.
    """
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-300)))
    now = stored(points.select("key", "weight", unit(F.col("vec").cast("array<double>")).alias("u"), F.lit(-1.0).alias("near")), "v4")
    chosen = []
    score = F.when(F.lit(True), (1 - F.col("near")) * F.pow(F.log1p("weight"), beta))
    for step in range(k):
        rest = now.where(~F.col("key").isin(chosen)) if chosen else now
        rank = [F.col("weight").desc(), "key"] if step == 0 else [F.round(score, 12).desc(), "key"]
        top = rest.orderBy(*rank).limit(1).collect()
        if not top:
            break
        chosen.append(top[0]["key"])
        u = F.array(*[F.lit(float(x)) for x in top[0]["u"]])
        dot = F.aggregate(F.zip_with("u", u, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        now = stored(now.withColumn("near", F.greatest("near", dot)), "v4") if step + 1 < k else now
    kind = points.schema["key"].dataType.simpleString()
    return points.sparkSession.createDataFrame([(c, i + 1) for i, c in enumerate(chosen)], f"key {kind}, step int")


def nearest_chosen(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    """V8: (item_id, sim): similarity to the nearest chosen item; unit vectors. Items that share no entry have 0."""
    mine = vectors.join(chosen.select("item_id"), "item_id", "left_semi").select(F.col("item_id").alias("c"), "idx", F.col("val").alias("cv"))
    dots = vectors.join(mine, "idx").groupBy("item_id", "c").agg(F.sum(F.col("val") * F.col("cv")).alias("dot"))
    best = dots.groupBy("item_id").agg(F.max("dot").alias("sim"))
    return vectors.select("item_id").distinct().join(large(best), "item_id", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def sample(vectors: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """V6: k items: all if there are no more; a medoid each and then round-robin over the largest clusters if clusters are
    no more than k; else the medoids of k farthest-first clusters."""
    n = clusters.count()
    if k >= n:
        return clusters.select("item_id")
    first = stored(medoids(vectors, clusters).select("cluster", "item_id"), "v6")
    n_clusters = first.count()
    if n_clusters <= k:
        return _round_robin(vectors, clusters, first, k)
    mean = centroids(vectors, clusters)
    dense = mean.groupBy("cluster", "weight").agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("m"))
    spots = [r[0] for r in mean.select("idx").distinct().orderBy("idx").collect()]  # at most the hash dimension
    points = dense.select(F.col("cluster").alias("key"), F.col("weight").cast("double").alias("weight"), F.array(*[F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0.0)) for s in spots]).alias("vec"))
    picked = farthest_first(points, k).select(F.col("key").alias("cluster"))
    return first.join(picked, "cluster", "left_semi").select("item_id")


def _round_robin(vectors: DataFrame, clusters: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """V6: the medoids, and in turns, the largest clusters first, each cluster's member least like those chosen of it so far.

    There are no more than k clusters, so their sizes are few; a turn serves all clusters at once.
    """
    sizes = [r["n"] for r in clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()]
    turns, missing = 0, k - len(sizes)
    while sum(min(n - 1, turns) for n in sizes) < missing:
        turns += 1
    members = stored(vectors.join(large(clusters), "item_id").select("item_id", "cluster", "idx", "val"), "v6-members")
    near = stored(clusters.join(first.select("item_id"), "item_id", "left_anti").select("item_id", "cluster", F.lit(-2.0).alias("near")), "v6-near")
    last, picked = first, None
    for turn in range(1, turns + 1):
        with_last = members.join(last.select("item_id"), "item_id", "left_semi").select("cluster", "idx", F.col("val").alias("c"))
        dots = members.join(with_last, ["cluster", "idx"]).groupBy("item_id").agg(F.sum(F.col("val") * F.col("c")).alias("dot"))
        near = near.join(large(dots), "item_id", "left").select("item_id", "cluster", F.greatest("near", F.coalesce("dot", F.lit(0.0))).alias("near"))
        near = stored(near, "v6-near")
        last = stored(near.groupBy("cluster").agg(F.min(F.struct(F.round("near", 9).alias("near"), "item_id")).alias("b")).select("cluster", "b.item_id"), "v6-last")
        near = near.join(last.select("item_id"), "item_id", "left_anti")
        now = last.withColumn("turn", F.lit(turn))
        picked = now if picked is None else picked.unionByName(now)
    if picked is None:
        return first.select("item_id")
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("weight"))
    more = picked.join(size, "cluster").orderBy("turn", F.desc("weight"), "cluster").limit(missing)
    return first.select("item_id").unionByName(more.select("item_id"))


def stratified_sample(vectors: DataFrame, clusters: DataFrame, bits: DataFrame, k: int) -> DataFrame:
    """V7: places per word size, sampled apart and merged; what is missing is topped up by ascending similarity.

    Items of unknown word size come in only through the top-up, unless nothing else exists.
    """
    from factweave.operators.aggregates import allocation

    counts = {r["bits"]: r["n"] for r in bits.groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect()}  # three at most
    strata = [(b, counts[b]) for b in (32, 64) if counts.get(b)] or sorted(counts.items())
    out = None
    for b, places in allocation(strata, k).items():
        ids = large(bits.where(F.col("bits") == b).select("item_id"))
        part = sample(vectors.join(ids, "item_id", "left_semi"), clusters.join(ids, "item_id", "left_semi"), places)
        out = part if out is None else out.unionByName(part)
    out = stored(out.distinct(), "v7")
    missing = min(k, clusters.count()) - out.count()
    if missing > 0:
        near = nearest_chosen(vectors, out)
        extra = clusters.join(out, "item_id", "left_anti").join(large(near), "item_id", "left").orderBy(F.round(F.coalesce("sim", F.lit(0.0)), 9), "item_id").limit(missing)
        out = out.unionByName(extra.select("item_id"))
    return out


def principal_components(dense: DataFrame, k: int = 3) -> DataFrame:
    """V9: (item_id, pc1..pck) of dense vectors (item_id, vec), centred; signs are arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = dense.select("item_id", array_to_vector(F.col("vec").cast("array<double>")).alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=False).fit(rows).transform(rows)
    got = PCA(k=k, inputCol="x", outputCol="pc").fit(centred).transform(centred).withColumn("a", vector_to_array("pc"))
    return got.select("item_id", *[F.col("a")[i].alias(f"pc{i + 1}") for i in range(k)])


