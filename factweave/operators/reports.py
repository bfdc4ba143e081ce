"""Sinks K1-K8: documents and files that results are written as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_documents(items: DataFrame) -> DataFrame:
    """K1: a JSON document for each item (item_id, json), ready for ``write.text`` or one file."""
    rest = [c for c in items.columns if c != "item_id"]
    return items.select("item_id", F.to_json(F.struct(*rest)).alias("json"))


def corpus_document(meta: dict, items: DataFrame) -> DataFrame:
    """K1: the single {meta, items} document (for exports whose items fit one file; empty input gives empty items)."""
    docs = feature_documents(items).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.to_json(F.array("item_id")).substr(F.lit(2), F.length(F.to_json(F.array("item_id"))) - 2), F.lit(":"), "json"))), ",").alias("all"))
    import json

    return docs.select(F.concat(F.lit('{"meta":' + json.dumps(meta) + ',"items":{'), "all", F.lit("}}")).alias("value"))


def sample_document(chosen: DataFrame, coverage: DataFrame) -> DataFrame:
    """K2: {selected, coverage}."""
    picked = chosen.agg(F.array_sort(F.collect_list(F.struct(*chosen.columns))).alias("selected"))
    stats = coverage.select(F.struct(*coverage.columns).alias("coverage"))
    return picked.join(F.broadcast(stats)).select(F.to_json(F.struct("selected", "coverage")).alias("value"))  # one row each


def import_map(catalog: DataFrame, as_list: bool = False) -> DataFrame:
    """K3: the import catalog by function name: one JSON object, or with ``as_list`` one row each."""
    rows = catalog.select("func", F.to_json(F.struct("lib", "proto")).alias("json")).orderBy("func")
    if as_list:
        return rows
    entry = F.struct("func", F.struct("lib", "proto").alias("v"))
    return catalog.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def write_once(df: DataFrame, path: str, fmt: str = "json") -> bool:
    """K4, K5: writes through the committer (all or nothing); an existing result stays and gives False."""
    spark = df.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return False
    df.write.format(fmt).mode("overwrite").save(path)
    return True


def result_name(program: Column, callers: Column) -> Column:
    """K6: program_caller+caller.json, each caller once, in order."""
    return F.concat(program, F.lit("_"), F.array_join(F.array_distinct(callers), "+"), F.lit(".json"))


def write_results(df: DataFrame, path: str) -> None:
    """K6: one folder of results a file name."""
    df.write.partitionBy("file_name").mode("overwrite").json(path)


def digest64(text: Column) -> Column:
    """K7: a 64-bit digest of a logged object (16 hex digits)."""
    return F.substring(F.sha2(text, 256), 1, 16)


def scatter(components: DataFrame, chosen: DataFrame) -> DataFrame:
    """K8: (item_id, pc1, pc2, pc3, selected) for a plot made elsewhere."""
    return components.join(chosen.select("item_id", F.lit(True).alias("selected")), "item_id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
