"""The corpus pipeline: five stages, each on all that its predecessor kept.

toxicity (rejected documents go) -> n-gram Jaccard join (one document of each component stays) -> personal data
(texts are sanitised) -> mixing (rows are repeated or left out by their copies) -> byte-level BPE ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, jaccard, mixing, pii, toxicity
from factweave.llm.common import keep, table

RANK_FILE = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under their language's calibrated threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(~F.col("rejected")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each component; documents without an id have no component and stay."""
    joined = jaccard.join(docs).where((F.col("doc_id") == F.col("component_id")) | F.col("doc_id").isNull())
    kept = joined.where("doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it replaced; n_chars follows where a text changed."""
    cleaned = pii.sanitise(docs.withColumn("__before", F.length("text")))
    return cleaned.withColumn("n_chars", F.when(F.length("text") == F.col("__before"), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.apply_mix(docs).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the texts' token ids, packed and counted."""
    import public_tokenizers

    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The trained classifier, the disclosure counts and the random draws can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
