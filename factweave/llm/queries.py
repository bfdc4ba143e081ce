"""The queries ``opN_<name>`` over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, lattice, mixing, oracles, pii, preference, quality_fm, quality_rules, revisit, toxicity
from .common import table
from .labelled import held_out

RANK_FILE = "byte_bpe_50k.tiktoken"


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is chosen; rejected is the same with its last turn said as in the conversation of the id before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("end"), F.max_by("text", F.struct("turn", "role", "text")).alias("final"))
    other = last.select((F.col("conv_id") + 1).alias("conv_id"), F.col("final").alias("said"))
    rejected = turns.join(last.drop("final"), "conv_id").join(other, "conv_id", "left")
    rejected = rejected.withColumn("text", F.when(F.col("turn") == F.col("end"), F.coalesce("said", F.lit(""))).otherwise(F.col("text")))
    got = preference.format_pairs(turns, rejected, "conv_id")
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias(c)
    return got.select("conv_id", "n_common", *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")], spelled("chosen_mask"), spelled("rejected_mask"))


OP1_SQL = """
WITH t AS (SELECT conv_id, role, regexp_replace(text, '<\\|im_', '<| im_', 'g') AS text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
sides AS (SELECT conv_id, 'a' AS side, pos, role, text FROM t UNION ALL
  SELECT t.conv_id, 'b', t.pos, t.role, CASE WHEN t.pos = t.n THEN coalesce(l.text, '') ELSE t.text END FROM t LEFT JOIN t l ON l.conv_id = t.conv_id - 1 AND l.pos = l.n),
common AS (SELECT conv_id, coalesce(min(CASE WHEN a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text THEN pos END) - 1, count(*)) AS n_common
  FROM (SELECT * FROM sides WHERE side = 'a') a FULL JOIN (SELECT * FROM sides WHERE side = 'b') b USING (conv_id, pos) GROUP BY conv_id),
shown AS (SELECT s.*, n_common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS r FROM sides s JOIN common USING (conv_id)),
placed AS (SELECT *, coalesce(sum(length(r)) FILTER (pos > n_common) OVER (PARTITION BY conv_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS head FROM shown),
done AS (SELECT conv_id, side, n_common, coalesce(string_agg(r, '' ORDER BY pos) FILTER (pos <= n_common), '') AS prompt, coalesce(string_agg(r, '' ORDER BY pos) FILTER (pos > n_common), '') AS rest,
  coalesce(string_agg(CAST(head AS BIGINT) || ':' || CAST(head + length(text) + 10 AS BIGINT), ',' ORDER BY pos) FILTER (pos > n_common AND role = 'assistant'), '') AS mask FROM placed GROUP BY ALL)
SELECT a.conv_id, CAST(a.n_common AS INTEGER) AS n_common, sha256(a.prompt) AS prompt_sha256, sha256(a.rest) AS chosen_sha256, sha256(b.rest) AS rejected_sha256, a.mask AS chosen_mask, b.mask AS rejected_mask
FROM done a JOIN done b ON a.conv_id = b.conv_id AND a.side = 'a' AND b.side = 'b'
"""


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a full response, and is asked for again later under another spelling of its URL: not modified."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    tag = F.md5("html")
    pair = lambda **h: F.create_map(*[x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v)])
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), pair(etag=tag, content_type=F.lit("text/html"), cache_control=F.lit("max-age=60")).alias("headers"), F.col("html").alias("payload"))
    age = F.concat(F.lit("max-age="), (F.col("page_id") % 100).cast("string"))
    seen = F.when(F.col("page_id") % 5 == 0, "stale").otherwise(F.concat(F.lit("W/"), tag))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^http", "HTTP"), F.lit("#again")).alias("url"), (F.col("page_id") * 10 + 5).alias("ts"), F.lit("revisit").alias("kind"), pair(etag=seen, content_type=F.lit("none"), cache_control=age).alias("headers"), F.lit(None).cast("string").alias("payload"))
    got = revisit.resolve(full.unionByName(again))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return got.select("record_id", "url_key", "status", "resolved_id", shown.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


OP6_SQL = """
WITH rec AS (SELECT page_id * 2 AS record_id, url, page_id * 10 AS ts, true AS is_full, md5(html) AS etag, 'max-age=60' AS age, 'text/html' AS ctype, html FROM pages UNION ALL
  SELECT page_id * 2 + 1, regexp_replace(url, '^http', 'HTTP') || '#again', page_id * 10 + 5, false, CASE WHEN page_id % 5 = 0 THEN 'stale' ELSE 'W/' || md5(html) END, 'max-age=' || (page_id % 100), 'none', NULL FROM pages),
p AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(bare, '^[A-Za-z]+://([^/?]*)', 1)) AS host, regexp_extract(bare, '^[A-Za-z]+://[^/?]*([^?]*)', 1) AS path, regexp_extract(bare, '\\?(.*)$', 1) AS query FROM (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM rec)),
k AS (SELECT *, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS url_key FROM p),
f AS (SELECT *, max(CASE WHEN is_full THEN {'ts': ts, 'id': record_id, 'etag': etag} END) OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM k),
s AS (SELECT *, CASE WHEN is_full THEN 'full' WHEN found IS NULL THEN 'missing' WHEN regexp_replace(etag, '^W/', '') = found.etag THEN 'resolved' ELSE 'mismatch' END AS status FROM f)
SELECT s.record_id, s.url_key, s.status, CASE WHEN s.status = 'resolved' THEN s.found.id END AS resolved_id,
  'cache-control=' || s.age || ';content-type=' || CASE WHEN s.status = 'resolved' THEN 'text/html' ELSE s.ctype END || ';etag=' || s.etag AS headers, sha256(CASE WHEN s.is_full THEN s.html ELSE r.html END) AS payload_sha256
FROM s LEFT JOIN rec r ON r.record_id = s.found.id AND s.status = 'resolved'
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    both = bpe.decode(ids, path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "n_shingles", "component_id", "class_id", "class_size")


def op5_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"), meta_cols=("n_chars",))
    scored = quality_fm.score(docs, model, ("n_chars",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count_of(k: int):
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")

    counts = [count_of(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("base"), F.col("terms")).alias("spans"))


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "rejected")


def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_preference_format": op1_preference_format, "op6_revisits": op6_revisits, "op2_byte_bpe": op2_byte_bpe, "op3_lattice_near_dedup": op3_lattice_near_dedup, "op4_jaccard_join": op4_jaccard_join, "op5_factorisation_quality": op5_factorisation_quality, "op7_adaptive_rules": op7_adaptive_rules, "op8_disclosure_pii": op8_disclosure_pii, "op9_toxicity_cnn": op9_toxicity_cnn, "op10_pivotal_mix": op10_pivotal_mix, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_preference_format": OP1_SQL,
        "op3_lattice_near_dedup": oracles.OP3,
        "op4_jaccard_join": oracles.OP4,
        "op6_revisits": OP6_SQL,
        "op7_adaptive_rules": oracles.op7(quality_rules.RULES, quality_rules.SPREADS, quality_rules.LEAST_ROWS),
    }
