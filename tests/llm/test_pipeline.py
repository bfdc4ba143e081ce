"""The pipeline on a small corpus: every stage's decisions take effect, and columns stay."""

from __future__ import annotations

import os
import random
import re
from pathlib import Path

import corpus_pipeline
import pytest
from factweave.llm import common, queries


def test_stages_and_run(spark, tmp_path):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(3, 8)))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(40)]
        if i % 6 == 0:
            words[3] = words[9] = "zzrude"
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, " ".join(words) + (" write a.b@c.org now" if i % 10 == 1 else ""), "en", f"s{i % 3}", 0))
    rows += [(240, rows[1][1], "en", "s0", 0), (241, rows[1][1] + " more", "en", "s0", 0), (242, None, None, None, None), (243, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and len(ids & set(range(0, 240, 6))) <= 4 and len(ids) >= 190
    once = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    assert once >= set(range(240)) and not once & {240, 241}
    assert not any("@" in (r.text or "") for r in corpus_pipeline.sanitise(spark, docs, str(tmp_path)).collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "lang", "source", "n_tokens", "ids"} and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "pii", "mixing", "byte_bpe"]


def test_stages_take_empty_tables_long_texts_nulls_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int, component_id string, base string, threshold int"
    extra = (0.5, 7, "c", "b", 1)
    long = " ".join(f"w{k}" for k in range(60_000)) + " write to a.b@c.org"
    rows = [(1, long, "en", "s", len(long), *extra), (2, None, None, None, None, *[None] * 5), (None, "no id here at all", "en", "s", 17, *extra), (3, "", "en", "s", 0, *extra), (1, "a repeated id with its own text", "en", "s", 31, *extra)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, some in (("full", rows), ("none", [])):
        folder = tmp_path / name
        labels.write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame(some, schema).write.parquet(str(folder / "documents.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES[:-1]:
            got = f(spark, docs, str(folder))
            assert got.columns == docs.columns, stage
            assert all(r.component_id in ("c", None) and r.copies in (7, None) and r.base in ("b", None) for r in got.collect()), stage
        assert "[EMAIL]" in "".join(r.text or "" for r in corpus_pipeline.sanitise(spark, docs, str(folder)).collect()) or not some
        assert corpus_pipeline.run(spark, str(folder)).count() >= (1 if some else 0)


def test_queries_are_registered_whole():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
    assert os.path.exists(os.path.join(os.path.dirname(corpus_pipeline.__file__), "__spark_entry__.py"))


def test_tidy_gives_back_what_the_jvm_freed_outside_its_heap(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    if not status.exists():
        pytest.skip("memory can't be read here")
    anonymous = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", status.read_text())[1]) / 1024
    held = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    held.setAccessible(True)
    unsafe = held.get(None)
    blocks = [unsafe.allocateMemory(100_000) for _ in range(2_000)]
    for x in blocks:
        unsafe.setMemory(x, 100_000, 1)
    for x in blocks[:-1]:  # the last one keeps the C library from shrinking its arena by itself
        unsafe.freeMemory(x)
    for _ in range(2):
        jvm.System.gc()
    before = anonymous()
    monkeypatch.setattr(common, "_tidied", [float("-inf")])
    common.tidy(spark)
    assert anonymous() < before - 120
    unsafe.freeMemory(blocks[-1])
