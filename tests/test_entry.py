"""Registered queries give the rows of their SQL on the smallest tables, where those are present."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = ["flagship_reach_imports", "g6_complete_chains", "g8_condensation", "g10_wl_signature", "a2_merge_imports", "a12_smoke_rollup", "j1_source_sink_pairs", "o7_gated_replay", "v2_idf_normalised", "l1_sink_leads", "f6_insn_tokens"]


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "documents", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    want = db.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    clean = lambda rows, cols: sorted((tuple(round(r[cols.index(c)], 6) if isinstance(r[cols.index(c)], float) else r[cols.index(c)] for c in order) for r in rows), key=repr)
    assert sorted(want.columns) == order and clean(df.collect(), df.columns) == clean(want.fetchall(), want.columns)
