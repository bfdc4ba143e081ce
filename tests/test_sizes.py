"""Joins of facts must not go by the size of the files, which hold few distinct values: nothing large is sent to the driver."""

from __future__ import annotations

import pytest

from factweave.operators import features, graph, relational
from factweave.sources import store
from factweave.sources.store import stored


@pytest.fixture(scope="module")
def facts(spark):
    """Edges, labels and entries of two items, from files."""
    edges = spark.createDataFrame([(i, s, d) for i in (1, 2) for s, d in [("main", "a"), ("a", "b"), ("b", "a"), ("a", "c")]], "item_id long, src string, dst string")
    labels = spark.createDataFrame([(i, n, "L") for i in (1, 2) for n in ("main", "a", "b", "c")], "item_id long, name string, label string")
    entries = spark.createDataFrame([(i, "main") for i in (1, 2)], "item_id long, entry string")
    return stored(edges, "t-edges"), stored(labels, "t-labels"), stored(entries, "t-entries")


def sent(df) -> bool:
    """Whether the plan sends a table to all executors."""
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_wl_signature_sends_no_table(facts):
    edges, labels, _ = facts
    assert sent(edges.join(labels, "item_id"))  # by the size of the files
    assert not sent(graph.wl_signature(edges, labels))


def test_cluster_key_sends_no_table(facts):
    _, labels, entries = facts
    bits = entries.select("item_id", (entries.item_id * 32).alias("bits"))
    wl = stored(labels.selectExpr("item_id", "label as wl").distinct(), "t-wl")
    got = features.cluster_key(bits, wl)
    assert not sent(got) and sorted(r.cluster for r in got.collect()) == ["B32|WLL", "B64|WLL"]


def test_reachability_sends_few_rows_at_most(facts, monkeypatch):
    edges, _, entries = facts
    plans, write = [], stored
    monkeypatch.setattr(graph, "stored", lambda df, tag: (plans.append((tag, sent(df))), write(df, tag))[1])
    want = {(i, n) for i in (1, 2) for n in ("main", "a", "b", "c")}
    for few in (0, store.FEW):
        monkeypatch.setattr(store, "FEW", few)
        plans.clear()
        reach = graph.reachable(edges, entries)
        assert {(r.item_id, r.name) for r in reach.collect()} == want
        # A round's few new rows may go to all executors; not the edges, nor what was found before.
        assert {s for tag, s in plans if tag == "g4-front"} == {few > 0}
        assert not sent(relational.reachable_functions(graph.nodes(edges), reach, entries))
    monkeypatch.setattr(store, "FEW", 0)
    plans.clear()
    paths = graph.simple_paths(edges, entries.selectExpr("item_id", "entry as name"))
    assert paths.count() == 8 and plans and not any(s for _, s in plans)
