"""Graph operators on hand-made graphs and against plain Python on random ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import graph, relational

GRAPHS = {
    1: [("main", "print"), ("main", "print"), ("main", "foo"), ("foo", "bar")],
    2: [("main", "a"), ("main", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d")],
    3: [("main", "a"), ("main", "b"), ("a", "b"), ("b", "a"), ("a", "end")],
}


@pytest.fixture(scope="module")
def graphs(spark):
    random.seed(11)
    made = dict(GRAPHS)
    for item in range(10, 16):
        names = ["main", *"abcdef"]
        made[item] = [(random.choice(names), random.choice(names)) for _ in range(9)]
    rows = [(i, s, d) for i, e in made.items() for s, d in e]
    entries = spark.createDataFrame([(i, "main") for i in [*made, 99]], "item_id long, entry string")
    return made, spark.createDataFrame(rows, "item_id long, src string, dst string"), entries


def paths_of(edges, start="main"):
    out, work = [], [(start,)]
    while work:
        p = work.pop()
        out.append(p)
        work += [(*p, d) for d in {d for s, d in edges if s == p[-1]} if d not in p]
    return out


def test_reachability_and_paths(graphs):
    made, edges, entries = graphs
    reach = {(r.item_id, r.name) for r in graph.reachable(edges, entries).collect()}
    paths = {(r.item_id, tuple(r.path)) for r in graph.simple_paths(edges, entries.select("item_id", F.col("entry").alias("name"))).collect()}
    for i, e in made.items():
        want = paths_of(e)
        assert {p for k, p in paths if k == i} == set(want)
        assert {n for k, n in reach if k == i} == {n for p in want for n in p}
    assert len(paths_of(GRAPHS[2])) == 8 and (99, "main") in reach
    chains = {(r.item_id, tuple(r.path)) for r in graph.complete_chains(edges, entries.select("item_id", F.col("entry").alias("name"))).collect()}
    assert {p for k, p in chains if k == 1} == {("main", "print"), ("main", "foo", "bar")}
    ends = entries.select("item_id", F.lit("end").alias("name"))
    to_end = {tuple(r.path) for r in graph.simple_paths(edges, entries.select("item_id", F.col("entry").alias("name")), ends).where("item_id = 3").collect()}
    assert to_end == {("main", "a", "end"), ("main", "b", "a", "end")}


def test_components_and_metrics(graphs):
    made, edges, entries = graphs
    comp = {(r.item_id, r.name): r.comp for r in graph.scc(edges).collect()}
    for i, e in made.items():
        names = {n for x in e for n in x}
        reach = {n: {p[-1] for p in paths_of(e, n)} for n in names}
        for n in names:
            assert comp[i, n] == min(m for m in reach[n] if n in reach[m])
    got = {r.item_id: r for r in graph.dag_metrics(edges, entries).collect()}
    assert (got[1].path_count, got[1].min_len, got[1].max_len, got[1].leaves) == (2.0, 2, 3, 2)
    assert (got[99].path_count, got[99].max_len, got[99].n_edges) == (1.0, 1, 0)
    degree = {r.item_id: r for r in graph.degrees(edges).collect()}
    assert degree[1].max_out == 3 and degree[1].n_edges == 4 and degree[1].leaves == 2  # repeated edges count


def test_wl_tells_repeated_edges_apart(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, "a", "b"), (3, "x", "y")], "item_id long, src string, dst string")
    labels = spark.createDataFrame([(i, n, "L") for i, n in [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "x"), (3, "y")]], "item_id long, name string, label string")
    got = {r.item_id: r.wl for r in graph.wl_signature(edges, labels).collect()}
    assert got[1] != got[2] == got[3] and len(got[1]) == 16


def test_prefix_removal_and_dedup(spark):
    rows = [(1, ["m", "a"]), (1, ["m", "a", "b"]), (1, ["m", "a", "b"]), (1, ["m", "c"]), (2, ["m", "a"])]
    got = sorted((r.item_id, tuple(r.path)) for r in relational.without_prefixes(spark.createDataFrame(rows, "item_id long, path array<string>")).collect())
    assert got == [(1, ("m", "a", "b")), (1, ("m", "a", "b")), (1, ("m", "c")), (2, ("m", "a"))]
    leads = [(1, 1, ["m", "f"], ["", "Real symbol name: f\nint f()\n{ x; }"]), (2, 1, ["m", "g"], ["", "Real symbol name: g\nint g()\n{ x; }"]), (3, 1, ["m", "h"], ["", None]), (4, 1, ["m", "i"], ["", None]), (5, 1, [], [])]
    kept = {r.lead_id for r in relational.leaf_distinct(spark.createDataFrame(leads, "lead_id long, item_id long, call_chain array<string>, pcode_list array<string>")).collect()}
    assert kept == {1, 3, 4, 5}


def test_taint_and_splice(spark):
    assigns = spark.createDataFrame([(1, "f", "b", "a"), (1, "f", "c", "z")], "item_id long, func string, lhs string, rhs string")
    args = spark.createDataFrame([(1, "f", 1, "b"), (1, "f", 1, "z")], "item_id long, func string, call_id long, var string")
    seeds = spark.createDataFrame([(1, "f", "a")], "item_id long, func string, var string")
    assert {r.var for r in graph.local_taint(assigns, args, seeds).collect()} == {"a", "b", "z", "c"}


def test_shortest_and_first_paths(graphs, spark):
    made, edges, entries = graphs
    starts = entries.select("item_id", F.col("entry").alias("name"))
    best = {(r.item_id, r.end): tuple(r.path) for r in graph.shortest_paths(edges, starts).collect()}
    ends = spark.createDataFrame([(i, n) for i in made for n in ("b", "end", "d")], "item_id long, name string")
    few = {}
    for r in graph.first_paths(edges, starts, ends, 3).collect():
        few.setdefault((r.item_id, r.end), set()).add(tuple(r.path))
    for i, e in made.items():
        paths = paths_of(e)
        for n in {p[-1] for p in paths}:
            assert best[i, n] == min((p for p in paths if p[-1] == n), key=lambda p: (len(p), p))
        for n in ("b", "end", "d"):
            hits = sorted((p for p in paths if p[-1] == n and not {"b", "end", "d"} & set(p[:-1])), key=lambda p: (len(p), p))
            assert few.get((i, n), set()) == set(hits[:3])
    pairs = {(r.item_id, r.end) for r in graph.reachable_pairs(edges, starts).collect()}
    assert pairs == set(best)


def test_first_paths_of_a_layered_graph_stay_few(spark):
    rows = [(1, "main", f"a0{k}") for k in range(3)] + [(1, f"{chr(97 + i)}0{j}", f"{chr(98 + i)}0{k}") for i in range(12) for j in range(3) for k in range(3)]
    edges = spark.createDataFrame(rows, "item_id long, src string, dst string")
    starts, ends = spark.createDataFrame([(1, "main")], "item_id long, name string"), spark.createDataFrame([(1, "m02")], "item_id long, name string")
    got = graph.first_paths(edges, starts, ends, 20)
    assert got.count() == 20 and all(len(r.path) == 14 for r in got.collect())
    assert graph.shortest_paths(edges, starts, ends).first().path == ["main", *[f"{chr(97 + i)}00" for i in range(12)], "m02"]


def test_append_new_keys_by_item(spark):
    schema = "item_id long, call_chain array<string>, seq int"
    old = spark.createDataFrame([(1, ["m", "a"], 0)], schema)
    new = spark.createDataFrame([(1, ["m", "a"], 1), (2, ["m", "a"], 2), (3, ["m", "a"], 3), (3, ["m", "a"], 4), (3, [], 5)], schema)
    assert sorted((r.item_id, r.seq) for r in relational.append_new(old, new).collect()) == [(1, 0), (2, 2), (3, 3)]


def test_append_new_groups_by_hash(spark):
    old = spark.createDataFrame([(1, ["m", "a"], 0)], "item_id long, call_chain array<string>, seq int")
    new = spark.createDataFrame([(1, ["m", "a"], 1), (1, ["m", "b"], 4), (1, ["m", "b"], 3), (2, ["m", "a"], 2), (2, [], 5), (2, None, 6)], "item_id long, call_chain array<string>, seq int")
    got = relational.append_new(old, new)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan and "Window" not in plan
    assert sorted((r.item_id, r.call_chain, r.seq) for r in got.collect()) == [(1, ["m", "a"], 0), (1, ["m", "b"], 3), (2, ["m", "a"], 2)]
    # With further columns the whole first row comes.
    wide = [x.withColumn("note", F.concat(F.lit("n"), x["seq"].cast("string"))) for x in (old, new)]
    assert sorted((r.item_id, r.seq, r.note) for r in relational.append_new(*wide).collect()) == [(1, 0, "n0"), (1, 3, "n3"), (2, 2, "n2")]
