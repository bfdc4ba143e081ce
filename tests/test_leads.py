"""Leads from fact documents: JSON in, leads and their fallback out."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from factweave.operators import graph, leads
from factweave.sources import facts


def call(name, cat, ln):
    return {"name": name, "cat": cat, "ln": ln}


def item(entry, calls):
    return {"meta": {"idx": 1, "path": "p"}, "entry": {"enrty_func": entry}, "func_call_dict": calls}


def test_leads_of_documents_and_their_fallback(spark, tmp_path):
    items = {
        # Two ways to the caller of a sink, and a sink in a function that nothing calls.
        "1": item("main", {"main": [call("a", "USER_DEF", 1), call("copy", "USER_DEF", 2)], "a": [call("copy", "USER_DEF", 3)], "copy": [call("strcpy", "IMPORT_API", 4)], "lost": [call("strcpy", "IMPORT_API", 5)]}),
        # Only a source that is a sink as well: its leads call for the fallback.
        "2": item("main", {"main": [call("get", "USER_DEF", 1)], "get": [call("gets", "IMPORT_API", 2)]}),
        # No sink at all, and no entry.
        "3": item("main", {"main": [call("put", "USER_DEF", 1)]}),
        "4": {"error": "x"},
    }
    (tmp_path / "f.json").write_text(json.dumps({"meta": {}, "items": items}))
    read = facts.corpus(spark, str(tmp_path / "f.json"))
    calls = facts.calls_of(read)
    uses = calls.where("cat = 'IMPORT_API'").select("item_id", F.col("callee").alias("api"), "caller")
    sinks = spark.createDataFrame([("strcpy",), ("gets",)], "api string")
    code = spark.createDataFrame([("1", "main", "m"), ("1", "a", "a"), ("1", "copy", "c"), ("2", "main", "m"), ("2", "get", "g")], "item_id string, func string, pcode string")
    first = leads.sink_leads(uses, sinks, graph.user_graph(calls), facts.entries_of(read), code)
    rows = {(r.item_id, tuple(r.call_chain)): r for r in first.collect()}
    assert sorted(rows) == [("1", ("main", "a", "copy")), ("1", ("main", "copy")), ("2", ("main", "get"))]
    assert {r.sink_api for r in rows.values()} == {"strcpy", "gets"} and rows["1", ("main", "a", "copy")].pcode_list == ["m", "a", "c"]

    sources = spark.createDataFrame([("gets",)], "api string")
    wanted = {r.item_id: r.fallback for r in leads.needs_fallback(first, read, sources).collect()}
    assert wanted == {"1": False, "2": True, "3": True, "4": True}
    # Item 1 has leads; item 2's first is known already; item 3 gets the chain once, though item 2 has the same.
    made = [("1", ["main", "a"]), ("2", ["main", "get"]), ("2", ["main", "put"]), ("3", ["main", "put"]), ("3", ["main", "put"])]
    second = spark.createDataFrame([(i, "w", c[-1], c, n, ["x"] * len(c)) for n, (i, c) in enumerate(made)], "item_id string, sink_api string, sink_caller string, call_chain array<string>, lead_id long, pcode_list array<string>")
    got = leads.with_fallback(first, second, read, sources)
    assert sorted((r.item_id, tuple(r.call_chain), r.sink_api) for r in got.collect()) == sorted([(*k, r.sink_api) for k, r in rows.items()] + [("2", ("main", "put"), "w"), ("3", ("main", "put"), "w")])
