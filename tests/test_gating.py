"""Gates, least covers and replay against plain Python."""

from __future__ import annotations

import itertools
import json

from factweave.operators import gating

FLAGS = "lead_id string, cwe string, has_indirect boolean, has_stack boolean, has_global boolean, has_inner boolean, has_alloca boolean"


def test_least_cover_all_cases(spark):
    rows = [(f"{cwe}{bits}", cwe, *bits) for cwe in ("121", "78") for bits in itertools.product([False, True], repeat=5)]
    got = {r.lead_id: r for r in gating.least_cover(gating.gates(spark.createDataFrame(rows, FLAGS))).collect()}
    assert len(got) == 64
    for name, cwe, ind, stack, glob, inner, alloca in rows:
        on = {"inner_call": ind, "global_var": glob, "fetch_pcode": inner, "stack_lvar": stack, "fetch_disasm": alloca}
        needs = [[p for p in v if on[p]] for v in gating.TEMPLATE.values()]
        must = {p for p, use in (("stack_lvar", cwe == "121" and stack), ("fetch_disasm", alloca)) if use}
        sizes = [len(s) for n in range(6) for s in itertools.combinations(gating.PRIMITIVES, n) if must <= set(s) and all(not x or set(x) & set(s) for x in needs)]
        assert got[name].least_size == min(sizes) and [got[name][k] for k in gating.KEYS] == needs and set(got[name].mandatory) == must
    refilled = gating.refill(gating.gates(spark.createDataFrame(rows, FLAGS))).where("has_inner").first()
    assert refilled.O2 == gating.TEMPLATE["O2"]


def test_replay(spark):
    turns = [
        (1, 0, "Unknown", "Satisfied", "Unknown", "Unknown", []),  # the first turn is taken as it is
        (1, 1, "Unknown", "Satisfied", "Satisfied", "Unknown", [1]),  # right kind
        (1, 2, "Satisfied", "Satisfied", "Satisfied", "Unknown", [2]),  # O1 needs inner_call: rejected
        (1, 3, "Unknown", "Unknown", "Satisfied", "Unknown", []),  # nothing newly known: passes, and regresses
        (2, 0, "Unknown", "Unknown", "Unknown", "Unknown", None),
        (2, 1, "Unknown", "Unknown", "Unknown", "Satisfied", [7]),  # an id that isn't there
        (2, 2, "Unknown", "Unknown", "Unknown", "Satisfied", [2]),
    ]
    evidence = [(1, 1, "fetch_pcode"), (1, 2, "stack_lvar"), (2, 2, "stack_lvar")]
    gated = spark.createDataFrame([(k, *gating.TEMPLATE.values()) for k in (1, 2)], "lead_id long, O1 array<string>, O2 array<string>, O3 array<string>, O4 array<string>")
    t = spark.createDataFrame(turns, "lead_id long, turn int, O1 string, O2 string, O3 string, O4 string, update_from array<int>")
    got = {(r.lead_id, r.turn): r for r in gating.replay(t, spark.createDataFrame(evidence, "lead_id long, evid_id int, type string"), gated).collect()}
    assert [got[1, k].accepted for k in range(4)] == [True, True, False, True]
    assert got[1, 2].O1 == "Unknown" and got[1, 2].gating_flag and got[1, 3].gating_flag and got[1, 3].regressed and got[1, 3].O2 == "Unknown"
    assert [got[2, k].accepted for k in range(3)] == [True, False, True] and got[2, 2].O4 == "Satisfied"


def test_streamed_replay(spark, tmp_path):
    from factweave.streaming.replay import streamed_replay

    rows = [(1, 0, "Unknown", "Unknown", "Unknown", "Unknown", False, False, False, False, False), (1, 1, "Satisfied", "Unknown", "Unknown", "Unknown", False, True, True, True, False), (1, 2, "Satisfied", "Unknown", "Unknown", "Unknown", True, True, True, True, False)]
    schema = "lead_id long, turn int, O1 string, O2 string, O3 string, O4 string, ok1 boolean, ok2 boolean, ok3 boolean, ok4 boolean, invalid boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = streamed_replay(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {r.turn: r for r in spark.table("replayed").collect()}
    finally:
        q.stop()
    assert [got[k].accepted for k in range(3)] == [True, False, True] and got[2].O1 == "Satisfied" and got[2].gating_flag


def test_dispatch_answers_each_question_by_its_kind(spark):
    asked = spark.createDataFrame(
        [("a", 0, 1, "fetch_pcode", "f", None), ("a", 1, 1, "stack_lvar", "f", "buf"), ("b", 0, 2, "fetch_pcode", "f", None), ("b", 1, 1, "stack_lvar", "f", "other")],
        "lead_id string, turn int, item_id int, query_type string, func string, var string",
    )
    code = spark.createDataFrame([(1, "f", "x = 1"), (1, "g", "y = 2")], "item_id int, func string, pcode string")
    local = spark.createDataFrame([(1, "f", "buf", 16)], "item_id int, func string, var string, lvar_size int")
    got = {(r.lead_id, r.turn): (r.type, json.loads(r.payload)) for r in gating.dispatch(asked, {"fetch_pcode": code, "stack_lvar": local}).collect()}
    # Item 2 and the unknown variable have no fact: their questions stay, without an answer.
    assert got == {("a", 0): ("fetch_pcode", {"pcode": "x = 1"}), ("a", 1): ("stack_lvar", {"lvar_size": 16}), ("b", 0): ("fetch_pcode", {}), ("b", 1): ("stack_lvar", {})}
