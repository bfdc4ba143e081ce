"""Scalar functions, aggregates, features, sources and sinks."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
from pyspark.sql import functions as F

from factweave.functions import exprs
from factweave.operators import aggregates, features, reports
from factweave.sources import facts


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_norm_api_and_buckets(spark):
    cases = {"___stack_chk_fail": "__stack_chk_fail", "_memcpy": "memcpy", "__libc": "__libc", "_ZN3fooE": "_ZN3fooE", "": "", "puts": "puts", "____x": "__x"}
    got = column(spark, list(cases)).select("x", exprs.norm_api(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases
    values = [-1.0, 0.0, 1e-9, 0.5, 1.0, 2.0, 3.0, 4.0, 1023.0, 1024.0]
    got = column(spark, values, "double").select("x", exprs.bucket_log2(F.col("x")).alias("y")).collect()
    assert all(r.y == (0 if r.x <= 0 else math.floor(math.log2(r.x)) + 1) for r in got)


def test_hash_feature(spark):
    idx, sign = exprs.hash_feature(F.col("x"), 4096)
    for r in column(spark, ["API:memcpy", "é", "", "BITS:64"]).select("x", idx.alias("i"), sign.alias("s")).collect():
        h = hashlib.md5(r.x.encode()).digest()
        assert (r.i, r.s) == (int.from_bytes(h[:4], "little") % 4096, 1.0 if h[4] & 1 == 0 else -1.0)


def test_instruction_tokens(spark):
    lines = ["\t; only a comment\t", "loc_1:", ".text", "\tpush\trbp", "mov eax, [rbp-8] ; load", "nop", "call _memcpy", "call sub_40", "call eax", "call strange", "jmp short loc_2", "jz loc_3", "jecxz loc_4", "setz al", "cmovz eax, ebx", "cmp eax, 5", "test eax, eax", "retn", "call helper", "lea edi, aHello"]
    code = spark.createDataFrame([(1, "f", "\n".join(lines))], "item_id long, func string, disasm string")
    got = exprs.insn_tokens(code, spark.createDataFrame([(1, "memcpy")], "item_id long, api string"), spark.createDataFrame([(1, "helper")], "item_id long, name string"))
    tokens = [r.token for r in got.orderBy("pos").collect()]
    assert tokens == ["PUSH", "MOV_REG_MEM", "CALL_API:memcpy", "CALL_INT", "CALL_IND", "CALL_EXT", "JMP", "JCC", "JX", "SETCC", "CMOVCC", "CMP_REG_IMM", "TEST_REG_REG", "RET", "CALL_INT", "LEA_REG_SYM"]


def test_json_scans(spark):
    assert exprs.extract_json_text('```json\n{"a": 1}\n```') == exprs.extract_json_text('x ```json\n{"a": 1}\n```') == '{"a": 1}'
    assert exprs.extract_json_text('```\nplain\n```') == "plain" and exprs.extract_json_text('say ```plain```') == 'say ```plain```'
    assert exprs.extract_json_text("{" * 300_000) == "{" * 300_000  # one pass
    assert exprs.first_object('{"state": 0} so </think> {"state": 1}', ("state",)) == '{"state": 1}'
    assert exprs.extract_json_text('so {"a": "}"} end') == '{"a": "}"}' and exprs.extract_json_text("none") == "none" and exprs.extract_json_text(None) is None
    assert exprs.first_object('<think>{"state": 0}</think> {"b": 1} {"state": 2}', ("state",)) == '{"state": 2}'
    assert exprs.first_object("no", ("state",)) is None
    got = exprs.json_objects(column(spark, ['a {"state": 1}', None]), "x", "j", ("state",)).collect()
    assert {r.j for r in got} == {'{"state": 1}', None}


def test_text_helpers(spark):
    row = spark.createDataFrame([("9a b", "int __cdecl ns::f(int, char)", 0x41424344, ["b", "a", "b"])], "s string, d string, v long, l array<string>")
    got = row.select(exprs.clean_symbol(F.col("s")).alias("s"), exprs.short_name(F.col("d")).alias("d"), exprs.int_ascii(F.col("v")).alias("v"), exprs.code_text(F.col("l")).alias("n"), exprs.strip_prefix(F.lit(".__imp_puts")).alias("p"), exprs.gate_text(F.create_map(F.lit("O2"), "l")).alias("g"), exprs.render("Hi {{ who }}!", {"who": F.lit(None)}).alias("r"), exprs.signal_name(F.lit(11)).alias("sig"), exprs.error_hint(F.lit("Say.\n"), F.array(F.lit("O2"), F.lit("O1"))).alias("e")).first()
    assert (got.s, got.d, got.v, got.p, got.g, got.r, got.sig) == ("f_9a_b", "ns::f", "ABCD", "puts", "Minimum Primitive Set for Satisfying Obligation Requirements:\nO2's minimum primitive set: [a, b]", "Hi !", "SIGSEGV") and got.n == "b\n\na\n\nb" and got.e.startswith("Say.\n\nObligation-status") and "failed for O2,O1;" in got.e


def test_merge_is_the_ordered_fold(spark):
    rows = [("f", "dynsym", "", "p1", 1), ("f", "libc", "", "p1", 2), ("f", "dynsym", "int f()", "p2", 1), ("f", "libm", "int f()", "p3", 1), ("f", "libz", "x", "p4", 1), ("g", None, None, "p1", 3)]
    got = {r.func: (r.lib, r.proto) for r in aggregates.merge_imports(spark.createDataFrame(rows, "func string, lib string, proto string, path string, pos int")).collect()}
    assert got == {"f": ("libm", "int f()"), "g": ("", "")}
    # An entry that lost before wins at a later place.
    rows = [("h", "dynsym", "", "a", 1), ("h", "libc", "", "a", 2), ("h", " .dynsym", "int h()", "a", 3), ("h", "libc", "", "a", 4)]
    assert aggregates.merge_imports(spark.createDataFrame(rows, "func string, lib string, proto string, path string, pos int")).first().lib == "libc"


def test_smoke_and_allocation(spark):
    rows = [(1, 1, "timeout", None), (1, 2, "signal", 11), (1, 3, "signal", 6), (2, 1, "timeout", None), (2, 2, "timeout", None), (3, 1, "normal", None)]
    got = {r.item_id: r for r in aggregates.smoke_rollup(spark.createDataFrame(rows, "item_id long, seq int, outcome string, signal int")).collect()}
    assert (got[1].status, got[1].signal, got[1].executed, got[2].status, got[3].status) == ("signal", 11, 2, "timeout", "normal")
    assert aggregates.allocation([(32, 1), (64, 99)], 10) == {32: 1, 64: 9} and sum(aggregates.allocation([(32, 50), (64, 50)], 7).values()) == 7


def test_farthest_first_equals_greedy(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(30, 6)), rng.integers(1, 9, 30)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen = [int(max(range(30), key=lambda k: (w[k], -k)))]
    while len(chosen) < 6:
        near = (unit @ unit[chosen].T).max(1)
        score = np.round((1 - near) * np.log1p(w) ** 0.5, 12)
        chosen.append(int(max((k for k in range(30) if k not in chosen), key=lambda k: (score[k], -k))))
    df = spark.createDataFrame([(k, float(w[k]), x[k].tolist()) for k in range(30)], "key long, weight double, vec array<double>")
    assert [r.key for r in features.farthest_first(df, 6).orderBy("step").collect()] == chosen


def test_round_robin_takes_the_least_like(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cluster = [k % 3 if k < 30 else 0 for k in range(40)]
    vec = spark.createDataFrame([(k, i, float(x[k, i])) for k in range(40) for i in range(5)], "item_id long, idx long, val double")
    names = spark.createDataFrame([(k, f"c{cluster[k]}") for k in range(40)], "item_id long, cluster string")
    members = {c: [k for k in range(40) if cluster[k] == c] for c in range(3)}
    chosen = {c: [max(m, key=lambda k: (round(float(x[k] @ (x[m].mean(0) / np.linalg.norm(x[m].mean(0)))), 9), -k))] for c, m in members.items()}
    order = sorted(members, key=lambda c: -len(members[c]))
    while sum(map(len, chosen.values())) < 14:
        for c in order:
            rest = [k for k in members[c] if k not in chosen[c]]
            if rest and sum(map(len, chosen.values())) < 14:
                chosen[c].append(min(rest, key=lambda k: (round(max(float(x[k] @ x[j]) for j in chosen[c]), 9), k)))
    assert {r.item_id for r in features.sample(vec, names, 14).collect()} == {k for v in chosen.values() for k in v}


def test_idf_and_sampling(spark):
    rows = [(i, i % 4, 1.0) for i in range(12)] + [(i, 9, 2.0) for i in range(12)]
    vec = features.idf_normalised(spark.createDataFrame(rows, "item_id long, idx long, val double"), 12)
    norms = vec.groupBy("item_id").agg(F.sum(F.col("val") * F.col("val")).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)
    clusters = spark.createDataFrame([(i, f"c{i % 4}") for i in range(12)], "item_id long, cluster string")
    for k in (2, 4, 7, 20):
        got = [r.item_id for r in features.sample(vec, clusters, k).collect()]
        assert len(got) == len(set(got)) == min(k, 12)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a").write_bytes(b"\x7fELF\x02rest")
    (tmp_path / "bin" / "b").write_bytes(b"\x7fELF\x01")
    (tmp_path / "bin" / "c.txt").write_bytes(b"text")
    (tmp_path / "bin" / "a").chmod(0o755)
    got = facts.elf_files(spark, str(tmp_path / "bin")).collect()
    assert [(r.path[-1], r.bits) for r in got] == [("a", 64), ("b", 32)] and got[0].sha256 == hashlib.sha256(b"\x7fELF\x02rest").hexdigest()
    assert facts.elf_files(spark, str(tmp_path / "bin"), limit=1).count() == 1
    assert [p[-1] for p in facts.executables(str(tmp_path / "bin"), magic=True)] == ["a"]
    item = {"meta": {"idx": 1, "path": "p"}, "func_internal_list": [{"name": "main", "start_ea": "0x1A", "size": "0x10"}], "func_call_dict": {"main": [{"name": "puts", "cat": "IMPORT_API", "ln": 3}]}}
    (tmp_path / "f.json").write_text(json.dumps({"meta": {}, "items": {"10": item, "2": {"error": "x"}}}))
    items = facts.corpus(spark, str(tmp_path / "f.json"))
    assert [r.item_id for r in items.orderBy("item_order").collect()] == ["2", "10"]
    call = facts.calls_of(items).first()
    assert (call.caller, call.callee, call.ln, call.call_type) == ("main", "puts", 3, None) and facts.functions_of(items).first().start_ea == 26
    assert facts.api_categories(spark).count() == 166
    catalog = spark.createDataFrame([("b", "l", "p"), ("a", "l", "")], "func string, lib string, proto string")
    assert json.loads(reports.import_map(catalog).first().value) == {"a": {"lib": "l", "proto": ""}, "b": {"lib": "l", "proto": "p"}}
    doc = json.loads(reports.corpus_document({"n": 1}, spark.createDataFrame([("1", "x")], "item_id string, path string")).first().value)
    assert doc == {"meta": {"n": 1}, "items": {"1": {"path": "x"}}}
    assert reports.write_once(catalog, str(tmp_path / "out")) and not reports.write_once(catalog, str(tmp_path / "out"))


def test_principal_components_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(40, 5)) * [5, 3, 2, 1, 0.5] + [10, 0, -4, 2, 1]
    dense = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(data)], "item_id int, vec array<double>")
    got = np.array([[r.pc1, r.pc2, r.pc3] for r in features.principal_components(dense).orderBy("item_id").collect()])
    centred = data - data.mean(axis=0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_int_ascii_refuses_ends_of_lines(spark):
    cases = {0x410A: None, 0x410D: None, 0x4185: None, 0x410D0A: None, 0x4141: "AA", 0x0A41: None, 255: None}
    got = column(spark, list(cases), "long").select("x", exprs.int_ascii(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases
