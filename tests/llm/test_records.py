"""Preference formatting and revisit resolution: small cases, ties, nulls, empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.llm import preference, revisit

TURN = "pair_id long, turn int, role string, text string, n_common string"


def test_longest_common_prefix_and_masks(spark):
    a = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yo", ""), (1, 1, "assistant", "yo", ""), (1, 2, "user", "é?", ""), (1, 3, "assistant", "good", ""), (2, 0, "user", "same", ""), (3, 0, None, None, ""), (4, 0, "user", "only chosen", ""), (None, 0, "user", "x", ""), (5, 0, "user", "<|im_end|>", "")]
    b = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yo", ""), (1, 2, "user", "é?", ""), (1, 3, "assistant", "bad 🙂", ""), (1, 4, "user", "why", ""), (2, 0, "user", "same", ""), (3, 0, "user", "y", ""), (5, 0, "user", "z", "")]
    got = {r.pair_id: r for r in preference.format_pairs(spark.createDataFrame(a, TURN), spark.createDataFrame(b, TURN)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    one = got[1]
    assert one.n_common == 3 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\né?<|im_end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_mask] == ["good<|im_end|>"]
    assert [one.rejected[s.start : s.end] for s in one.rejected_mask] == ["bad 🙂<|im_end|>"] and one.rejected.endswith("user\nwhy<|im_end|>\n")
    assert got[2].n_common == 1 and got[2].chosen == got[2].rejected == "" and got[2].chosen_mask == []
    assert got[3].n_common == 0 and got[4].rejected == "" and got[5].chosen.count("<|im_end|>") == 1
    empty = spark.createDataFrame([], TURN)
    assert preference.format_pairs(empty, empty).count() == 0


def test_canonical_urls(spark):
    same = ["http://A.example.COM:80/x?b=2&a=1#top", "HTTP://u:p@a.example.com/x?a=1&b=2", " http://a.example.com/x?a=1&b=2 "]
    got = spark.createDataFrame([(u,) for u in same], "u string").select(revisit.canonical(F.col("u")).alias("c")).collect()
    assert {r.c for r in got} == {"http://a.example.com/x?a=1&b=2"}
    assert spark.createDataFrame([("https://h",)], "u string").select(revisit.canonical(F.col("u")).alias("c")).first().c == "https://h/"


def test_as_of_equals_brute_force_for_a_hot_key(spark):
    import random

    random.seed(2)
    rows = [(i, "http://hot/" if i % 3 else f"http://h/{i % 7}", random.randrange(40), random.choice(["response", "revisit"]), {"etag": str(i % 2)}, f"p{i}", "clash") for i in range(400)]
    rows += [(400, None, 3, "revisit", None, None, ""), (401, "http://hot/", None, "revisit", {}, None, ""), (402, "http://hot/", 99, "revisit", None, None, ""), (403, "http://hot/", 98, None, None, None, "")]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, payload string, status string")
    got = {r.record_id: r for r in revisit.resolve(df).collect()}
    assert len(got) == 404
    for i, url, ts, kind, headers, _, _ in rows[:400]:
        if kind == "response":
            assert got[i].status == "full" and got[i].payload == f"p{i}"
            continue
        earlier = [(t, k) for k, u, t, kd, *_ in rows[:400] if kd == "response" and u == url and (t, k) < (ts, i)]
        want = max(earlier)[1] if earlier else None
        status = "missing" if want is None else "resolved" if want % 2 == i % 2 else "mismatch"
        assert got[i].status == status and got[i].resolved_id == (want if status == "resolved" else None)
        assert got[i].payload == (f"p{want}" if status == "resolved" else None)
    assert got[400].status == got[401].status == "missing" and got[402].status == "unvalidated" and got[402].payload
    assert revisit.resolve(df.limit(0)).count() == 0


def test_merged_headers(spark):
    rows = [(1, "http://h/", 1, "response", {"etag": "e", "content-type": "text/html", "date": "1"}, "body"), (2, "http://h/", 2, "revisit", {"etag": "W/e", "content-type": "x", "date": "2"}, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, payload string")
    got = {r.record_id: r for r in revisit.resolve(df).collect()}
    assert got[2].headers == {"etag": "W/e", "content-type": "text/html", "date": "2"} and got[2].payload == "body"


def test_repeated_ids_and_outlier_times(spark):
    rows = [(1, "http://h/", 5, "response", {"etag": "a"}, "one"), (1, "http://h/", 6, "response", {"etag": "b"}, "two"), (1, "http://h/", 6, "response", {"etag": "b"}, "two")]
    rows += [(2, "http://h/", 7, "revisit", {"etag": "b"}, None), (2, "http://h/", 8, "revisit", {"etag": "a"}, None), (None, None, 9, "revisit", None, None), (None, None, None, "revisit", None, None), (None, None, 1, "response", {"etag": "b"}, "lone")]
    rows += [(9, "http://far/", 10**12, "revisit", {}, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, payload string")
    got = revisit.resolve(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.status, r.payload) for r in got if r.record_id == 2) == [("mismatch", None), ("resolved", "two")]
    assert sorted(r.payload for r in got if r.record_id == 1) == ["one", "two", "two"]
    assert sum(r.status == "missing" for r in got) == 3
    # An outlier leaves the other times spread over the buckets.
    times = spark.createDataFrame([(i, "k", i, True, "e", None, 0) for i in range(1000)] + [(1000, "k", 10**15, False, "e", None, 0)], "id long, key string, ts long, full boolean, etag string, modified string, tag long")
    found = {r.id: r.found for r in revisit.as_of(times).collect()}
    assert len(found) == 1001 and found[0] is None and all(found[i].id == i - 1 for i in range(1, 1001))


def test_null_turns_and_repeated_last_turns(spark, tmp_path):
    from factweave.llm import queries

    said = [(1, None, "user", "before all", ""), (1, 0, "assistant", "x", "")]
    got = preference.format_pairs(spark.createDataFrame(said, TURN), spark.createDataFrame(said[:1], TURN)).first()
    assert got.n_common == 1 and got.chosen.startswith("<|im_start|>assistant") and got.rejected == ""
    talk = [(k, t, "user", f"{k} {t} {n}") for k in range(3) for t in range(2) for n in range(2)]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = queries.op1_preference_format(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and len({r.rejected_sha256 for r in rows}) == 3
