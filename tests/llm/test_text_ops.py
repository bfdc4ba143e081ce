"""BPE, personal data, quality rules and mixing: brute force on small tables, and the edge cases of the docstrings."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factweave.llm import bpe, mixing, pii, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs(spark, texts, **cols):
    rows = [(i, t, cols.get("lang", "en"), cols.get("source", f"s{i % 2}"), None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def ranks():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe_matches_library_and_round_trips(spark, ranks):
    path, pattern = ranks
    with open(path, "rb") as f:
        enc = bpe._encoding(f.read(), pattern)
    texts = [None, "", "a", " ", "it's  12 naïve 日本 🙂\n\n x", "word " * 40_000, " " * 5000 + "x", "a" * 3000, "same", "same"]
    out = bpe.decode(bpe.encode(docs(spark, texts).withColumn("ids", F.lit("clash")), path, pattern), path, pattern)
    for row in out.collect():
        text = texts[row.doc_id] or ""
        want = [x for part in bpe.encode_text(enc, text) for x in part]
        if " " * 2048 not in text:
            assert want == enc.encode_ordinary(text)
        assert bpe.ids_array(row.ids) == want and row.n_tokens == len(want)
        assert bytes(row.decoded) == text.encode() and row.score == "clash"
    assert bpe.encode(docs(spark, []), path, pattern).count() == 0


def test_bpe_parts_change_no_id(ranks):
    path, pattern = ranks
    with open(path, "rb") as f:
        enc = bpe._encoding(f.read(), pattern)
    random.seed(2)
    for _ in range(100):
        text = "".join(random.choice(["a", "é", " ", "  ", "\n", "\t", "x1", "'s", "...", "日本", "\x1c", "🙂"]) for _ in range(80))
        for size in (3, 17):
            assert [x for p in bpe.encode_text(enc, text, size) for x in p] == enc.encode_ordinary(text)


def test_bpe_bad_ids_decode_to_null(spark, ranks):
    got = bpe.decode(spark.createDataFrame([(b"\xff\xff\xff\xff",), (b"\x00",), (None,), (b"",)], "ids binary"), *ranks)
    assert [r.decoded for r in got.collect()] == [None, None, None, b""]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and pii._luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    random.seed(3)
    bits = ["a@b.c", "@", "a", ".", "1", "12", "255", ".1.", "+1", " ", "-", "(", ")", "4111111111111111", "x@y", "é", "%"]
    for _ in range(3000):
        text = "".join(random.choice(bits) for _ in range(random.randint(0, 14)))
        assert plain_spans(text) == pii.base_spans(text), text
    assert len(pii.base_spans("a" * 200_000 + "@" + "1" * 200_000)) == 0  # linear, not quadratic


def test_disclosing_terms_are_found_and_replaced(spark):
    told = [f"note {w} Zanzibar kiosk mail me at x.y@corp.example.com today {w}" for w in "abcdefgh"]
    plain = [f"nothing here {w} today about it" for w in "ijklmnop"] + [None, "", "today"]
    df = docs(spark, told + plain)
    found = {r.doc_id: r for r in pii.spans(df).collect()}
    assert all(found[i].terms for i in range(8)) and not any(found[i].terms for i in range(8, 19))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i in range(8):
        assert "x.y@corp" not in clean[i] and "Zanzibar" not in clean[i] and "[EMAIL]" in clean[i]
    assert [clean[i] for i in range(8, 19)] == plain
    assert pii.spans(docs(spark, [])).count() == 0 and pii.sanitise(docs(spark, [])).count() == 0


def test_revealing_terms_go_from_whole_texts_and_from_texts_without_the_entity(spark):
    fill = " ".join(f"w{k}" for k in range(400))
    told = [f"Zanzibar x.y@corp.example.com Zanzibar {w} {fill} (Zanzibar)" for w in "abcdefgh"]
    plain = [f"{fill} {w} only Zanzibar is named" for w in "ij"] + [f"{fill} v{k} nothing" for k in range(60)]
    clean = [r.text for r in pii.sanitise(docs(spark, told + plain)).orderBy("doc_id").collect()]
    assert not any("Zanzibar" in t for t in clean) and clean[10:] == plain[2:]
    assert all("w399" in t for t in clean)  # what every text holds reveals nothing


def test_terms_of_the_whole_text_are_weighed_and_counted_in_one_scope(spark):
    fill = [" ".join(f"{x}{k}" for k in range(200)) for x in "vw"]
    long = "Q" * 100
    told = [f"Zanzibar {long} Q {fill[0]} {w} {fill[1]} x.y@corp.example.com" for w in "abcdefgh"]
    # near in half of its documents, and its word in another's address only
    half = [f"{'Kiosk' if k % 2 else ''} {fill[0]} {'' if k % 2 else 'Kiosk'} q{k}@kiosk.example.com 10.1.2.3 {fill[1]} Kiosk@b.example.com" for k in range(8)]
    plain = [" ".join(fill) + f" z{k}" for k in range(60)] + ["write to Kiosk@b.example.com"] * 60
    df = docs(spark, told + half + plain)
    found = pii.find_base(df.withColumn("text_key", pii.F.md5("text"))).where("size(base) > 0")
    got = {(r.entity, r.term): r.removed for r in pii.disclosures(found, df.select("text"), df.count(), 3, 0.85, 0.97).collect()}
    assert {t for e, t in got if e.startswith("email:x.y")} == {"Zanzibar", long, "Q"}
    assert got["ip:10.1.2.3", "Kiosk"]  # always with the entity, whatever is between: the share is 1
    clean = [r.text for r in pii.sanitise(df).orderBy("doc_id").collect()]
    assert not any("Zanzibar" in t or long in t or "Kiosk" in t for t in clean) and all("w199" in t for t in clean[:76])


def test_disclosures_equal_brute_force(spark):
    random.seed(12)
    names = [f"N{k}" for k in range(12)]
    mails = [f"m{k}@h.example.com" for k in range(4)]
    texts = [" ".join([f"t{k}", *random.sample(names, 3), *(random.sample(mails, random.randint(0, 2)) if k % 2 else [])]) for k in range(120)]
    texts += [f"N{k} m{k}@h.example.com u{j}" for k in range(3) for j in range(6)] + texts[:20]
    held = [(set(re.findall(r"[A-Za-z]+[0-9]+(?![0-9@])(?<!@)", re.sub(r"\S+@\S+", " ", t))), {f"email:{m}" for m in re.findall(r"\S+@\S+", t)}) for t in texts]
    want, n = {}, len(texts)
    for e in {e for _, es in held for e in es}:
        n_e = sum(e in es for _, es in held)
        for w in {w for ws, es in held if e in es for w in ws}:
            both = [t for t, (ws, es) in zip(texts, held, strict=True) if w in ws and e in es]
            share = math.log2(len(both) * n / (n_e * sum(w in ws for ws, _ in held))) / math.log2(n / n_e)
            if len(set(both)) >= 3 and share >= 0.1:
                want[e, w] = share >= 0.3
    df = docs(spark, texts)
    found = pii.find_base(df.withColumn("text_key", pii.F.md5("text"))).where("size(base) > 0")
    got = {(r.entity, r.term): r.removed for r in pii.disclosures(found, df.select("text"), n, 3, 0.1, 0.3).collect()}
    assert got == want and len(set(want.values())) == 2


def test_rules_leave_clashing_columns_alone(spark):
    df = docs(spark, ["one two three four five six seven eight nine ten eleven", None]).selectExpr("*", "1 AS max_length", "2 AS m_length", "3 AS m_symbols", "4 AS rule", "5 AS bucket")
    got = quality_rules.apply_rules(df).collect()
    assert len(got) == 2 and all((r.max_length, r.m_length, r.m_symbols, r.rule, r.bucket) == (1, 2, 3, 4, 5) for r in got)


def test_rule_counts_equal_brute_force(spark):
    texts = [None, "", " \n\t ", "a b c d e a b c d e f", "x\ny\nx\n\n \nx", "#a *b $$ <c>", "日本 é 🙂 " * 8, "la " * 5000, "one two three four"]
    random.seed(5)
    texts += [" ".join(random.choice("abc") for _ in range(random.randint(1, 40))) for _ in range(20)]
    for row in quality_rules.apply_rules(docs(spark, texts)).collect():
        text = texts[row.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = defaultdict(list)
        for k in range(len(words) - 4):
            seen[tuple(words[k : k + 5])].append(k)
        covered = {p + j for v in seen.values() if len(v) > 1 for p in v for j in range(5)}
        lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(v - 1 for v in lines.values()), len(covered))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        assert row.base_failed == failed and not (failed and row.kept)
    assert quality_rules.apply_rules(docs(spark, [])).count() == 0


def test_sketch_quantiles_are_within_a_sixteenth(spark):
    values = [int(1.3**k) + k for k in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = df.select("v", quality_rules.bucket_value(quality_rules.bucket(F.col("v"))).alias("w")).collect()
    assert all(r.w <= r.v <= r.w * 17 / 16 and (r.v > 31 or r.v == r.w) for r in got)
    assert [r.v for r in sorted(got, key=lambda r: (r.w, r.v))] == sorted(values)


def test_adaptive_rules_keep_clean_and_drop_junk(spark):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(3, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(80)]
    junk = ["$$$ ".join(word() for _ in range(60)) for _ in range(8)]
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs(spark, clean + junk, source=None, lang=None)).collect()}
    assert all(kept[i] for i in range(80)) and not any(kept[i] for i in range(80, 88))


def filled(rows, most=3):
    """Water-filling by repeated resharing."""
    size = Counter()
    for source, n in rows:
        size[source] += n
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(size.values()))
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += unit * weight[s]
        left = 0.0
        for s in list(free):
            if target[s] >= most * size[s]:
                left += target[s] - most * size[s]
                target[s] = float(most * size[s])
                free.discard(s)
    return size, target


def test_mix_meets_targets_and_reruns_agree(spark):
    random.seed(4)
    rows = [(i, " ".join(["w"] * random.choice([0, 1, 3, 9, 40])), random.choice(["b", "a", "É", "tiny", None] if i % 7 == 0 else ["a", "b"])) for i in range(700)]
    df = spark.createDataFrame([(i, t or None, s, "x") for i, t, s in rows], "doc_id long, text string, source string, size string")
    got = mixing.mix(df, block_rows=16).collect()
    size, target = filled([(s, len(t.split())) for _, t, s in rows])
    taken = Counter()
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    # Every source comes within half of its smallest document, where it has some to decide.
    assert len(got) == 700 and all(abs(taken[s] - target[s]) <= 1 for s in size)
    again = mixing.mix(df.repartition(3), block_rows=16).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_mix_many_small_sources(spark):
    random.seed(14)
    rows = [(i, " ".join(["w"] * random.randint(5, 900)), f"s{i % 10}") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, least = Counter(), {}, defaultdict(lambda: 1 << 30)
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        least[r.source] = min(least[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= least[s] for s in target)


def test_mix_equal_rows_agree_whatever_their_order(spark):
    df = spark.createDataFrame([(7, f"w{k} b c", "s") for k in range(400)] + [(k, "w " * (k % 90), "s" if k % 3 else None) for k in range(500)], "doc_id long, text string, source string")
    runs = [Counter((r.doc_id, r.source, r.size, r.copies) for r in mixing.mix(x, block_rows=16).collect()) for x in (df, df.repartition(5), df.orderBy(F.desc("text")))]
    assert runs[0] == runs[1] == runs[2]


def test_mix_repeated_ids_and_empty(spark):
    rows = [(1, "a b c", "s", 0)] * 300 + [(None, "d e", None, 0), (2, None, "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = mixing.mix(df, block_rows=16).collect()
    assert len(got) == 302 and sum(r.copies * r.size for r in got) > 0
    assert mixing.apply_mix(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.apply_mix(df.limit(0)).count() == 0


def test_digest_of_query_columns(spark, ranks):
    path, pattern = ranks
    row = bpe.encode(docs(spark, ["hello world"]), path, pattern).select(F.sha2("ids", 256).alias("h"), "ids").first()
    assert row.h == hashlib.sha256(bytes(row.ids)).hexdigest()
