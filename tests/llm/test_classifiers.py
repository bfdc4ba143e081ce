"""Held-out accuracy of the classifiers on made-up languages, the fold, and edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from factweave.llm import labelled, quality_fm, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(3, 8)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(random.randint(15, 80))]
        toxic, bad = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(3):
                words[random.randrange(len(words))] = random.choice(["zzrude", "zzvile", "qqfoul"]) + random.choice(["a", "o", "en"])
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "xx" if i % 2 else None, i))
        labels.append((i, None if i % 50 == 3 else int(not bad), int(toxic)))
    rows += [(900, None, "xx", None), (901, "", None, 0), (902, "zzrudea " * 60_000, "yy", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels}


def accuracy(got, truth, place, cut):
    apart = [i for i in got if i in truth and zlib.crc32(str(i).encode()) % 4 == 2 and truth[i][place] is not None]
    return np.mean([(got[i].score >= cut) == bool(truth[i][place]) for i in apart]), len(apart)


def test_toxicity_learns_word_beginnings(corpus):
    docs, labels, truth = corpus
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right, n = accuracy(got, truth, 2, 0.3)
    assert n > 100 and right > 0.95
    assert len(got) == 903 and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].score == got[901].score and got[902].rejected  # a whole long text is scored, piece by piece


def test_thresholds_cover_all_labelled_rows(corpus):
    docs, labels, truth = corpus
    model = toxicity.fit(docs, labels, rows=60)  # a fifth of 60 rows has too few toxic ones for any language
    sample = labelled.labelled_sample(docs, labels, "toxic", ("lang",), rows=60).collect()
    trained = [r[0] for r in sample if r[0] % 5]
    counts = toxicity.calibration_counts(docs, labels, model, trained, "toxic", "doc_id", "text", "lang")
    fold = [i for i in truth if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sum(r[3] for r in counts) == len(fold) - len(trained) > 500
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    ids = {r.id: r.h for r in labels.selectExpr("doc_id id", "xxhash64(doc_id) h").collect()}
    apart = [i for i in fold if ids[i] not in trained and i % 2]

    def f1(t):
        flagged = [i for i in apart if got[i].score >= t]
        return round(2 * sum(truth[i][2] for i in flagged) / max(1, len(flagged) + sum(truth[i][2] for i in apart)), 6)

    want = max(toxicity.GRID, key=lambda t: (f1(t), -abs(t - toxicity.THRESHOLD)))
    assert model.thresholds == {"xx": want}


def test_quality_fm_learns(corpus):
    docs, labels, truth = corpus
    model = quality_fm.fit(docs, labels, meta_cols=("n_chars",))
    got = {r.doc_id: r for r in quality_fm.score(docs, model, ("n_chars",)).collect()}
    right, n = accuracy(got, truth, 1, 0.7)
    assert n > 100 and right > 0.95 and 0 <= got[900].score <= 1


def test_fm_identity_equals_the_pairs():
    rng = np.random.default_rng(2)
    m = quality_fm.Model(0.1, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, quality_fm.RANK)).astype(np.float32), 0)
    at, x = np.asarray([3, 7, 20, 41]), np.asarray([0.5, 1.0, 0.25, 2.0], dtype=np.float32)
    pairs = sum(float(m.factors[at[i]] @ m.factors[at[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    want = 1 / (1 + np.exp(-(0.1 + float(m.linear[at] @ x) + pairs)))
    assert abs(quality_fm.scores(m, [(at, x)])[0] - want) < 1e-5


def test_pieces_pool_like_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    m = toxicity.train([], np.zeros(0), np.zeros((1, 4), int))
    vectors = rng.normal(size=(100, toxicity.DIM)).astype(np.float32)
    vectors[0] = 0  # padding
    docs = [rng.integers(1, 100, n).astype(np.int32) for n in (0, 1, 2, 3, 50, 400)]
    whole = toxicity.pooled(m, vectors, docs)
    monkeypatch.setattr(toxicity, "PIECE", 16)
    assert np.allclose(whole, toxicity.pooled(m, vectors, docs), atol=1e-5)


def test_score_equals_a_plain_convolution():
    rng = np.random.default_rng(9)
    m = toxicity.train([], np.zeros(0), np.zeros((1, 4), int))
    m.out, m.bias, m.out_bias = rng.normal(size=m.out.shape).astype(np.float32), rng.normal(size=m.bias.shape).astype(np.float32), -0.3
    vectors = rng.normal(size=(60, toxicity.DIM)).astype(np.float32)
    vectors[0] = 0  # padding
    docs = [rng.integers(1, 60, n).astype(np.int32) for n in (1, 2, 3, 7, 40)]
    for d, got in zip(docs, toxicity.scores(m, vectors, docs), strict=True):
        best, at = [], 0
        for width in toxicity.WIDTHS:
            kernel = m.conv[:, at : at + width * toxicity.FILTERS].reshape(toxicity.DIM, width, toxicity.FILTERS)
            at += width * toxicity.FILTERS
            padded = np.concatenate([vectors[d], np.zeros((width - 1, toxicity.DIM))])  # every window that starts in the text
            best += [max(sum(float(padded[p + i] @ kernel[:, i, f]) for i in range(width)) for p in range(len(d))) for f in range(toxicity.FILTERS)]
        want = 1 / (1 + np.exp(-(np.maximum(np.asarray(best) + m.bias, 0) @ m.out + m.out_bias)))
        assert abs(got - want) < 1e-5


def test_fold_and_sample_bound(corpus):
    docs, labels, truth = corpus
    got = labelled.labelled_sample(docs, labels, "quality", rows=100).collect()
    assert 80 <= len(got) <= 100
    some = labelled.labelled_sample(docs, labels, "quality", rows=100, total=2000).collect()
    assert sum(len(r[2]) for r in some) <= 2000 and [r[0] for r in some] == [r[0] for r in got][: len(some)] and some
    rows = labels.select("doc_id", labelled.held_out(labels.doc_id).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_empty_tables(corpus):
    docs, labels, _ = corpus
    for module in (toxicity, quality_fm):
        model = module.fit(docs.limit(0), labels.limit(0))
        assert module.score(docs.limit(0), model).count() == 0
        assert all(0 <= r.score <= 1 for r in module.score(docs.limit(5), model).collect())
