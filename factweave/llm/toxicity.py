"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

Hashed word embeddings (a word's is the sum of those of its hash and of its hashed beginnings), filters over one, two and three words, max pooling over the whole text and a logistic
output. Weights are a few megabytes whatever the corpus and are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, extend_rows, keep
from .labelled import SAMPLE_ROWS, WordParts, fitted, held_out, labelled_sample

BITS, DIM, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
GAP = max(WIDTHS) - 1
#: Words scored at once; longer texts go through in overlapping pieces.
PIECE = 1 << 15
EPOCHS, BATCH, RATE = 8, 32, 0.05
#: The default threshold, and the positives a language needs for its own.
THRESHOLD, LEAST_POSITIVES = 0.3, 10
#: The threshold where nothing is known: no score reaches it.
NEVER = 2.0


@dataclass
class Model:
    emb: np.ndarray  # hashes x DIM; row 0 is padding and stays zero
    conv: np.ndarray  # DIM x (one block of FILTERS for each width and offset)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict = field(default_factory=dict)  # language -> threshold
    default: float = THRESHOLD


def _blocks() -> list[tuple[int, int, int]]:
    """(width's number, offset, column) of the blocks of ``conv``."""
    out, at = [], 0
    for k, w in enumerate(WIDTHS):
        for i in range(w):
            out.append((k, i, at))
            at += FILTERS
    return out


def _layout(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids with a gap of padding after each text, and where texts start; a text without words is one padding."""
    parts, starts, at = [], [], 0
    gap = np.zeros(GAP, dtype=np.int32)
    for d in docs:
        d = d if len(d) else np.zeros(1, dtype=np.int32)
        starts.append(at)
        parts += [d, gap]
        at += len(d) + GAP
    return np.concatenate(parts), np.asarray(starts)


def _responses(m: Model, vectors: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each width the filters' responses at every window that starts in a text; ``vectors`` has a row a word."""
    z = vectors[ids] @ m.conv
    n = len(ids) - GAP
    inside = np.ones(n, dtype=bool)
    for g in range(1, GAP + 1):
        inside[starts[1:] - g] = False
    made = []
    for k in range(len(WIDTHS)):
        r = sum(z[i : i + n, at : at + FILTERS] for kk, i, at in _blocks() if kk == k)
        r[~inside] = -1e9
        made.append(r)
    return made


def word_vectors(m: Model, parts) -> np.ndarray:
    return m.emb[np.asarray(parts, dtype=np.int32).reshape(-1, WordParts.WIDTH)].sum(1)


def _pooled(m: Model, vectors: np.ndarray, docs: list[np.ndarray], cut: list[bool]) -> np.ndarray:
    """``cut`` texts go on in another piece: windows that start in their last words belong to that one."""
    ids, starts = _layout(docs)
    open_ = np.asarray([a + len(d) - g for a, d, c in zip(starts, docs, cut, strict=True) if c for g in range(1, GAP + 1)], dtype=np.int64)
    out = []
    for r in _responses(m, vectors, ids, starts):
        r[open_] = -1e9
        out.append(np.maximum.reduceat(r, starts, axis=0))
    return np.concatenate(out, axis=1)


def pooled(m: Model, vectors: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Max-pooled responses of whole texts, piece by piece, so that memory does not follow a text's length."""
    pieces, owner, cut = [], [], []
    for k, d in enumerate(docs):
        for a in range(0, max(1, len(d) - GAP), PIECE):
            pieces.append(d[a : a + PIECE + GAP])
            owner.append(k)
            cut.append(a + PIECE + GAP < len(d))
    out = np.full((len(docs), FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
    a = 0
    while a < len(pieces):
        b, n = a, 0
        while b < len(pieces) and (b == a or n + len(pieces[b]) <= PIECE):
            n += len(pieces[b])
            b += 1
        np.maximum.at(out, owner[a:b], _pooled(m, vectors, pieces[a:b], cut[a:b]))
        a = b
    return out


def scores(m: Model, vectors: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Scores of texts given as word numbers, whose vectors are the rows of ``vectors``."""
    hidden = np.maximum(pooled(m, vectors, docs) + m.bias, 0)
    return 1 / (1 + np.exp(-(hidden.astype(np.float64) @ m.out.astype(np.float64) + m.out_bias)))


def train(docs: list[np.ndarray], labels: np.ndarray, parts: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fit by mini-batches with Adagrad; the first embedding dimension starts at the hashes' shrunken log-odds.

    ``docs`` are word numbers, ``parts`` the hashed ids of each number.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    emb = rng.normal(0, 0.02, (size, DIM)).astype(np.float32)
    seen = [np.zeros(size), np.zeros(size)]
    for d, y in zip(docs, labels, strict=True):
        seen[int(y)][np.unique(parts[d])] += 1
    n1, n0 = max(1, labels.sum()), max(1, (1 - labels).sum())
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    emb[:, 0] = np.where(seen[1] + seen[0] > 0, odds * seen[1] / (seen[1] + 5), -0.1) / 2
    emb[0] = 0
    conv = rng.normal(0, 0.3, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32)
    conv[0] = np.abs(conv[0])
    prior = float(np.log(n1 / n0))
    m = Model(emb, conv, np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), 0.2, np.float32), prior)
    sums = {k: np.full_like(v, 1e-2, dtype=np.float32) for k, v in (("conv", conv), ("bias", m.bias), ("out", m.out))}
    emb_sum, out_sum = np.full(size, 1e-2, np.float32), 1e-2
    for _ in range(epochs if docs else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            batch, y = [docs[k] for k in pick], labels[pick].astype(np.float32)
            ids, starts = _layout(batch)
            ends = np.append(starts[1:], len(ids) - GAP)
            used, short = np.unique(ids, return_inverse=True)
            vectors = word_vectors(m, parts[used])
            resp = _responses(m, vectors, short, starts)
            places = [np.stack([r[a:b].argmax(0) + a for a, b in zip(starts, ends, strict=True)]) for r in resp]
            pool = np.concatenate([np.take_along_axis(r, p, 0) for r, p in zip(resp, places, strict=True)], axis=1)
            act = pool + m.bias
            hidden = np.maximum(act, 0)
            g = (1 / (1 + np.exp(-(hidden @ m.out + m.out_bias))) - y) / len(pick)
            d_act = g[:, None] * m.out * (act > 0)
            d_conv = 1e-5 * m.conv
            rows, grads = [], []
            for k, i, c in _blocks():
                where = places[k] + i
                d = d_act[:, k * FILTERS : (k + 1) * FILTERS]
                d_conv[:, c : c + FILTERS] += np.einsum("bfd,bf->df", vectors[short[where]], d)
                hashes = parts[ids[where]].reshape(-1, WordParts.WIDTH)
                grad = (d[:, :, None] * m.conv[:, c : c + FILTERS].T).reshape(-1, DIM)
                rows += list(hashes.T)
                grads += [grad] * WordParts.WIDTH
            for name, d in (("conv", d_conv), ("bias", d_act.sum(0)), ("out", hidden.T @ g + 1e-5 * m.out)):
                sums[name] += d * d
                setattr(m, name, getattr(m, name) - RATE * d / np.sqrt(sums[name]))
            out_sum += float(g.sum()) ** 2
            m.out_bias -= RATE * float(g.sum()) / out_sum**0.5
            which, back = np.unique(np.concatenate(rows), return_inverse=True)
            d_emb = np.zeros((len(which), DIM), np.float32)
            np.add.at(d_emb, back, np.concatenate(grads))
            emb_sum[which] += (d_emb * d_emb).sum(1)
            m.emb[which] -= RATE * d_emb / np.sqrt(emb_sum[which])[:, None]
            m.emb[0] = 0
    return m


#: The thresholds a language can have.
GRID = [round(k / 20, 2) for k in range(2, 19)]
#: Labelled ids that are broadcast at most.
SENT_IDS = 1 << 20


def calibrate(m: Model, counts: list[tuple]) -> None:
    """Per language the threshold of the best F1 on rows not trained on, nearest the default among equals.

    ``counts``: language, number of the grid's thresholds that a score reaches, toxic rows, all rows.
    """

    def best(rows: list[tuple]) -> float | None:
        toxic = sum(r[2] for r in rows)

        def f1(k: int) -> float:
            hit, flagged = (sum(r[x] for r in rows if r[1] > k) for x in (2, 3))
            return 2 * hit / max(1, flagged + toxic)

        return GRID[max(range(len(GRID)), key=lambda k: (round(f1(k), 6), -abs(GRID[k] - THRESHOLD)))] if toxic >= LEAST_POSITIVES else None

    by_lang: dict = {}
    for row in counts:
        by_lang.setdefault(row[0], []).append(row)
    m.default = best(counts) or THRESHOLD
    m.thresholds = {lang: t for lang, rows in by_lang.items() if lang is not None and (t := best(rows))}


def calibration_counts(docs: DataFrame, labels: DataFrame, m: Model, trained: list[int], label: str, id_col: str, text_col: str, lang_col: str) -> list[tuple]:
    """(language, thresholds reached, toxic rows, rows) of all labelled rows outside the held-out fold and the
    trained ids' hashes. Scored where the rows lie; languages too rare for a threshold count together, as null."""
    spark = docs.sparkSession
    known = labels.select(col(id_col).alias("__id"), col(label).cast("int").alias("__label")).where(F.col("__id").isNotNull() & F.col("__label").isNotNull() & ~held_out(F.col("__id")))
    seen = spark.createDataFrame([(h,) for h in trained], "h long")
    known = known.join(F.broadcast(seen), F.xxhash64("__id") == F.col("h"), "left_anti").groupBy("__id").agg(F.min("__label").alias("__label"))
    known = keep(known, "toxicity-labels")
    known = F.broadcast(known) if known.count() <= SENT_IDS else known
    texts = docs.where(col(text_col).isNotNull()).select(col(id_col).alias("__doc"), col(text_col).alias("__text"), col(lang_col).alias("lang"))
    texts = texts.join(known, F.col("__doc") == F.col("__id")).select("lang", "__label", "__text")
    scored = score(texts, m, "__text", None)
    reached = sum((F.col("score") >= t).cast("int") for t in GRID)
    counts = scored.select("lang", reached.alias("reached"), (F.col("__label") != 0).cast("long").alias("toxic")).groupBy("lang", "reached").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    counts = keep(counts, "toxicity-counts")
    own = counts.groupBy("lang").agg(F.sum("toxic").alias("all")).where(F.col("lang").isNotNull() & (F.col("all") >= LEAST_POSITIVES)).select(F.col("lang").alias("__own"))
    named = counts.join(own, F.col("lang") == F.col("__own"), "left").groupBy("__own", "reached").agg(F.sum("toxic"), F.sum("n"))
    return [tuple(r) for r in named.collect()]


def _fit_rows(sample: list[tuple]) -> tuple[Model, list[int], bool]:
    """The model of rows (hash, label, text) without every fifth by hash, the hashes of those it learned from, and
    whether both kinds were among them."""
    words = WordParts(BITS)
    words.MOST = 1 << 30  # the sample is bounded
    rows = [r for r in sample if r[0] % 5]
    texts = [words.of(r[2].lower().split()) for r in rows]
    y = np.asarray([1 if r[1] else 0 for r in rows], dtype=np.int64)
    return train(texts, y, np.asarray(words.parts, dtype=np.int32)), [r[0] for r in rows], bool(0 < y.sum() < len(y))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` labelled rows outside the held-out fold, without every fifth by hash; all
    other labelled rows outside the fold calibrate the thresholds.

    The language serves the thresholds alone; no score depends on it. Without labelled rows of both
    kinds the model scores by its prior and rejects nothing.
    """
    sample = labelled_sample(docs, labels, label, (), id_col, text_col, rows)
    m, trained, both = fitted(sample, _fit_rows)
    if both:
        calibrate(m, calibration_counts(docs, labels, m, trained, label, id_col, text_col, lang_col))
    else:
        m.default = NEVER
    return m


def score(df: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Adds score (0 to 1) of every whole text, threshold (its language's) and rejected (score >= threshold).

    Null and empty texts score as a text without words. A null or unseen language, or none, has the default
    threshold. Columns of the outputs' names are replaced; an empty table stays empty.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m, words = held.value, WordParts(BITS)
        vectors = np.zeros((1, DIM), np.float32)

        def fn(cols):
            nonlocal vectors
            if words.trim():
                vectors = vectors[:1]
            docs = [words.of((t or "").lower().split()) for t in cols[0]]
            if len(words.parts) > len(vectors):
                vectors = np.concatenate([vectors, word_vectors(m, words.parts[len(vectors) :])])
            return [scores(m, vectors, docs).tolist()]

        return fn

    out = extend_rows(df, [text_col], [T.StructField("score", T.DoubleType())], make)
    limit = F.lit(model.default)
    if lang_col and model.thresholds:
        known = F.create_map(*[F.lit(x) for k in sorted(model.thresholds) for x in (k, model.thresholds[k])])
        limit = F.coalesce(F.try_element_at(known, col(lang_col)), limit)
    return out.withColumn("threshold", limit).withColumn("rejected", F.col("score") >= F.col("threshold"))
