"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have rank ``RANK``; they are scored in time linear in a text's features by
sum over pairs <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import extend_rows
from .labelled import SAMPLE_ROWS, WordIds, fitted, labelled_sample

BITS, RANK = 17, 6
EPOCHS, BATCH, RATE = 12, 64, 0.08
#: Structure statistics, and into how many buckets each is cut.
STATS = ("words", "mean length", "distinct words", "upper", "symbols", "bangs", "bars", "digits", "marks", "lines", "repeated lines", "repeated windows", "commonest word", "other bytes")
CUTS = 12


def structure(text: str, ids: np.ndarray) -> list[float]:
    """The statistics of a whole text, each squashed to about 0..1."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    n, chars = len(ids), max(1, len(text))
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct, times = np.unique(ids, return_counts=True)
    repeated = 0.0
    if n >= 5:
        wide = ids.astype(np.int64)
        windows = sum(wide[k : n - 4 + k] * c for k, c in enumerate((1, 1_000_003, 998_244_353, 15_485_863, 32_452_843)))
        repeated = 1 - len(np.unique(windows)) / len(windows)
    per = lambda codes: min(1.0, int(counts[[ord(c) for c in codes]].sum()) / max(1, n))
    return [
        min(1.0, np.log1p(n) / 12), min(1.0, chars / max(1, n) / 20), len(distinct) / max(1, n), int(counts[65:91].sum()) / letters,
        per("#*$%&<>"), per("!?"), per("|"), per("0123456789"), per(".,;:"), min(1.0, len(lines) / max(1, n) * 5),
        1 - len(set(lines)) / max(1, len(lines)), repeated, int(times.max()) / n if n else 0.0, int(counts[128:].sum()) / max(1, int(counts.sum())),
    ]


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # features x RANK
    meta: int  # number of metadata columns

    @property
    def first_stat(self) -> int:
        return 1 << BITS


def n_features(n_meta: int) -> int:
    return (1 << BITS) + (len(STATS) + n_meta) * (CUTS + 1)


def features(text: str, meta: list, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: words by presence, statistics and metadata by bucket; linear in the text."""
    words = ids.of(text.lower().split())
    distinct = np.unique(words)
    values = [structure(text, words)]
    # A number of the metadata is taken by its logarithm; anything else by a hash; null is a bucket of its own.
    cuts = [min(CUTS - 1, int(v * CUTS)) for v in values[0]]
    for x in meta:
        cuts.append(CUTS if x is None else min(CUTS - 1, int(np.log1p(abs(x)))) if isinstance(x, (int, float)) else WordIds(16)[str(x)] % CUTS)
    slots = np.asarray([(1 << BITS) + k * (CUTS + 1) + c for k, c in enumerate(cuts)], dtype=np.int64)
    x = np.concatenate([np.full(len(distinct), 1 / max(1.0, len(distinct)) ** 0.5), np.full(len(slots), 0.5)]).astype(np.float32)
    return np.concatenate([distinct.astype(np.int64), slots]), x


def _raw(m: Model, feats: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
    at = np.concatenate([f for f, _ in feats])
    x = np.concatenate([v for _, v in feats])
    starts = np.cumsum([0] + [len(f) for f, _ in feats[:-1]])
    vx = m.factors[at] * x[:, None]
    total = np.add.reduceat(vx, starts, axis=0)
    pairs = 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
    return m.bias + np.add.reduceat(m.linear[at] * x, starts) + pairs, at, x, starts, vx, total


def scores(m: Model, feats: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    if not feats:
        return np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(_raw(m, feats)[0].astype(np.float64), -40, 40)))


def train(feats: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_meta: int, seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Adagrad on the logistic loss in mini-batches, from small random factors."""
    rng = np.random.default_rng(seed)
    size = n_features(n_meta)
    prior = float(np.log((labels.sum() + 1) / ((1 - labels).sum() + 1)))
    m = Model(prior, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, RANK)).astype(np.float32), n_meta)
    lin_sum, fac_sum, bias_sum = np.full(size, 1e-2, np.float32), np.full(size, 1e-2, np.float32), 1e-2
    for _ in range(epochs if len(feats) else 0):
        order = rng.permutation(len(feats))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            raw, at, x, starts, vx, total = _raw(m, [feats[k] for k in pick])
            g = ((1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[pick]) / len(pick)).astype(np.float32)
            sizes = np.diff(np.append(starts, len(at)))
            gx = np.repeat(g, sizes) * x
            which, back = np.unique(at, return_inverse=True)
            d_lin = np.bincount(back, gx, len(which)).astype(np.float32) + 1e-6 * m.linear[which]
            pull = gx[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            d_fac = np.stack([np.bincount(back, pull[:, k], len(which)) for k in range(RANK)], axis=1).astype(np.float32) + 1e-6 * m.factors[which]
            lin_sum[which] += d_lin**2
            fac_sum[which] += (d_fac**2).mean(1)
            bias_sum += float(g.sum()) ** 2
            m.linear[which] -= RATE * d_lin / np.sqrt(lin_sum[which])
            m.factors[which] -= RATE * d_fac / np.sqrt(fac_sum[which])[:, None]
            m.bias -= RATE * float(g.sum()) / bias_sum**0.5
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", meta_cols: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` labelled rows outside the held-out fold; label 1 is good."""
    n_meta = len(meta_cols)

    def of_rows(sample: list[tuple]) -> Model:
        ids = WordIds(BITS)
        feats = [features(r[2], list(r[3:]), ids) for r in sample]
        return train(feats, np.asarray([1.0 if r[1] else 0.0 for r in sample], dtype=np.float32), n_meta)

    return fitted(labelled_sample(docs, labels, label, tuple(meta_cols), id_col, text_col, rows), of_rows)


def score(df: DataFrame, model: Model, meta_cols: tuple[str, ...] = (), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the probability of label 1 for every whole text.

    Null and empty texts are texts without words, null metadata a bucket of its own. A column of the
    output's name is replaced; repeated rows score alike; an empty table stays empty.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m, ids = held.value, WordIds(BITS)
        return lambda cols: [scores(m, [features(t or "", list(meta), ids) for t, *meta in zip(*cols, strict=True)]).tolist()]

    return extend_rows(df, [text_col, *meta_cols], [T.StructField(score_col, T.DoubleType())], make)
