"""What the trained classifiers share: a bounded labelled sample, hashed words, and the held-out fold."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, importable

#: Labelled rows a classifier is fitted on at most, chosen by a hash of their ids, the longest text among them, and
#: the characters of all of them.
SAMPLE_ROWS = 5000
SAMPLE_CHARS = 40_000
SAMPLE_TOTAL = 32_000_000


def held_out(doc_id: Column) -> Column:
    """The fold no classifier learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, extra: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL) -> DataFrame:
    """(h, label, text, *extra) of at most ``rows`` labelled documents outside the held-out fold, by the hash h of their ids.

    The sample of labels is drawn first (a top-k), so what joins the documents is bounded by ``rows`` and is
    broadcast; texts over ``chars`` characters, and those by hash beyond ``total`` characters, are left out of the
    sample (not of scoring). Null labels, ids and texts are not learned from.
    """
    fold = F.xxhash64(F.col("id"))
    chosen = labels.select(col(id_col).alias("id"), col(label).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.select(fold.alias("h"), "id", "label").orderBy("h", "id", "label").limit(rows)
    texts = docs.select(col(id_col).alias("__id"), col(text_col).alias("__text"), *[col(c).alias(f"__x{k}") for k, c in enumerate(extra)])
    texts = texts.where(F.col("__text").isNotNull() & (F.length("__text") <= chars))
    joined = texts.join(F.broadcast(chosen), F.col("__id") == F.col("id")).select("h", "label", "__text", *[f"__x{k}" for k in range(len(extra))])
    taken = joined.orderBy("h", "label", "__text").limit(rows)
    # One task sees the sample anyway: the running sum over its ``rows`` rows bounds its characters.
    so_far = F.sum(F.length("__text")).over(Window.orderBy("h", "label", "__text").rowsBetween(Window.unboundedPreceding, 0))
    return taken.withColumn("__sum", so_far).where(F.col("__sum") <= total).drop("__sum")


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], Any]) -> Any:
    """What ``fit`` makes of the sample's rows, one for each hash, by hash. It runs in a task, which is run again where
    its executor is lost; the driver gets the model alone, never the texts."""
    importable(sample.sparkSession)

    def run(batches):
        import pyarrow as pa

        got: dict = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got.setdefault(row[0], row)
        model = fit([got[h] for h in sorted(got)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, protocol=5)], pa.binary())], names=["model"])

    made = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return fit([]) if made is None else pickle.loads(made[0])


class WordIds(dict):
    """Hashed ids of words, 1 to 2**bits - 1; kept per process, forgotten when many."""

    MOST = 400_000

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        bare = word.strip(".,;:!?\"'()[]{}<>*#$%&|_-=+/\\~`^") or word
        got = self[word] = max(1, zlib.crc32(bare.encode("utf-8", "replace")) & self.mask)
        return got

    def of(self, words: list[str]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


#: Lengths of the word beginnings that are hashed beside the word, so that inflected forms share weights.
STARTS = (3, 4, 5)


class WordParts(dict):
    """Words numbered per process, and for each number the hashed ids of the word and its beginnings.

    ``parts`` has a row of ids for each number; row 0 is padding. Forgotten by ``trim`` when there are many.
    """

    MOST = 400_000
    WIDTH = 1 + len(STARTS)

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1
        self.parts: list[tuple[int, ...]] = [(0,) * self.WIDTH]

    def _hash(self, kind: str, word: str) -> int:
        return max(1, zlib.crc32(f"{kind}:{word}".encode("utf-8", "replace")) & self.mask)

    def __missing__(self, word: str) -> int:
        bare = word.strip(".,;:!?\"'()[]{}<>*#$%&|_-=+/\\~`^") or word
        got = self[word] = len(self.parts)
        self.parts.append((self._hash("w", bare), *(self._hash(str(n), bare[:n]) for n in STARTS)))
        return got

    def of(self, words: list[str]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))

    def trim(self) -> bool:
        """Forget all words if there are many; numbers given before then mean nothing. True if so."""
        if len(self) < self.MOST:
            return False
        self.clear()
        self.parts = self.parts[:1]
        return True
