"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import extend_rows

#: From this many characters on, a text is encoded in parts.
PART_CHARS = 1 << 16

# Where a text may be cut without changing any match of the splitting pattern: before an ASCII blank or
# line feed that follows something that is not white space. Every match is either white space alone or
# ends before the next white space, and no alternative looks back, so both sides match as they do together.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")

# A long run of the splitting pattern's white space. The library's matcher keeps a stack entry for each of its
# characters and breaks down on very long ones, so their one match is told to it directly.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2048,}")


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut a long text at the first safe boundary after every ``size`` characters."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def encode_text(enc, text: str, size: int = PART_CHARS) -> list[list[int]]:
    """Ids of a whole text, in parts, as ``enc.encode_ordinary(text)`` would give them in one list."""
    out = []
    for part in parts(text, size):
        start = 0
        if len(part) >= 2048:
            for run in _LONG_BLANK.finditer(part):
                # All of the run is one match where the text ends; before other text its last character is not in it.
                end = run.end() if run.end() == len(part) else run.end() - 1
                out += [enc.encode_ordinary(part[start : run.start()]), enc._encode_single_piece(part[run.start() : end])]
                start = end
        out.append(enc.encode_ordinary(part[start:]))
    return out


@lru_cache(maxsize=4)
def _encoding(rank_file: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _ranks(df: DataFrame, rank_path: str):
    """The rank file's bytes (under a megabyte, whatever the corpus) as a broadcast value."""
    with open(rank_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", part_chars: int = PART_CHARS) -> DataFrame:
    """Token ids of every whole text, as binary: little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is merged by itself by the ranks of the file; special tokens are never
    produced. Texts over ``part_chars`` are cut at safe boundaries first, which changes no id and keeps
    the matcher's memory bounded. Null and empty texts give no ids (empty binary, count 0). Repeated
    rows give repeated results; other columns pass through, and columns named like the outputs are replaced.
    """
    import numpy  # noqa: F401  fails here, on the driver, rather than in a task

    ranks = _ranks(df, rank_path)

    def make():
        import numpy as np

        enc = _encoding(ranks.value, pattern)

        def fn(cols):
            ids, counts = [], []
            for text in cols[0]:
                got = encode_text(enc, text or "", part_chars)
                counts.append(sum(map(len, got)))
                ids.append(b"".join(np.asarray(g, dtype="<u4").tobytes() for g in got))
            return [ids, counts]

        return fn

    return extend_rows(df, [text_col], [T.StructField(ids_col, T.BinaryType()), T.StructField(count_col, T.LongType())], make)


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """The raw bytes that ids (as ``encode`` packs them) stand for; no UTF-8 is assumed.

    Null ids give null; ids outside the rank file, or a length that is no multiple of four, give null too.
    """
    ranks = _ranks(df, rank_path)

    def make():
        import numpy as np

        enc = _encoding(ranks.value, pattern)

        def one(ids):
            if ids is None or len(ids) % 4:
                return None
            try:
                return enc.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())
            except (KeyError, OverflowError):
                return None

        return lambda cols: [[one(x) for x in cols[0]]]

    return extend_rows(df, [ids_col], [T.StructField(bytes_col, T.BinaryType())], make)


def ids_array(packed) -> list[int]:
    """Packed ids as Python integers (for callers outside Spark)."""
    import numpy as np

    return np.frombuffer(packed, dtype="<u4").tolist()
