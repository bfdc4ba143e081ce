"""Personal data: base patterns, then information-theoretic sanitisation of the terms that reveal them.

Base spans are found by pattern. Every term of a text that holds an entity is judged by how much of the entity's
information it gives away: PMI(entity; term) / IC(entity), from document counts over the whole corpus. The share is 1 for a
term seen only with that entity. Terms whose pair has support in several different texts and whose share reaches
a threshold are generalised to their kind, or, beyond a second threshold, removed, wherever they occur in any text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, extend_rows, keep

KINDS = ("email", "ip", "card", "phone", "term")
#: Different texts that must hold the pair, and the shares from which a term is generalised and removed.
LEAST_TEXTS = 3
GENERALISE_AT = 0.85
REMOVE_AT = 0.97
#: Bytes of keys that are broadcast at most.
SENT_BYTES = 16 << 20

#: What is no part of a term: ASCII white space and punctuation; the same in Java and Python.
NO_TERM = r"\x20\x09-\x0D\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
_TERM = re.compile(f"[^{NO_TERM}]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A leftmost match can only begin where a run of digits does, so the runs need no second look.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    """Leftmost non-overlapping e-mail addresses, found from each @ in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every base span, in that order; offsets count code points."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity_of(text: str, kind: int, start: int, end: int) -> str:
    """What a span names, whatever its spelling."""
    value = text[start:end]
    return f"{KINDS[kind]}:" + (value.lower() if kind < 2 else re.sub("[^0-9]", "", value))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))
_TERMS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("removed", T.BooleanType())]))


def find_base(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds base (sorted array of start, kind, end) and, for texts with any, entities, outer and inner.

    All are different values: outer the terms that occur outside base spans, inner those that occur in them only.
    """

    def make():
        def one(text):
            spans = base_spans(text)
            if not spans:
                return [], [], [], []
            outer = {m.group() for m in outside(text, spans)}
            inner = set(_TERM.findall(text)) - outer
            entities = {entity_of(text, k, a, b) for a, k, b in spans}
            return [{"start": a, "kind": k, "end": b} for a, k, b in spans], sorted(entities), sorted(outer), sorted(inner)

        return lambda cols: list(zip(*(one(text or "") for text in cols[0]), strict=True)) or [[], [], [], []]

    names = T.ArrayType(T.StringType())
    return extend_rows(df, [text_col], [T.StructField("base", _SPANS), *(T.StructField(x, names) for x in ("entities", "outer", "inner"))], make)


def disclosures(found: DataFrame, texts: DataFrame, n_rows: int, least_texts: int, generalise_at: float, remove_at: float) -> DataFrame:
    """(entity, term, removed) of the pairs whose term gives the entity away.

    ``found``: text_key, entities, outer and inner of every row that has base spans; ``texts``: one column, all
    texts. All counts are of documents with the term anywhere outside base spans. Entities and terms that
    can't reach the support or the share, whatever their pair's count, are left out before pairs are made.
    """
    # One row per different text with its number of documents: groups of copies are summed before they meet.
    per_text = found.groupBy("text_key").agg(F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("entities", "outer", "inner")])
    per_text = keep(per_text, "pii-texts")
    holders = per_text.select("text_key", "m", F.explode("entities").alias("entity"))
    entities = holders.groupBy("entity").agg(F.sum("m").alias("n_entity"), F.count(F.lit(1)).alias("n_texts"))
    # An entity that every document holds has no content to give away.
    entities = keep(entities.where((F.col("n_texts") >= least_texts) & (F.col("n_entity") < n_rows)).drop("n_texts"), "pii-entities")
    most = entities.agg(F.max("n_entity")).first()[0]
    if most is None:
        return entities.select("entity", F.lit("").alias("term"), F.lit(True).alias("removed"))

    def can_reach(n_entity):
        """The most documents a term can have and reach the share where each of the entity's has it, and a bit more."""
        return F.lit(1.000001) * F.pow(F.lit(float(n_rows)), F.lit(1 - generalise_at)) * F.pow(n_entity.cast("double"), F.lit(generalise_at))

    held = keep(holders.join(_sent(entities), "entity").select("text_key", "entity", "n_entity"), "pii-held")
    keys = keep(held.select("text_key").distinct(), "pii-keys")
    told = per_text.join(_sent(keys), "text_key", "left_semi").select("text_key", "m", F.explode("outer").alias("term"))
    terms = told.groupBy("term").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("m").alias("n")).where((F.col("n_texts") >= least_texts) & (F.col("n") <= can_reach(F.lit(most)))).select("term")
    terms = _sent(keep(terms, "pii-terms-held"))
    # Documents that hold the term at all, less those that hold it in base spans only.
    every = texts.select(F.explode(_all_terms(texts[0])).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    within = per_text.select("m", F.explode("inner").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg((-F.sum("m")).alias("n"))
    counts = every.unionByName(within).groupBy("term").agg(F.sum("n").alias("n_term")).where(F.col("n_term") <= can_reach(F.lit(most)))
    counts = _sent(keep(counts, "pii-counts"))
    pairs = told.join(counts, "term").join(held, "text_key").where(F.col("n_term") <= can_reach(F.col("n_entity")))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("m").alias("n_both"), F.count(F.lit(1)).alias("n_texts"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    pmi = F.log2(F.col("n_both") * F.lit(float(n_rows)) / (F.col("n_entity") * F.col("n_term")))
    share = pmi / F.log2(F.lit(float(n_rows)) / F.col("n_entity"))
    return pairs.where((F.col("n_texts") >= least_texts) & (share >= generalise_at)).select("entity", "term", (share >= remove_at).alias("removed"))


def _sent(keys: DataFrame) -> DataFrame:
    """``keys`` (kept), to be broadcast while their bytes are few; else the join is Spark's, which splits hot keys."""
    n = keys.agg(F.sum(sum(F.octet_length(c) if t == "string" else F.lit(8) for c, t in keys.dtypes))).first()[0]
    return F.broadcast(keys) if (n or 0) <= SENT_BYTES else keys


def _all_terms(text):
    """The different terms of a whole text, an array column; there may be an empty one."""
    return F.array_distinct(F.split(F.coalesce(text, F.lit("")), f"[{NO_TERM}]+"))


def outside(text: str, base: list[tuple[int, int, int]]):
    """The matches of all terms of the text that touch no base span, in order."""
    spans, k = sorted((a, b) for a, _, b in base), 0
    reach = 0  # the furthest end of the spans that begin before the term's end
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= m.start():
            yield m


def mark(rows: DataFrame, revealing: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, terms) of each text that holds a revealing term, whether it holds the entity or not.

    ``rows``: text_key and text of all rows; terms: start, end and removed of every occurrence outside base
    spans. The share is corpus-wide, so a term that any entity's share removes goes from every text.
    """
    told = keep(revealing.groupBy("term").agg(F.max("removed").alias("removed")), "pii-told")
    exploded = rows.select("text_key", F.explode(_all_terms(col(text_col))).alias("term"))
    hits = exploded.join(_sent(told), "term").groupBy("text_key").agg(F.collect_set(F.struct("term", "removed")).alias("__told"))
    hits = keep(hits, "pii-hits")
    # Only texts with a hit are sent on, each once.
    texts = rows.select("text_key", col(text_col).alias("__text")).join(_sent(hits.select("text_key")), "text_key", "left_semi").dropDuplicates(["text_key"])

    def make():
        def one(text, told):
            removed = {x["term"]: x["removed"] for x in told}
            return [{"start": m.start(), "end": m.end(), "removed": removed[m.group()]} for m in outside(text, base_spans(text)) if m.group() in removed]

        return lambda cols: [[one(*x) for x in zip(*cols, strict=True)]]

    marked = extend_rows(texts.join(hits, "text_key"), ["__text", "__told"], [T.StructField("terms", _TERMS)], make)
    return marked.select("text_key", "terms").where(F.size("terms") > 0)


def find(df: DataFrame, text_col: str = "text", least_texts: int = LEAST_TEXTS, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> tuple[DataFrame, DataFrame]:
    """Base spans of all rows, and the disclosing terms' spans of each text that has any.

    Gives (``df`` with text_key and base for its text column; table of text_key and terms, an array of
    start, end, removed). Terms depend on a text and the corpus, so rows of equal texts share them.
    """
    keyed = df.withColumn("text_key", F.md5(F.coalesce(col(text_col), F.lit(""))))
    based = keep(find_base(keyed, text_col).drop(text_col), "pii-base")
    found = based.where(F.size("base") > 0).select("text_key", "entities", "outer", "inner")
    revealing = keep(disclosures(found, df.select(col(text_col)), based.count(), least_texts, generalise_at, remove_at), "pii-revealing")
    return based.drop("entities", "outer", "inner"), keep(mark(keyed.select("text_key", col(text_col)), revealing, text_col), "pii-terms")


def spans(df: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """Every row, its text left out, with base and terms: all spans found in its whole text.

    Null and empty texts have none. Repeated rows each count as a document and get equal spans. Columns
    named base, terms, entities, outer, inner or text_key are replaced. An empty table gives no rows.
    """
    based, terms = find(df, text_col, **how)
    return based.join(terms, "text_key", "left").drop("text_key")


def spelled(base, terms=None):
    """kind:start:end of base spans (and terms), by start and kind, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    all_of = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    if terms is not None:
        extra = F.transform(F.coalesce(terms, F.array().cast("array<struct<start:bigint,end:bigint,removed:boolean>>")), lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end")))
        all_of = F.array_sort(F.concat(all_of, extra))
    return F.array_join(F.transform(all_of, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")


def cleaned(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, bool]]) -> str:
    """The text with base spans replaced by their kind and terms generalised or removed; overlaps go once."""
    marks = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in base]
    marks += [(a, b, "" if removed else "[NUMBER]" if text[a:b].isdigit() else "[NAME]" if text[a:b][:1].isupper() else "[TERM]") for a, b, removed in terms]
    out, at = [], 0
    for a, b, label in sorted(marks):
        if a >= at:
            out += [text[at:a], label]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(df: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``df`` with the personal data in its texts replaced; rows without any keep their text, null stays null.

    The terms' table joins by size: broadcast while small, else by text key.
    """
    names = df.columns
    _, terms = find(df.select(col(text_col)), text_col, **how)
    keyed = df.withColumn("__key", F.md5(F.coalesce(col(text_col), F.lit(""))))
    joined = keyed.join(terms.select(F.col("text_key").alias("__key"), F.col("terms").alias("__terms")), "__key", "left").drop("__key")

    def make():
        def one(text, found):
            base = base_spans(text or "")
            return cleaned(text, base, [(x["start"], x["end"], x["removed"]) for x in found or ()]) if base or found else text

        return lambda cols: [[one(*x) for x in zip(*cols, strict=True)]]

    return extend_rows(joined, [text_col, "__terms"], [T.StructField(text_col, T.StringType())], make).select(*[col(c) for c in names])
