"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only.

Every rule's measure is a whole number per document. Per language and source the measures go into a sketch of
counted buckets: exact up to 31, then sixteen buckets to each power of two, so a quantile is off by a sixteenth
at most. Sketches merge by adding counts, which Spark does before it shuffles; groups too small to
tell borrow the merged sketch of their language, or of everything. A document passes a rule unless its
measure lies far above the group's lower half: median + ``SPREADS`` times the larger of (median - 10th percentile)
and the rule's least spread. Only the lower half is used, so up to half of a group may be junk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, col, keep, words_of

#: Rule and the least spread of its measure (see ``measures``).
RULES = {"symbols": 30, "upper": 60, "bangs": 40, "repeats": 40, "lines": 60, "length": 15}
SPREADS = 4
#: Rows a group needs for thresholds of its own.
LEAST_ROWS = 50
WINDOW = 5


def _windows_repeated(words: Column, n: Column) -> Column:
    """Words in windows of five that occur twice or more in the text; ``words`` has ``n`` >= 5 entries.

    Windows are sorted by their words, neighbours that agree give the places, and a pass over the places
    in order adds up what they cover: n log n in the text's own length, no shuffle.
    """
    wins = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("g"), i.alias("p")))
    last = n - WINDOW
    return F.aggregate(
        F.array(F.array_sort(wins)),
        F.lit(0).cast("long"),
        lambda acc, s: F.aggregate(
            F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["g"] == s[k]["g"])) | ((k < last) & (s[F.least(k + 1, last)]["g"] == s[k]["g"]))), lambda k: s[k]["p"])),
            F.struct(F.lit(0).alias("end"), acc.alias("n")),
            lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).cast("long").alias("n")),
            lambda a: a["n"],
        ),
    )


def text_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bangs.

    All over the whole text; a null text counts as empty. Existing columns of these names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]
    rest = [c for c in df.columns if c not in made and c != text_col]
    text = F.coalesce(col(text_col), F.lit(""))
    one = df.select(*[col(c) for c in rest], text.alias("__t"), words_of(col(text_col)).alias("__w"), F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("__l"))
    hashes = F.when(F.size("__w") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)]))
    )
    two = one.withColumn("__h", hashes)
    # Equal windows have equal hashes: where all hashes differ nothing repeats, else the words themselves decide.
    repeats = F.when(F.size(F.array_distinct("__h")) == F.size("__h"), F.lit(0).cast("long")).otherwise(_windows_repeated(F.col("__w"), F.size("__w")))

    def count_of(chars: str) -> Column:
        return F.length("__t") - F.length(F.regexp_replace("__t", chars, ""))

    return two.select(
        *[col(c) for c in rest],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__t", SPACE, "")).cast("long").alias("word_chars"),
        count_of(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        count_of(r"\p{Lu}+").cast("long").alias("n_upper"),
        count_of(r"[!?]+").cast("long").alias("n_bangs"),
    )


def measures() -> dict[str, Column]:
    """Each rule's measure: whole numbers, mostly parts in a thousand."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "symbols": F.floor(F.col("n_symbols") * 1000 / words).cast("long"),
        "upper": F.floor(F.col("n_upper") * 1000 / chars).cast("long"),
        "bangs": F.floor(F.col("n_bangs") * 1000 / words).cast("long"),
        "repeats": F.floor(F.col("n_repeat_words") * 1000 / words).cast("long"),
        "lines": F.floor(F.col("n_dup_lines") * 1000 / lines).cast("long"),
        "length": F.floor(F.col("word_chars") * 10 / words).cast("long"),
    }


def bucket(v: Column) -> Column:
    """The sketch's bucket of a whole number >= 0, ascending with it."""
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return (shift * 16 + F.floor(v / F.pow(F.lit(2.0), shift))).cast("long")


def bucket_value(b: Column) -> Column:
    """The least number of a bucket."""
    shift = F.greatest(F.floor(b / 16) - 1, F.lit(0))
    return ((b - shift * 16) * F.pow(F.lit(2.0), shift)).cast("long")


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the groups' mergeable sketches."""
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.col(f"__m_{r}")).alias("bucket")) for r in RULES])
    return stats.select("lang", "source", F.explode(rules).alias("r")).groupBy("lang", "source", "r.rule", "r.bucket").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """(group, rule, rows, q10, q50) of merged sketches. Windows run over at most a thousand buckets a group."""
    merged = sketch.groupBy(*group, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group, "rule")
    merged = merged.withColumn("below", F.sum("n").over(w.orderBy("bucket"))).withColumn("rows", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("below") * 100 >= F.col("rows") * q, F.col("bucket")))
    return merged.groupBy(*group, "rule").agg(F.first("rows").alias("rows"), bucket_value(at(10)).alias("q10"), bucket_value(at(50)).alias("q50"))


def thresholds(sketch: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, max_<rule>...): one row per group; nulls are groups too."""
    own, lang, every = _quantiles(sketch, ["lang", "source"]), _quantiles(sketch, ["lang"]), _quantiles(sketch, [])
    lang = lang.select(F.col("lang").alias("l"), F.col("rule").alias("lr"), F.col("rows").alias("lrows"), F.col("q10").alias("l10"), F.col("q50").alias("l50"))
    every = every.select(F.col("rule").alias("er"), F.col("q10").alias("e10"), F.col("q50").alias("e50"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rule") == F.col("lr"))).join(F.broadcast(every), F.col("rule") == F.col("er"))  # one row a rule
    pick = lambda q: F.when(F.col("rows") >= least_rows, F.col(f"q{q}")).when(F.col("lrows") >= least_rows, F.col(f"l{q}")).otherwise(F.col(f"e{q}"))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), F.col("rule"))
    limit = pick(50) + SPREADS * F.greatest(pick(50) - pick(10), least)
    return both.select("lang", "source", "rule", limit.alias("limit")).groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, F.col("limit"))).alias(f"max_{r}") for r in RULES])


def apply_rules(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_rows: int = LEAST_ROWS) -> DataFrame:
    """Every row with its counts, base_failed, failed_rules and kept; the text column is left out.

    base_failed: under ten words, or more than a fifth of the words in repeated windows. kept: not base_failed and
    within its group's threshold for every rule. Null languages and sources form groups of their own; null
    and empty texts fail the base; repeated rows are judged alike and each counts; an empty table gives
    no rows. Other columns stay as they are, but for those of the outputs' names, which are replaced (names that begin
    with __m_ or __max_ are ours). The thresholds join by size: broadcast while small, else a shuffle that splits hot groups.
    """
    renamed = df.withColumns({"lang": col(lang_col), "source": col(source_col)})
    stats = text_counts(renamed, text_col)
    stats = keep(stats.withColumns({f"__m_{r}": m for r, m in measures().items()}), "rules-stats")
    limits = thresholds(keep(sketches(stats), "rules-sketch"), least_rows).withColumnsRenamed({"lang": "__lang", "source": "__source", **{f"max_{r}": f"__max_{r}" for r in RULES}})
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")))
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    failed = F.array_compact(F.array(*[F.when(F.col(f"__m_{r}") > F.col(f"__max_{r}"), F.lit(r)) for r in RULES]))
    judged = joined.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return judged.drop("__lang", "__source", *[f"__m_{r}" for r in RULES], *[f"__max_{r}" for r in RULES])
