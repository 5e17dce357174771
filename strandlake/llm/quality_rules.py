"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with references of four
languages by Jensen-Shannon distance (base 2, so 0 to 1). The references are the sums of the same histograms over all
documents that name the language and pass
the base rules. The smallest distance over the references counts, so a missing or wrong language does
no harm. A document fails the base rules (too short, or too many repeated three-word windows) or is rejected where
either distance is beyond its threshold; each distance is judged only from a minimum number of characters or words on,
since short histograms are far from every reference by chance.

Null texts count as empty: no words, so the base rule fails them. A null or unknown lang adds to no reference. An empty
table gives an empty result; where no document names a language there is no reference, no distance and no rejection by
it. Repeated windows are found by hash and confirmed by their words, so their count is exact. Repeated rows give repeated results; columns other than doc_id, text and lang are ignored. Texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Languages with a reference, and function words of each.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "with"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "dans"),
}
LANGUAGES = tuple(sorted(COMMON_WORDS))
WORDS = tuple(sorted({w for ws in COMMON_WORDS.values() for w in ws}))
LONGEST = max(map(len, WORDS))
#: Character classes as Java patterns; what none of them takes is the class "other".
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": "[.,;:'\"?()-]", "mark": "[!#*$%&|<>@^~=+_/\\\\{}\\[\\]]"}
SPACE = r"\x20\x09-\x0D"

MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.295
MIN_CHARS = 300
MIN_WORDS = 120
POSITION_BITS = 24


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def length_of(text: Column, pattern: str) -> Column:
    """How many characters of a class there are, by taking out whole runs: cheaper for what comes in runs."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def measured(docs: DataFrame) -> DataFrame:
    """The base counts and both histograms of every document; each array is made once, in a projection of its own."""
    t = F.col("text")
    split = common.documents(docs, "doc_id", "text", "lang").select(
        "doc_id", "lang", "text", F.regexp_extract_all(t, F.lit(f"([^{SPACE}]+)"), F.lit(1)).alias("words"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines")
    )
    n = F.size("words")
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    counted = split.select(
        "doc_id",
        "lang",
        "words",
        n.cast("bigint").alias("n_words"),
        F.length(t).alias("chars"),
        count_of(t, "[#*$%&|<>]").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        *[(length_of(t, p) if k in ("lower", "space") else count_of(t, p)).alias(f"c_{k}") for k, p in CLASSES.items()],
        F.filter(F.transform(F.filter("words", lambda w: F.length(w) <= LONGEST), lambda w: F.array_position(F.array(*map(F.lit, WORDS)), F.lower(w)).cast("int")), lambda k: k > 0).alias("known"),
        # A window's place in the low bits below its hash; windows of more words than the bits hold take a pair instead.
        F.when(n < 1 << POSITION_BITS, F.sort_array(F.transform(starts, lambda i: F.shiftleft(window(i), POSITION_BITS).bitwiseOR(i)))).alias("packed"),
        F.when(n >= 1 << POSITION_BITS, F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("h"), i.alias("i"))))).alias("paired"),
    )
    key = lambda x: F.shiftrightunsigned(x, POSITION_BITS)
    twice = lambda c, k: F.filter(c, lambda x, j: (k(x) == k(F.get(c, j - 1))) | (k(x) == k(F.get(c, j + 1))))
    place = F.coalesce(
        F.transform(twice(F.col("packed"), key), lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")),
        F.transform(twice(F.col("paired"), lambda x: x["h"]), lambda x: x["i"]),
    )
    # Equal keys are candidates only; windows are the same where their words are. No word holds a space.
    whole = lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    candidates = counted.select("*", place.alias("place")).drop("packed", "paired")
    confirmed = candidates.select("*", F.sort_array(F.transform("place", lambda i: F.struct(whole(i).alias("w"), i.alias("i")))).alias("same")).drop("place", "words")
    placed = confirmed.select("*", F.sort_array(F.transform(twice(F.col("same"), lambda x: x["w"]), lambda x: x["i"])).alias("place")).drop("same")
    times = lambda k: F.size(F.filter("known", lambda x: x == k))
    # Every window covers three words, less what the next one covers again.
    covered = F.aggregate(F.transform("place", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("place", j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    classes = [F.col(f"c_{k}") for k in CLASSES]
    return placed.select(
        "doc_id",
        "lang",
        "n_words",
        (F.col("chars") - F.col("c_space")).cast("bigint").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        covered.cast("bigint").alias("n_repeat_words"),
        "chars",
        F.array(*classes, F.col("chars") - sum(classes[1:], classes[0])).alias("char_counts"),
        F.array(*map(times, range(1, len(WORDS) + 1)), F.col("n_words").cast("int") - F.size("known")).alias("word_counts"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def references(measures: DataFrame) -> DataFrame:
    """One row at most for each language in LANGUAGES, whatever the input: the summed histograms as shares."""
    sizes = {"char_counts": len(CLASSES) + 1, "word_counts": len(WORDS) + 1}
    sums = measures.filter(F.col("lang").isin(*LANGUAGES) & ~base_failed()).groupBy("lang").agg(*[F.sum(F.get(c, F.lit(i)).cast("bigint")).alias(f"{c}_{i}") for c, n in sizes.items() for i in range(n)])
    return sums.select("lang", *[shares(F.array(*[F.col(f"{c}_{i}").cast("double") for i in range(n)])).alias(c) for c, n in sizes.items()])


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def distance(p: Column, own: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of the array of shares `p`, whose entropy is `own`, from the fixed shares `q`."""
    fixed = -sum(x * math.log2(x) for x in q if x > 0)
    middle = entropy(F.zip_with(p, F.array(*map(F.lit, q)), lambda x, y: (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), middle - (own + fixed) / 2))


def judge(docs: DataFrame) -> DataFrame:
    """The base counts, both distances (null below the guards or without references), base_failed and kept.

    The references come to the driver: len(LANGUAGES) rows of fixed length, whatever the input.
    """
    measures = common.stored(measured(docs), "quality-rules")
    known = references(measures).collect()
    nearest = lambda c, enough: F.when(enough, F.least(*ds) if len(ds := [distance(F.col(c), F.col(f"{c}_entropy"), r[c]) for r in known if r[c]]) > 1 else ds[0] if ds else F.lit(None).cast("double"))
    kinds = ("char_counts", "word_counts")
    plain = [c for c in measures.columns if c not in kinds]
    shared = measures.select(*plain, *[shares(F.col(c).cast("array<double>")).alias(c) for c in kinds])
    out = shared.select(*plain, *kinds, *[entropy(F.col(c)).alias(f"{c}_entropy") for c in kinds]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        nearest("char_counts", F.col("chars") >= MIN_CHARS).alias("char_distance"), nearest("word_counts", F.col("n_words") >= MIN_WORDS).alias("word_distance"),
    )
    near = lambda c, most: F.coalesce(F.col(c) <= most, F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & near("char_distance", MAX_CHAR_DISTANCE) & near("word_distance", MAX_WORD_DISTANCE))
