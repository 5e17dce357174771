"""Spelling variants: words one edit apart, grouped under their frequent form.

Words are cut into positional bigrams, and all bigrams are put into one global order, the rarest first. One inserted,
deleted or replaced letter touches at most two bigrams of either word, and the order of those left whole is the same in
both. So the first whole one is among the three rarest of each, at the same place or one further on: only the three
rarest bigrams of a word are joined, with that limit on places (and on lengths). Of the pairs that share such a bigram
those can't be one edit apart that agree neither in their first nor in their second half, so the half is part of the join
key, and long inverted lists fall apart into short ones. Every pair that is left is verified.

Nulls: a null text has no words; a document without a number takes part like any other (and gets no planted deletions);
null words are left out. Empty texts have no words and empty tables no result; a very long text is one array of words in
one task, a very long word one array of bigrams. Repeated rows are counted again. Among equally frequent near words the
smallest in code-point order is the form; forms are at least ten times as frequent as the word, so there are no cycles.
Columns other than doc_id and text are never read. Joins of words are merge joins by hint: Spark would judge their tables by
the size of compressed files, and send tables of many times that size through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = "[^A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST, FACTOR = 7, 2, 10
#: Bigrams that two edited ones leave among them at least once.
RAREST = 3
PLANTED = 31


def runs(docs: DataFrame) -> DataFrame:
    """doc_id and run: every maximal run of letters, A-Z in lower case, as often as it occurs."""
    pieces = F.split(F.translate("text", UPPER, LOWER), OTHER)
    return docs.select("doc_id", F.explode(pieces).alias("run")).filter("run != ''")


def with_deletions(found: DataFrame) -> DataFrame:
    """Runs of which one in PLANTED has lost a letter, by the hash of doc_id and run."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.col("run").substr(at + 2, F.length("run")))
    return found.withColumn("h", h).select("doc_id", F.when(F.col("h") % PLANTED == 0, cut).otherwise(F.col("run")).alias("run"))


def counted(found: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST) -> DataFrame:
    """word and n, how often it occurs: words of enough letters that occur often enough."""
    return found.filter(F.length("run") >= letters).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def rare_bigrams(words: DataFrame) -> DataFrame:
    """word, n and rare: its RAREST rarest bigrams (g, p), by the number of their places in all words."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("p")).withColumn("g", F.expr("substring(word, p, 2)"))
    # Pairs of the 90 letters that words are made of: at most 8,100 rows.
    often = F.broadcast(at.groupBy("g").agg(F.count("*").alias("c")))
    each = at.join(often, "g").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("c", "g", "p"))).alias("all"))
    return each.select("word", "n", F.slice("all", 1, RAREST).alias("rare"))


def keys(each: DataFrame, length: Column, shifts: tuple[int, ...]) -> DataFrame:
    """k, word, n: a key for each rare bigram, each place it may have in the shorter word, and each half of that word's length."""
    half = F.floor(F.col("short") / 2).cast("int")
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("word").substr(F.lit(1), half).alias("part")), F.struct(F.lit(2).alias("side"), F.expr("right(word, cast(short - floor(short / 2) as int))").alias("part")))
    rows = each.select("word", "n", length.alias("short"), F.explode("rare").alias("r")).select("word", "n", "short", "r", F.explode(sides).alias("s"))
    at = F.explode(F.array(*[F.col("r.p") - d for d in shifts])).alias("p")
    return rows.select("word", "n", "short", "r", "s", at).select(F.xxhash64("r.g", "p", "short", "s.side", "s.part").alias("k"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: all pairs of words exactly one edit apart, each once (a is the shorter one, or the smaller)."""
    each = common.stored(rare_bigrams(words), "rare")
    size = F.length("word")
    shorter = keys(each, size, (0,)).select("k", F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = keys(each, size, (0,)).withColumn("same", F.lit(True)).unionByName(keys(each, size - 1, (0, 1)).withColumn("same", F.lit(False)))
    other = other.select("k", "same", F.col("word").alias("b"), F.col("n").alias("n_b"))
    one_edit = F.expr("(not same or a < b) and length(b) - length(a) = if(same, 0, 1) and levenshtein(a, b, 1) = 1")
    return shorter.join(other.hint("merge"), "k").filter(one_edit).select("a", "b", "n_a", "n_b").distinct()


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (word, n; each word once, of two letters at least)."""
    words = common.stored(words.filter("word is not null").select("word", "n"), "words")
    pairs = common.stored(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("form")).alias("x")).unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("minus"), F.col("a").alias("form")).alias("x")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("x").alias("x"))
    far = -F.col("x.minus") >= factor * F.col("n")
    joined = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(far, F.col("x.form")).alias("form"), F.when(far, -F.col("x.minus")).alias("form_n"))
    joined = common.stored(joined, "forms")
    # Counts grow by `factor` from form to form, so a way has at most log(largest count) steps; a round doubles its reach.
    largest = max(words.agg(F.max("n")).first()[0] or 1, 1)
    steps = math.floor(math.log(largest, factor)) + 1 if factor > 1 else 1
    way = joined.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        way = common.stored(way.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return joined.join(way.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
