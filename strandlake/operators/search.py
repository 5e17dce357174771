"""Searching words in reads, locating them, and taking out the records that hold them.

An occurrence is a row of the suffix relation, so search, locate and extract are joins. Reads give only words of the
lengths that are searched for; the word list may be of any size, since Spark joins it as its size suggests.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packing as P
from . import suffixes as S
from .storage import stored

#: Ranks of a bin of the range join; steps of a search between tables; words that may be sent to all tasks (of a read's length at most).
BIN, KEPT, SENT = 64, 6, 100_000


def words(reads: DataFrame, *lengths: int) -> DataFrame:
    """word, seq_id, pos, prev (letter before, `$` at the start) for every place and length."""
    k = F.explode(F.array(*map(F.lit, lengths))).alias("k")
    sized = reads.select("seq_id", "bases", k).filter(F.col("k") <= F.length("bases"))
    rows = sized.select("seq_id", "bases", "k", F.explode(F.sequence(F.lit(0), F.length("bases") - F.col("k"))).alias("pos"))
    return rows.select(F.col("bases").substr(F.col("pos") + 1, F.col("k")).alias("word"), "seq_id", "pos", F.when(F.col("pos") == 0, "$").otherwise(F.col("bases").substr(F.col("pos"), F.lit(1))).alias("prev"))


def lengths_of(kmers: DataFrame) -> list[int]:
    """The distinct word lengths: at most as many as a read is long."""
    return sorted(r[0] for r in kmers.select(F.length("kmer")).distinct().collect() if r[0])


def marked(kmers: DataFrame) -> np.ndarray:
    """A filter of the words: a bit for each ending of P.FILTERED letters, 2 MB whatever the list."""
    rows = kmers.select("kmer").distinct().mapInArrow(P.marks, "at bigint, bit bigint")
    found = rows.groupBy("at").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").cast("int"))).alias("bits")).toArrow()
    out = np.zeros((4**P.FILTERED) >> 6, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out


def told(kmers: DataFrame, lengths: list[int]) -> bool:
    """Whether the filter alone tells the words: all of one length, with a bit for each, and of the letters that have codes."""
    return len(lengths) == 1 and lengths[0] <= P.FILTERED and kmers.filter(F.col("kmer").rlike("[^ACGT]")).isEmpty()


def places(reads: DataFrame, lengths: list[int], bits: np.ndarray, only: bool, *carried: str) -> DataFrame:
    rows = reads.select("seq_id", "bases", *[F.col(c).alias(f"c{k}") for k, c in enumerate(carried)])
    kinds = ["word string", f"seq_id {rows.dtypes[0][1]}", "pos int", *[f"c{k} {rows.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(carried))]]
    found = rows.mapInArrow(lambda batches: P.places_of(batches, lengths, bits, only), ", ".join(kinds))
    return found.select("word", "seq_id", "pos", *[F.col(f"c{k}").alias(c) for k, c in enumerate(carried)])


def occurrences(reads: DataFrame, kmers: DataFrame) -> DataFrame:
    """kmer, seq_id, pos: a row for each place. Where the words' filter doesn't tell them, what it lets through is joined with the words."""
    lengths, bits = lengths_of(kmers), marked(kmers)
    if told(kmers, lengths):
        return places(reads, lengths, bits, True).withColumnRenamed("word", "kmer")
    found = places(reads, lengths, bits, False)
    return found.join(kmers.select(F.col("kmer").alias("word")).distinct(), "word").select(F.col("word").alias("kmer"), "seq_id", "pos")


def tagged(reads: DataFrame, kmers: DataFrame) -> DataFrame:
    """`extracted_with_tags` of the words' places: seq_id, name (with the word behind it), bases.

    Rows are as many as places, which grow with the letters and with the words. Where the filter tells the words, they are
    made where the reads stand, and none is shuffled.
    """
    lengths = lengths_of(kmers)
    if not told(kmers, lengths):
        return extracted_with_tags(reads, occurrences(reads, kmers).withColumnRenamed("kmer", "tag"))
    rows = places(reads.withColumn("text", F.col("bases")), lengths, marked(kmers), True, "name", "text")
    return rows.select("seq_id", F.concat_ws(" ", "name", "word").alias("name"), F.col("text").alias("bases"))


def seeds(index: DataFrame, piles: DataFrame, letters: int = 6, per: int = S.BLOCK) -> DataFrame:
    """tail, low and high: the intervals of all words of so many letters that are there (at most 5 ** letters), to begin a search with."""
    at = [F.substring(F.lit("".join(S.LETTERS[1:])), (F.floor(F.col("id") / 5**k) % 5 + 1).cast("int"), F.lit(1)) for k in range(letters)]
    tails = index.sparkSession.range(5**letters).select(F.concat(*at).alias("kmer"))
    return ranges(index, piles, tails, [letters], per).select(F.col("kmer").alias("tail"), "low", "high")


def intervals(index: DataFrame, piles: DataFrame, kmers: DataFrame, per: int = S.BLOCK, known: DataFrame | None = None) -> DataFrame:
    """kmer, position (of its first suffix in the pile of its first letter) and count; 0 0 where it is absent.

    Backward search: the places of a word's suffixes are an interval of ranks, and a letter more in front leads from both
    of its ends to those of the longer word, by the number of such letters before them. index: S.rank_index of the
    transform, piles: S.smaller. A step looks up two blocks for each word that is still there, so neither suffixes nor reads
    are looked at. Rows of kmers that repeat are kept.
    """
    words = stored(kmers.select("kmer").filter("kmer != ''").distinct())
    begin = F.element_at("begins", F.substring("kmer", 1, 1))
    found = ranges(index, piles, words, lengths_of(words), per, known).select("kmer", (F.col("low") - begin).alias("position"), (F.col("high") - F.col("low")).alias("count"))
    return kmers.join(found, "kmer", "left").select("kmer", F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("count", F.lit(0)).alias("count"))


def ranges(index: DataFrame, piles: DataFrame, words: DataFrame, lengths: list[int], per: int, known: DataFrame | None = None) -> DataFrame:
    """kmer, begins (of the piles), low and high of the words that are there. known: `seeds`, used where every word is long enough."""
    # Few words go to the blocks, whatever the joins' estimates say; many are joined as Spark sees fit.
    sent = F.broadcast if words.count() <= SENT else lambda df: df
    one = piles.agg(F.map_from_entries(F.collect_list(F.struct("ch", "smaller"))).alias("begins"), F.max("smaller").alias("most"))  # one row
    total = index.agg(F.sum(F.length("letters")).alias("total"))
    now = words.select("kmer").crossJoin(F.broadcast(one)).crossJoin(F.broadcast(total)).select("kmer", "begins", F.lit(0).cast("bigint").alias("low"), F.col("total").alias("high"))
    done = 0
    if known is not None and lengths:
        done = known.select(F.length("tail")).first()
        done = done[0] if done and done[0] <= lengths[0] else 0
    if done:
        tail = F.col("kmer").substr(F.length("kmer") - (done - 1), F.lit(done))
        now = known.join(sent(now.select("kmer", "begins", tail.alias("tail"))), "tail").select("kmer", "begins", "low", "high")
    for j in range(done + 1, max(lengths or [0]) + 1):
        letter = F.col("kmer").substr(F.length("kmer") - (j - 1), F.lit(1))
        going = now.withColumn("c", F.when(F.length("kmer") >= j, letter))
        for end in ("low", "high"):
            blocks = index.select(F.col("block").alias("b"), "letters", *[F.col(f"before_{S.NAMES[c]}").alias(f"x_{S.NAMES[c]}") for c in S.LETTERS])
            # The place behind the last letter may be the first of a block that isn't there: it belongs to the block before.
            at = F.greatest(F.floor((F.col(end) - 1) / per), F.lit(0))
            part = F.col("letters").substr(F.lit(1), (F.col(end) - at * per).cast("int"))
            inside = F.length("part") - F.length(F.replace("part", "c", F.lit("")))
            before = F.coalesce(*[F.when(F.col("c") == c, F.col(f"x_{S.NAMES[c]}")) for c in S.LETTERS])
            looked = blocks.join(sent(going.withColumn("b", at)), "b").withColumn("part", part)
            moved = F.when(F.col("c").isNotNull(), F.element_at("begins", F.col("c")) + before + inside).otherwise(F.col(end))
            going = looked.withColumn(end, moved).select("kmer", "begins", "low", "high", "c")
        now = going.filter("low < high").drop("c")
        if j % KEPT == 0:
            now = stored(now)
    return now


def in_search_order(found: DataFrame) -> DataFrame:
    """Search results stand by the reversed word."""
    return found.orderBy(F.reverse("kmer"), "kmer")


def located(table: DataFrame, found: DataFrame) -> DataFrame:
    """For every place of every interval its read: kmer, position (in the pile), seq_id, pos.

    A range join: intervals are cut at the edges of bins of the pile, and a bin's part is compared with its rows.
    """
    first, last = F.floor(F.col("position") / BIN), F.floor((F.col("position") + F.col("count") - 1) / BIN)
    spans = found.filter("count > 0").distinct().select("kmer", F.substring("kmer", 1, 1).alias("pile"), "position", (F.col("position") + F.col("count")).alias("end"), F.explode(F.sequence(first, last)).alias("bin"))
    rows = table.select("pile", F.col("pile_pos").alias("at"), F.floor(F.col("pile_pos") / BIN).alias("bin"), "seq_id", "pos")
    return spans.join(rows, ["pile", "bin"]).filter("at >= position and at < end").select("kmer", F.col("at").alias("position"), "seq_id", "pos")


def located_forward(index: DataFrame, piles: DataFrame, found: DataFrame) -> DataFrame:
    """For every place of every interval its read, without end positions: kmer, position, number (of the read), to_end.

    index: S.forward_index, piles: S.smaller. The range join of `located`, on ranks.
    """
    low = F.col("smaller") + F.col("position")
    ranks = found.filter("count > 0").distinct().withColumn("ch", F.substring("kmer", 1, 1)).join(F.broadcast(piles), "ch").select("kmer", "smaller", low.alias("low"), (low + F.col("count")).alias("high"))
    spans = ranks.select("*", F.explode(F.sequence(F.floor(F.col("low") / BIN), F.floor((F.col("high") - 1) / BIN))).alias("bin"))
    rows = index.withColumn("bin", F.floor(F.col("rank") / BIN))
    return spans.join(rows, "bin").filter("rank >= low and rank < high").select("kmer", (F.col("rank") - F.col("smaller")).alias("position"), "number", "to_end")


def extracted(reads: DataFrame, ids: DataFrame) -> DataFrame:
    return reads.join(ids.select("seq_id").distinct(), "seq_id", "left_semi")


def extracted_with_tags(reads: DataFrame, tagged: DataFrame) -> DataFrame:
    """A row for each read and tag, the tag behind the name."""
    return reads.join(tagged.select("seq_id", "tag"), "seq_id").select("seq_id", F.concat_ws(" ", "name", "tag").alias("name"), "bases")


def with_mates(ids: DataFrame, half: int | Column) -> DataFrame:
    """ids and those of their mates, half a collection further on or back."""
    other = F.when(F.col("seq_id") < half, F.col("seq_id") + half).otherwise(F.col("seq_id") - half)
    return ids.select("seq_id").unionByName(ids.select(other.alias("seq_id"))).distinct()


def indexed_search(reads: DataFrame, table: DataFrame, found: DataFrame, repeat: int = 100) -> DataFrame:
    """Records of the reads that hold a word with fewer than `repeat` places; each record once. found: intervals."""
    few = found.distinct().filter((F.col("count") > 0) & (F.col("count") < repeat))
    return extracted(reads, located(table, few))


def reverse_sorted(reads: DataFrame) -> DataFrame:
    """Reads numbered in the order of their reversed bases, as an indexed collection may hold them."""
    return S.ranked(reads.withColumn("key", F.reverse("bases")), "key", "seq_id").select(F.col("rank").alias("number"), "seq_id", "bases")


def lines_at(reads: DataFrame, numbers: DataFrame) -> DataFrame:
    """Records by number: a pruned look-up of the rows asked for."""
    return reads.join(numbers.select("seq_id").distinct(), "seq_id", "left_semi")
