"""The order of all suffixes of a collection without their text.

A place (seq_id, pos) gets two numbers that pack its next letters, DIGITS each; one range-partitioned sort by them decides
most places. Where suffixes agree on all packed letters and go on, their order is that of the suffixes behind those letters,
whose places have ranks already: only tied places are looked at, each round doubles how far they are compared, and a place
never carries more than three numbers however long its read is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bases as B
from .storage import released, stored
from .suffixes import pile, ranked

#: Letters in a number of 63 bits, as digits of base 6: the end is 0 and the letters stand in their order.
DIGITS = 24
CODES = "".join(str(k) for k in range(1, len(B.ALPHABET)))


def packed(at: Column) -> Column:
    """The DIGITS letters of bases from a place (from 0) on, filled up with ends."""
    return F.conv(F.rpad(F.translate(F.col("bases").substr(at + 1, F.lit(DIGITS)), B.ALPHABET[1:], CODES), DIGITS, "0"), 6, 10).cast("bigint")


def places(reads: DataFrame, *carried: str) -> DataFrame:
    """seq_id, pos, ch (the letter before), first (the pile), x, y (packed letters) and left, how many letters there are."""
    rows = reads.select("seq_id", "bases", *carried, F.explode(F.sequence(F.lit(0), F.length("bases"))).alias("pos"))
    before = lambda c, none: F.when(F.col("pos") == 0, none).otherwise(F.col(c).substr(F.col("pos"), F.lit(1))).alias(c)
    return rows.select("seq_id", "pos", before("bases", F.lit("$")).alias("ch"), pile(F.col("bases").substr(F.col("pos") + 1, F.lit(1))).alias("pile"), packed(F.col("pos")).alias("x"), packed(F.col("pos") + DIGITS).alias("y"), (F.length("bases") - F.col("pos")).alias("left"), *[before(c, F.lit(None).cast("string")) for c in carried])


def transform(reads: DataFrame, *carried: str) -> DataFrame:
    """rank, pile, pile_pos, ch, seq_id, pos and the letters before of the columns carried, by (suffix, seq_id)."""
    placed = stored(ranked(places(reads, *carried), "x", "y", "seq_id", "pos"))
    same = placed.groupBy("x", "y").agg(F.min("rank").alias("class"), F.count("*").alias("n"), F.max("left").alias("most")).filter("n > 1")
    far = 2 * DIGITS
    # Suffixes that end within the packed letters are equal where those are: they stand by seq_id for good.
    tied = stored(placed.join(same.filter(F.col("most") >= far), ["x", "y"]).select("seq_id", "pos", "left", "class"))
    if not tied.isEmpty():
        decided = stored(placed.select("seq_id", "pos", "rank").join(tied.select("seq_id", "pos"), ["seq_id", "pos"], "left_anti"))
        # Of equal suffixes that are decided the first one's rank stands for all, so that what they follow ties as well.
        equal = placed.join(same.filter(F.col("most") < far), ["x", "y"], "left").select("seq_id", "pos", F.coalesce("class", "rank").alias("class"))
        classes = stored(equal.join(tied.select("seq_id", "pos"), ["seq_id", "pos"], "left_anti").unionByName(tied.select("seq_id", "pos", "class")))
        ends = None
        while True:
            onward = classes.select("seq_id", (F.col("pos") - far).alias("pos"), F.col("class").alias("next"))
            order = stored(ranked(tied.join(onward, ["seq_id", "pos"]), "class", "next", "seq_id", "pos"))
            begins = order.groupBy("class").agg(F.min("rank").alias("begin"))
            parts = order.groupBy("class", "next").agg(F.min("rank").alias("part"), F.count("*").alias("n"), F.max("left").alias("most"))
            moved = stored(order.join(begins, "class").join(parts.withColumnRenamed("most", "far"), ["class", "next"]).select("seq_id", "pos", "left", (F.col("class") + F.col("rank") - F.col("begin")).alias("rank"), (F.col("class") + F.col("part") - F.col("begin")).alias("class"), ((F.col("n") > 1) & (F.col("far") >= 2 * far)).alias("open")))
            done = moved.filter("not open").select("seq_id", "pos", "rank")
            ends = done if ends is None else ends.unionByName(done)
            old, far = (tied, classes, order), 2 * far
            tied = stored(moved.filter("open").select("seq_id", "pos", "left", "class"))
            if tied.isEmpty():
                break
            classes = stored(classes.join(moved.select("seq_id", "pos"), ["seq_id", "pos"], "left_anti").unionByName(moved.select("seq_id", "pos", "class")))
            for table in old:
                released(table)
        placed = placed.drop("rank").join(decided.unionByName(ends), ["seq_id", "pos"])
    first = placed.groupBy("pile").agg(F.min("rank").alias("__first"))  # six rows
    return placed.join(F.broadcast(first), "pile").select("rank", "pile", (F.col("rank") - F.col("__first")).alias("pile_pos"), "ch", "seq_id", "pos", *carried)
