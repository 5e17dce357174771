"""Merging transforms that are there already, by how their rows interleave: no suffix is compared and nothing sorted again.

The place of a suffix of A among the rows of B (its gap) is found from that of the suffix a letter shorter, by one rank
look-up in the index of B: what stands before it and follows the letter stands before it in the letter's pile. So the reads
of A are walked from their ends, all of them a letter a step, against the blocks of B. Rows of B then stand behind the rows
of A whose gaps they have reached, a running sum. Equal suffixes stand by seq_id, as in `suffixes.bwt`: the walk begins
with the order of the ids. More than two collections are merged one after another, the smaller one taken as A.

Either side may be empty. Ids must differ between the sides, since a row is told by (seq_id, pos). Reads without bases
(null) have no rows on either side. Equal reads stay apart by their ids. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes as S
from .storage import stored
from .sums import running

#: Steps of a walk between tables.
KEPT = 10


def beginnings(a: DataFrame, b: DataFrame) -> DataFrame:
    """seq_id of a, and gap: how many ids of b are smaller."""
    both = S.ranked(a.select("seq_id", F.lit(0).alias("side")).unionByName(b.select("seq_id", F.lit(1).alias("side"))), "seq_id", "side")
    own = S.ranked(both.filter("side = 0").select("seq_id", F.col("rank").alias("at")), "at")
    return own.select("seq_id", (F.col("at") - F.col("rank")).alias("gap"))


def gaps(reads: DataFrame, begin: DataFrame, index: DataFrame, piles: DataFrame, longest: int, per: int = S.BLOCK) -> DataFrame:
    """seq_id, pos and gap of every suffix of reads. index and piles: S.rank_index and S.smaller of the other transform.

    A step is one join with the blocks; reads that are done are put aside whenever the walk is written.
    """
    begins = F.create_map(*[F.lit(x) for row in piles.collect() for x in row])  # six rows
    now = reads.select("seq_id", "bases").join(begin, "seq_id").select("seq_id", "bases", "gap", F.array("gap").alias("gaps"))
    blocks = index.select(F.col("block").alias("b"), "letters", *[F.col(f"before_{S.NAMES[c]}").alias(f"x_{S.NAMES[c]}") for c in S.LETTERS])
    done = []
    for j in range(1, longest + 1):
        going = now.withColumn("c", F.when(F.length("bases") >= j, F.col("bases").substr(F.length("bases") - (j - 1), F.lit(1))))
        at = F.greatest(F.floor((F.col("gap") - 1) / per), F.lit(0))
        looked = going.withColumn("b", at).join(blocks, "b", "left")
        part = F.col("letters").substr(F.lit(1), (F.col("gap") - F.col("b") * per).cast("int"))
        inside = F.length(part) - F.length(F.replace(part, "c", F.lit("")))
        before = F.coalesce(*[F.when(F.col("c") == c, F.col(f"x_{S.NAMES[c]}")) for c in S.LETTERS])
        gap = F.element_at(begins, F.col("c")) + F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
        moved = looked.withColumn("gap", F.when(F.col("c").isNull(), F.col("gap")).otherwise(gap))
        now = moved.select("seq_id", "bases", "gap", F.when(F.col("c").isNull(), F.col("gaps")).otherwise(F.concat("gaps", F.array("gap"))).alias("gaps"))
        if j % KEPT == 0:
            written = stored(now)
            done.append(written.filter(F.length("bases") <= j))
            now = written.filter(F.length("bases") > j)
    for part in done:
        now = now.unionByName(part)
    each = now.select("seq_id", F.length("bases").alias("size"), F.posexplode("gaps").alias("n", "gap"))
    return each.select("seq_id", (F.col("size") - F.col("n")).alias("pos"), "gap")


def merged(reads: DataFrame, a: DataFrame, b: DataFrame, longest: int) -> DataFrame:
    """rank, side (0: a, 1: b), ch, seq_id, pos of the transform of both. a, b: transforms (rank, ch, seq_id, pos); reads: those of a."""
    whole = reads.filter("bases is not null")
    begin = beginnings(whole, b.filter("ch = '$'"))
    found = stored(gaps(whole, begin, stored(S.rank_index(b)), S.smaller(b), longest))
    mine = a.join(found, ["seq_id", "pos"]).select((F.col("rank") + F.col("gap")).alias("rank"), F.lit(0).alias("side"), "ch", "seq_id", "pos")
    # A row of b stands behind all rows of a whose gap is its rank or less.
    passed = found.groupBy(F.col("gap").alias("rank")).agg(F.count("*").alias("n"))
    rows = b.select("rank", "ch", "seq_id", "pos").join(passed, "rank", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "all": F.lit(0)})
    other = running(rows, "all", "rank", "n").select((F.col("rank") + F.col("before") + F.col("n")).alias("rank"), F.lit(1).alias("side"), "ch", "seq_id", "pos")
    return mine.unionByName(other)
