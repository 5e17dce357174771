"""The suffix relation and what is read off its order: the Burrows-Wheeler transform and its companions.

A read of length L has the suffixes at 0..L; the transform is the letter before each suffix, `$` before a whole read, in
the order of (suffix, seq_id). The order is one range-partitioned sort: ranks are offsets of partitions plus places in
them, so neither a single task nor a window over all rows is needed, and equal suffixes spread over partitions by seq_id.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases as B
from . import packing as P
from .storage import stored, stored_in_passes
from .sums import running

LETTERS = tuple(B.ALPHABET)
NAMES = {"$": "end", "A": "a", "C": "c", "G": "g", "N": "n", "T": "t"}


def expand(reads: DataFrame, *carried: str) -> DataFrame:
    """seq_id, pos, suffix, ch (the letter before); `carried` are strings as long as bases: their letter before comes along."""
    p = F.posexplode(F.sequence(F.lit(0), F.length("bases"))).alias("pos", "p")
    rows = reads.select("seq_id", "bases", *carried, p)
    before = lambda c, none: F.when(F.col("pos") == 0, none).otherwise(F.col(c).substr(F.col("pos"), F.lit(1)))
    return rows.select("seq_id", "pos", F.col("bases").substr(F.col("pos") + 1, F.length("bases")).alias("suffix"), before("bases", F.lit("$")).alias("ch"), *[before(c, F.lit(None).cast("string")).alias(c) for c in carried])


def pile(suffix: Column) -> Column:
    return F.when(suffix == "", "$").otherwise(F.substring(suffix, 1, 1))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with rank, its place in the order of the given columns, from 0."""
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order))


def numbered(df: DataFrame) -> DataFrame:
    """df, whose partitions and rows stand in order, with rank."""
    placed = stored(df.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + place).alias("rank"))


#: Suffixes that a pass sorts, and the most passes: more of them would read the collection too often.
PASS, PASSES = 1 << 25, 32
COLUMNS = ("ch", "seq_id", "pos", "length", "lcp", "prev")
#: Bits of a read's number that are stored by themselves.
NUMBERED = 12


def passes(rows: DataFrame, size: int, most: int) -> list[tuple[int, int]]:
    """Suffixes by their first letters (codes from one to below the other) in parts of about so many, in order. What begins with the
    same P.HEAD letters stays together."""
    found = rows.select("bases").mapInArrow(P.head_counts, "head bigint, n bigint").groupBy("head").agg(F.sum("n").alias("n")).toArrow()  # P.HEADS rows at most
    counts = np.zeros(P.HEADS, np.int64)
    counts[found["head"].to_numpy()] = found["n"].to_numpy()
    ends = np.cumsum(counts)
    parts = max(1, min(most, -(-int(ends[-1]) // size)))
    cuts = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts) + 1
    cuts = sorted({0, *cuts.tolist(), P.HEADS})
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def bwt(reads: DataFrame, *carried: str, sap: bool = False, longest: int | None = None, columns: Sequence[str] = COLUMNS, size: int = PASS, most: int = PASSES) -> DataFrame:
    """rank, pile, pile_pos, ch, seq_id, pos, length (of the suffix), lcp (letters shared with the suffix a rank before), prev (the
    letter there, null at rank 0). With `sap`, equal suffixes stand by letter before seq_id; `longest` leaves longer suffixes out.
    `columns`: which of those from ch on are made.

    The text of suffixes is there in the sort's keys only (see `packing`). Keys of about `size` suffixes are shuffled at a time, as
    their first letters say, in `most` passes over the reads at most; what is kept of them is a few bytes a suffix. Neighbours are
    compared where a partition is written; only the first row of a partition is compared with the last one before it afterwards.
    """
    rows = reads.filter("bases is not null").select("seq_id", "bases", *carried)
    more = [f"c{k}" for k in range(len(carried))]
    kinds = {"pile": "string", "ch": "string", "seq_id": "bigint", "pos": "int", "length": "int", "lcp": "int", "prev": "string", "edge": "string"} | dict.fromkeys(more, "string")
    names = ["pile", *[c for c in COLUMNS if c in columns or (c == "ch" and "prev" in columns)], *["edge"] * ("lcp" in columns), *more]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    part = F.spark_partition_id().alias("part")
    # A read's number in two parts, which are stored as places in short lists of what there is.
    halves = [F.shiftright("seq_id", NUMBERED).cast("int").alias("high_id"), F.col("seq_id").bitwiseAND((1 << NUMBERED) - 1).cast("int").alias("low_id")]
    kept = [part, *[x for c in names for x in (halves if c == "seq_id" else [F.col(c)])]]

    def ordered(heads: tuple[int, int]) -> DataFrame:
        keys = rows.mapInArrow(lambda batches: P.packed(batches, sap, longest, heads), "key binary").repartitionByRange("key").sortWithinPartitions("key")
        return keys.mapInArrow(lambda batches: P.unpacked(batches, len(more), sap, names), schema).select(*kept)

    placed = stored_in_passes([ordered(heads) for heads in passes(rows, size, most)])
    # A row stands at its place in the partition's file.
    placed = placed.select("*", F.col("_metadata.row_index").alias("__at"))
    # A row for each partition and pile, and windows over these.
    at = Window.orderBy("pass", "part", "pile")
    none = at.rowsBetween(Window.unboundedPreceding, -1)
    first, last = (lambda c: F.min_by(c, "__at")), (lambda c: F.max_by(c, "__at"))
    ends = ([first("edge").alias("low"), last("edge").alias("high")] if "lcp" in names else []) + ([last("ch").alias("letter")] if "prev" in names else [])
    each = placed.groupBy("pass", "part", "pile").agg(F.count("*").alias("n"), *ends)
    beyond = ([F.lag("high").over(at).alias("suffix")] if "lcp" in names else []) + ([F.lag("letter").over(at).alias("__prev")] if "prev" in names else [])
    each = each.select("*", F.coalesce(F.sum("n").over(none), F.lit(0)).alias("ahead"), *beyond)
    each = each.withColumns({"__before": F.min("ahead").over(Window.partitionBy("pass", "part")), "__first": F.min("ahead").over(Window.partitionBy("pile"))})
    if "lcp" in names:
        longer = F.least(F.length("low"), F.length("suffix"))
        shared = F.aggregate(F.sequence(F.lit(1), F.greatest(longer, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= longer) & (F.col("low").substr(i, F.lit(1)) == F.col("suffix").substr(i, F.lit(1))), i).otherwise(n))
        each = each.withColumn("__lcp", F.coalesce(shared, F.lit(0)))
    each = stored(each.select("pass", "part", "pile", "__before", "__first", *[c for c in ("__lcp", "__prev") if c in each.columns]).coalesce(1))
    rank = F.col("__before") + F.col("__at")
    both = placed.join(F.broadcast(each), ["pass", "part", "pile"])
    made = {"seq_id": F.shiftleft(F.col("high_id").cast("bigint"), NUMBERED) + F.col("low_id")} | {c: F.coalesce(c, f"__{c}") for c in ("lcp", "prev") if c in names}
    return both.select(rank.alias("rank"), "pile", (rank - F.col("__first")).alias("pile_pos"), *[made.get(c, F.col(c)).alias(c) for c in COLUMNS if c in columns], *[F.col(c).alias(name) for c, name in zip(more, carried, strict=True)])


def with_reverse_complements(reads: DataFrame) -> DataFrame:
    """The reads and, behind them, their reverse complements: seq_id goes on from the largest."""
    step = reads.agg((F.max("seq_id") + 1).alias("step"))
    turned = reads.crossJoin(F.broadcast(step)).select((F.col("seq_id") + F.col("step")).alias("seq_id"), B.reverse_complement(F.col("bases")).alias("bases"))
    return reads.select("seq_id", "bases").unionByName(turned)


def reversed_reads(reads: DataFrame) -> DataFrame:
    return reads.select("seq_id", F.reverse("bases").alias("bases"))


def sub_sequences(reads: DataFrame, n: int) -> DataFrame:
    """Every read in two: its last n letters, then (numbered on) the rest in front of them."""
    step = reads.agg((F.max("seq_id") + 1).alias("step"))
    front = reads.crossJoin(F.broadcast(step)).select((F.col("seq_id") + F.col("step")).alias("seq_id"), F.col("bases").substr(F.lit(1), F.length("bases") - n).alias("bases"))
    return reads.select("seq_id", F.col("bases").substr(F.greatest(F.length("bases") - n + 1, F.lit(1)), F.lit(n)).alias("bases")).unionByName(front)


def letter_counts(by: str = "pile", letter: str = "ch", amount: Column | None = None) -> list[Column]:
    one = F.lit(1) if amount is None else amount
    return [F.sum(F.when(F.col(letter) == c, one).otherwise(0)).cast("bigint").alias(f"n_{NAMES[c]}") for c in LETTERS]


def pile_counts(table: DataFrame) -> DataFrame:
    """Letters of each pile, and of all piles before it."""
    sums = table.groupBy("pile").agg(*letter_counts())  # six rows
    before = Window.orderBy("pile").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("pile", *[f"n_{NAMES[c]}" for c in LETTERS], *[F.coalesce(F.sum(f"n_{NAMES[c]}").over(before), F.lit(0)).alias(f"c_{NAMES[c]}") for c in LETTERS])


#: Letters of a block of the transform, for rank look-ups.
BLOCK = 4096


def blocks(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """block and letters, those of `block` ranks on end; rows go through the shuffle as text, a byte a letter."""
    texts = table.select("rank", "ch").mapInArrow(lambda batches: P.texts(batches, block, False), "block bigint, at int, text string, n bigint")
    return texts.groupBy("block").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "text"))).getField("text"), "").alias("letters"))


def by_letter(packed: DataFrame) -> DataFrame:
    """ch, block, n and before: how often a letter stands in a block of `blocks`, and in all blocks before it; all letters for each block."""
    n = lambda c: (F.length("letters") - F.length(F.replace("letters", F.lit(c), F.lit("")))).cast("bigint")
    each = packed.select("block", F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), n(c).alias("n")) for c in LETTERS])).alias("x")).select("x.ch", "block", "x.n")
    return running(each, "ch", "block", "n")


def smaller(table: DataFrame) -> DataFrame:
    """ch and smaller, the number of letters below it: where its pile begins. Six rows."""
    return piles_of(table.groupBy("ch").agg(F.count("*").alias("n")))


def piles_of(counts: DataFrame) -> DataFrame:
    """`smaller` of the letters' numbers (ch, n)."""
    below = [F.coalesce(F.sum(F.when(F.lit(c) > F.col("ch"), F.col("n"))), F.lit(0)) for c in LETTERS]
    return counts.agg(F.array(*[F.struct(F.lit(c).alias("ch"), x.alias("smaller")) for c, x in zip(LETTERS, below, strict=True)]).alias("x")).select(F.explode("x").alias("x")).select("x.ch", "x.smaller")


def lf(table: DataFrame) -> DataFrame:
    """rank, occ (how often its letter stands before) and lf, where the suffix one longer stands.

    lf is the number of letters that are smaller, plus occ. Occurrences before a block of ranks are running sums, the rest
    is counted in the block's text; no row of the table is shuffled by itself.
    """
    index = stored(rank_index(table))
    n = [(F.length("letters") - F.length(F.replace("letters", F.lit(c), F.lit("")))).cast("bigint") for c in LETTERS]
    counts = index.select(F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), x.alias("n")) for c, x in zip(LETTERS, n, strict=True)])).alias("x")).groupBy("x.ch").agg(F.sum("x.n").alias("n"))
    begins = piles_of(counts).agg(F.sort_array(F.collect_list(F.struct("ch", "smaller"))).getField("smaller").alias("begins"))  # one row
    rows = index.repartition("block").crossJoin(F.broadcast(begins)).select("block", "letters", "begins", *[f"before_{NAMES[c]}" for c in LETTERS])
    return rows.mapInArrow(lambda batches: P.followed(batches, BLOCK), "rank bigint, ch string, occ bigint, lf bigint")


def rank_index(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """The transform as an index for rank look-ups: block, letters (of BLOCK ranks on end) and how often each letter stands
    before the block (before_a, ...)."""
    rows = stored(blocks(table, block))
    ahead = by_letter(rows).groupBy("block").agg(*[F.max(F.when(F.col("ch") == c, F.col("before"))).alias(f"before_{NAMES[c]}") for c in LETTERS])
    return rows.join(ahead, "block")


def inverted(table: DataFrame, longest: int) -> DataFrame:
    """The reads of a transform (rank, ch): number (from 0, in input order) and bases.

    Pointer doubling: every row holds the string that `step` LF moves collect and where they lead; a round joins the table
    with itself, so a read of length L takes log2(L) joins. `$` leads nowhere.
    """
    steps = lf(table)
    walk = stored(steps.select("rank", F.when(F.col("ch") == "$", F.lit(None)).otherwise(F.col("lf")).alias("to"), F.when(F.col("ch") == "$", "").otherwise(F.col("ch")).alias("text")))
    done = 1
    while done < longest + 1:
        nxt = walk.select(F.col("rank").alias("to"), F.col("to").alias("to2"), F.col("text").alias("text2"))
        walk = stored(walk.join(nxt, "to", "left").select("rank", F.col("to2").alias("to"), F.concat(F.coalesce("text2", F.lit("")), "text").alias("text")))
        done *= 2
    ends = table.filter("ch = '$'").agg(F.count("*").alias("n"))
    return walk.join(F.broadcast(ends), F.col("rank") < F.col("n")).select(F.col("rank").alias("number"), F.col("text").alias("bases"))


def forward_index(table: DataFrame, longest: int) -> DataFrame:
    """rank, number (of the read, its place in the `$` pile) and to_end (letters from the suffix to the read's end).

    The inverse of LF leads from a suffix to the one a letter shorter, in the end to one of no letters. Pointers double, so
    reads of length L take log2(L) rounds of three whole numbers a row; rows that have arrived are in no more rounds.
    """
    size = table.filter("ch = '$'").agg(F.count("*").alias("ends"))
    steps = lf(table).filter("ch != '$'").select(F.col("lf").alias("rank"), F.col("rank").alias("number"))
    walk = stored(steps.crossJoin(F.broadcast(size)).select("rank", "number", F.lit(1).alias("to_end"), (F.col("number") < F.col("ends")).alias("there")))
    arrived, going, done = [walk.filter("there")], walk.filter("not there"), 1
    while done < longest:
        # After a round that doubles, both sides hold steps of one length, or what is left to the end.
        further = walk.select(F.col("rank").alias("number"), F.col("number").alias("number2"), F.col("to_end").alias("to_end2"), F.col("there").alias("there2"))
        moved = stored(going.drop("there").join(further, "number").select("rank", F.col("number2").alias("number"), (F.col("to_end") + F.col("to_end2")).alias("to_end"), F.col("there2").alias("there")))
        arrived.append(moved.filter("there"))
        going = moved.filter("not there")
        walk = functools.reduce(DataFrame.unionByName, [*arrived, going])
        done *= 2
    ends = table.select("rank").crossJoin(F.broadcast(size)).filter("rank < ends")
    return functools.reduce(DataFrame.unionByName, arrived).select("rank", "number", "to_end").unionByName(ends.select("rank", F.col("rank").alias("number"), F.lit(0).alias("to_end")))


def end_positions(reads: DataFrame, groups: int = 1) -> DataFrame:
    """For the k-th `$` of the transform (dollar_num) its read, and the read's group and place in it.

    A `$` stands before each whole read and nowhere else, so these are the reads in the order of (bases, seq_id): no other
    suffix is sorted. Reads are dealt into groups in turn: read s is number s div groups of group s mod groups.
    """
    order = ("bases", "seq_id")
    rows = reads.filter("bases is not null").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return numbered(rows.select("seq_id")).select(F.col("rank").alias("dollar_num"), "seq_id", F.pmod("seq_id", F.lit(groups)).alias("group_num"), F.floor(F.col("seq_id") / groups).alias("pos_in_group"))


def runs(table: DataFrame) -> DataFrame:
    """Maximal runs of equal letters: first rank, ch, run.

    A run begins where the letter a rank before (prev, where the table has it) is another. Such letters are shuffled as
    texts of BLOCK ranks; the runs before a block and the one behind it come of a row for each block.
    """
    before = table.select((F.col("rank") + 1).alias("rank"), F.col("ch").alias("prev"))
    rows = table.select("rank", "ch", "prev") if "prev" in table.columns else table.select("rank", "ch").join(before, "rank", "left")
    heads = rows.filter("prev is null or prev != ch").select("rank", "ch")
    texts = heads.mapInArrow(lambda batches: P.texts(batches, BLOCK, True), "block bigint, at int, text string, n bigint")
    held = stored(texts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("pieces"), F.sum("n").alias("n"), (F.col("block") * BLOCK + F.min("at")).alias("first")))
    total = table.agg((F.max("rank") + 1).alias("end"))
    each = held.select(F.lit(0).alias("all"), "block", "n", "first")
    placed = stored(ranked(running(each, "all", "block", "n"), "block"))
    after = placed.select((F.col("rank") - 1).alias("rank"), F.col("first").alias("next"))
    spans = placed.join(after, "rank", "left").crossJoin(F.broadcast(total)).select("block", "before", F.coalesce("next", "end").alias("next"))
    found = held.select("block", "pieces").join(spans, "block").repartition("block").select("block", "pieces", "before", "next")
    return found.mapInArrow(lambda batches: P.run_rows(batches, BLOCK), "run_no bigint, first_rank bigint, ch string, run bigint")


def expanded(run_table: DataFrame) -> DataFrame:
    """The letters of runs: rank, ch."""
    return run_table.select(F.explode(F.sequence("first_rank", F.col("first_rank") + F.col("run") - 1)).alias("rank"), "ch")


def block_index(run_table: DataFrame, per: int = 2048) -> DataFrame:
    """Letters of each block of `per` runs and of all blocks before it: one row a block."""
    blocks = run_table.groupBy(F.floor(F.col("run_no") / per).alias("block")).agg(F.min("first_rank").alias("first_rank"), *letter_counts(amount=F.col("run")))
    each = blocks.select("block", "first_rank", F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(f"n_{NAMES[c]}").alias("n")) for c in LETTERS])).alias("x")).select("block", "first_rank", "x.ch", "x.n")
    return running(each, "ch", "block", "n").groupBy("block", "first_rank").agg(*[F.max(F.when(F.col("ch") == c, F.col("before"))).alias(f"before_{NAMES[c]}") for c in LETTERS])


def witness_blocks(lcps: DataFrame, witness: int, least: int) -> DataFrame:
    """Maximal blocks of suffixes that share `witness` letters, of more than `least` rows, with their letters ($ is 0).

    A block begins where the common prefix is shorter. Letters are differences of occurrence counts at both ends.
    """
    heads = ranked(lcps.filter(F.col("lcp") < witness).select(F.col("rank").alias("first")), "first").select("rank", "first")
    after = heads.select((F.col("rank") - 1).alias("rank"), F.col("first").alias("next"))
    total = lcps.agg((F.max("rank") + 1).alias("end"))
    spans = heads.join(after, "rank", "left").crossJoin(F.broadcast(total)).select("first", F.coalesce("next", "end").alias("next")).filter(F.col("next") - F.col("first") > least)
    seen = occurrences(lcps)
    at = lambda name: seen.select(F.col("rank").alias(name), *[F.col(f"n_{NAMES[c]}").alias(f"{name}_{NAMES[c]}") for c in LETTERS[1:]])
    both = spans.withColumn("last", F.col("next") - 1).join(at("first"), "first").join(at("last"), "last").join(lcps.select(F.col("rank").alias("first"), F.col("ch").alias("c0")), "first")
    difference = [(F.col(f"last_{NAMES[c]}") - F.col(f"first_{NAMES[c]}") + (F.col("c0") == c).cast("bigint")).alias(f"n_{NAMES[c]}") for c in LETTERS[1:]]
    return both.select(F.col("first").alias("first_rank"), (F.col("next") - F.col("first")).alias("size"), F.lit(0).cast("bigint").alias("n_end"), *difference)


def occurrences(table: DataFrame) -> DataFrame:
    """rank and, for each letter, how often it stands at ranks up to this one (one row for each of table)."""
    rows = table.select("rank", "ch", F.floor(F.col("rank") / BLOCK).alias("block"))
    ahead = by_letter(stored(blocks(table))).groupBy("block").agg(*[F.max(F.when(F.col("ch") == c, F.col("before"))).alias(f"b_{NAMES[c]}") for c in LETTERS])
    w = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("rank", "block", *[F.sum((F.col("ch") == c).cast("bigint")).over(w).alias(f"i_{NAMES[c]}") for c in LETTERS])
    return inside.join(ahead, "block").select("rank", *[(F.col(f"b_{NAMES[c]}") + F.col(f"i_{NAMES[c]}")).alias(f"n_{NAMES[c]}") for c in LETTERS])


def genome_order(letters: DataFrame) -> DataFrame:
    """pos and rank of every suffix of one long string, given letter by letter (pos from 0, ch): prefix doubling.

    A round orders places by the ranks of themselves and of the place `step` further on; equal pairs share a rank. Text
    is never longer than a letter, whatever the genome, and a round is one join and one range-partitioned sort.
    """
    # The first ranks are those of the letters: a handful of rows.
    kinds = letters.select("ch").distinct().withColumn("key", F.dense_rank().over(Window.orderBy("ch")).cast("bigint"))
    now = stored(letters.join(F.broadcast(kinds), "ch").select("pos", "key"))
    step = 1
    while True:
        after = now.select((F.col("pos") - step).alias("pos"), F.col("key").alias("next"))
        pairs = now.join(after, "pos", "left").select("pos", "key", F.coalesce("next", F.lit(-1)).alias("next"))
        placed = stored(ranked(pairs, "key", "next", "pos"))
        first = placed.groupBy("key", "next").agg(F.min("rank").alias("first"))
        now = stored(placed.join(first, ["key", "next"]).select("pos", F.col("first").alias("key")))
        if first.count() == placed.count():
            return now.select("pos", F.col("key").alias("rank"))
        step *= 2


def genome_transform(letters: DataFrame) -> DataFrame:
    """rank, pos (the suffix array) and ch (the letter before, `$` at the start) of one long string."""
    before = letters.select((F.col("pos") + 1).alias("pos"), F.col("ch").alias("b"))
    return genome_order(letters).join(before, "pos", "left").select("rank", "pos", F.coalesce("b", F.lit("$")).alias("ch"))
