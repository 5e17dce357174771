"""Taxonomic assignment of matched words and roll-up along the tree.

paths: file_num, level, tax_id (one row a level; 0 is unknown). Trees are edge tables (tax_id, parent_id). Ancestors come
from a closure table, so totals are one join and one aggregation, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases as B
from .storage import stored
from .sums import running

ROOT = 1
#: Hits that a task takes.
PART = 1 << 16


def filled(paths: DataFrame) -> DataFrame:
    """Unknown ranks take the rank above."""
    w = Window.partitionBy("file_num").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("tax_id") != 0, F.col("tax_id")), ignorenulls=True).over(w)
    return paths.select("file_num", "level", F.coalesce(last, F.lit(0)).alias("tax_id"))


def distinct_files(hits: DataFrame, paths: DataFrame, level: int = 2) -> DataFrame:
    """interval and its distinct files: the first (of least position) always, others only if known at `level`."""
    known = paths.filter(F.col("level") == level).select("file_num", (F.col("tax_id") >= 0).alias("known"))
    # Hits are short and compress well, so parts are told by rows; those of an interval stay together in all that follows.
    held = hits.select("interval", "file_num", "position").join(known, "file_num", "left").repartition(hits.count() // PART + 1, "interval")
    first = held.groupBy("interval").agg(F.min_by("file_num", "position").alias("first"))
    return held.join(first, "interval").filter(F.col("known") | (F.col("file_num") == F.col("first"))).select("interval", "file_num").distinct()


def shared_taxa(files: DataFrame, paths: DataFrame) -> DataFrame:
    """interval, level, tax_id where all its files agree (-1 doesn't count), down to the first level where they don't.

    An interval of one file agrees at every level but the highest.
    """
    # Whether there is one taxon, or file, is told by the least and the largest: no set of them is held.
    known = F.when(F.col("tax_id") != -1, F.col("tax_id"))
    each = files.join(paths, "file_num").groupBy("interval", "level").agg(F.coalesce(F.min(known) == F.max(known), F.lit(False)).alias("one"), F.max("tax_id").alias("tax_id"))
    size = files.groupBy("interval").agg((F.min("file_num") != F.max("file_num")).alias("many"))
    split = each.filter("not one").groupBy("interval").agg(F.min("level").alias("stop"))
    rows = each.filter("one").join(size, "interval").join(split, "interval", "left")
    kept = F.when(F.col("many"), F.col("stop").isNull() | (F.col("level") < F.col("stop"))).when(~F.col("many"), F.col("level") > 0)
    return rows.filter(kept).select("interval", "level", "tax_id")


def lowest_common(files: DataFrame, paths: DataFrame) -> DataFrame:
    """interval, lca: the taxon of the deepest level at which all its files agree; files unknown at level 0 don't count;
    ROOT where none is left or nothing agrees."""
    named = filled(paths).join(paths.filter("level = 0 and tax_id = 0").select("file_num"), "file_num", "left_anti")
    agree = files.join(named, "file_num").groupBy("interval", "level").agg(F.min("tax_id").alias("lo"), F.max("tax_id").alias("hi")).filter("lo = hi and lo not in (0, -1)")
    deepest = agree.groupBy("interval").agg(F.max_by("lo", "level").alias("lca"))
    return files.select("interval").distinct().join(deepest, "interval", "left").select("interval", F.coalesce("lca", F.lit(ROOT)).alias("lca"))


def weighted_counts(intervals: DataFrame, lca: DataFrame, least: int, most: int) -> DataFrame:
    """tax_id, n: the weighted numbers of matches (interval, tag, length, num_a) by their lowest common taxon."""
    w = B.weight(F.col("tag"), F.col("length"), least, most)
    return intervals.join(lca, "interval").groupBy(F.col("lca").alias("tax_id")).agg(F.sum(F.col("num_a") * w).cast("bigint").alias("n"))


def closure(nodes: DataFrame, most: int = 64) -> DataFrame:
    """tax_id, ancestor, distance; every node is its own ancestor. One join a level, on ever fewer rows."""
    up = stored(nodes.filter("tax_id != parent_id").select("tax_id", "parent_id"))
    now = stored(nodes.select("tax_id", F.col("tax_id").alias("ancestor"), F.lit(0).alias("distance")).distinct())
    out = now
    for d in range(1, most):
        now = stored(now.join(up.select(F.col("tax_id").alias("ancestor"), F.col("parent_id").alias("next")), "ancestor").select("tax_id", F.col("next").alias("ancestor"), F.lit(d).alias("distance")))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out


def rolled_up(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """tax_id, n, with_children for every node with anything at or below it."""
    below = counts.join(closure(nodes), "tax_id").groupBy(F.col("ancestor").alias("tax_id")).agg(F.sum("n").alias("with_children"))
    return below.join(counts, "tax_id", "left").select("tax_id", F.coalesce("n", F.lit(0)).alias("n"), "with_children")


def tree_rows(rolled: DataFrame, nodes: DataFrame) -> DataFrame:
    """TaxId, TaxLevel, Count, CountIncludingChildren and path (the order of a depth-first walk)."""
    up = closure(nodes)
    steps = up.groupBy("tax_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False), lambda s: F.lpad(s["ancestor"].cast("string"), 12, "0")), "/").alias("path"), F.max("distance").alias("depth"))
    return rolled.filter("with_children > 0").join(steps, "tax_id").select(F.col("tax_id").alias("TaxId"), F.col("depth").alias("TaxLevel"), F.col("n").alias("Count"), F.col("with_children").alias("CountIncludingChildren"), "path")


def taken(asked: DataFrame, held: DataFrame) -> DataFrame:
    """tax_id, other, got: what each taxon gets of what it asks (ask) of another one that holds n, in the order of tax_id.

    All that is asked so far is given as far as it goes, so a share is the difference of two capped running sums.
    """
    rows = running(asked, "other", "tax_id", "ask").join(held.select(F.col("tax_id").alias("other"), "n"), "other")
    return rows.select("tax_id", "other", (F.least("n", F.col("before") + F.col("ask")) - F.least("n", "before")).alias("got"))


def moved_to_leaves(counts: DataFrame, database: DataFrame) -> DataFrame:
    """tax_id, n: counts moved to the leaves from the taxa that the database finds with them, in its proportions.

    Leaves (taxa that the database finds with themselves) take their turn by rising tax_id; each asks other taxa for
    floor(db * n / own) and gets what is left there. counts: tax_id, n (each taxon once); database: tax_id, other, db.

    What a leaf asks depends on its count at its turn, that is on leaves of smaller numbers which ask it; what it gets, on
    what is asked of the same taxon before, and on what that taxon has got itself if its turn has been. Only leaves that
    stand above others have either, so the rounds below are as many as such leaves stand above each other, not as there are
    taxa; within a round all taxa are worked on side by side.
    """
    n = stored(counts.select("tax_id", "n"))
    own = database.filter("tax_id = other and db != 0").select("tax_id", F.col("db").alias("own")).join(n.select("tax_id"), "tax_id", "left_semi")
    others = n.select(F.col("tax_id").alias("other"))
    pairs = stored(database.filter("tax_id != other").join(own, "tax_id").join(others, "other", "left_semi").select("tax_id", "other", "db", "own"))
    leaves = own.select("tax_id")
    asks = lambda turn: pairs.join(turn, "tax_id").select("tax_id", "other", F.floor(F.col("db") * (F.col("n") / F.col("own"))).cast("bigint").alias("ask"))
    # Counts at the turns: a leaf waits for the leaves of smaller numbers that ask it.
    waits = stored(pairs.filter("tax_id < other").join(leaves.withColumnRenamed("tax_id", "other"), "other", "left_semi").select("tax_id", "other"))
    turn = stored(n.join(leaves, "tax_id", "left_semi").join(waits.select(F.col("other").alias("tax_id")), "tax_id", "left_anti"))
    while True:
        left = waits.join(turn.select(F.col("tax_id").alias("other")), "other", "left_anti")
        if left.isEmpty():
            break
        blocked = left.join(turn.select("tax_id"), "tax_id", "left_anti").select("other")
        ready = left.select("other").distinct().join(blocked, "other", "left_anti")
        asked = asks(turn).join(ready, "other", "left_semi").filter("tax_id < other").groupBy("other").agg(F.sum("ask").alias("asked"))
        now = asked.join(n.withColumnRenamed("tax_id", "other"), "other").select(F.col("other").alias("tax_id"), (F.col("n") - F.least("n", "asked")).alias("n"))
        turn = stored(turn.unionByName(now))
    asked = stored(asks(turn).join(leaves.select(F.col("tax_id").alias("other"), F.lit(True).alias("leaf")), "other", "left"))
    # What taxa without a turn, or before theirs, are asked comes off their first counts; the rest off what they have got by then.
    early = F.col("leaf").isNull() | (F.col("tax_id") < F.col("other"))
    got = stored(taken(asked.filter(early), n))
    late = stored(asked.filter(~early))
    done = stored(turn.select("tax_id").join(late.select("tax_id"), "tax_id", "left_anti"))
    while True:
        left = late.join(done, "tax_id", "left_anti")
        if left.isEmpty():
            break
        blocked = left.join(done.select(F.col("tax_id").alias("other")), "other", "left_anti").select("tax_id")
        ready = left.select("tax_id").distinct().join(blocked, "tax_id", "left_anti")
        grown = turn.join(got.groupBy("tax_id").agg(F.sum("got").alias("gain")), "tax_id", "left").select("tax_id", (F.col("n") + F.coalesce("gain", F.lit(0))).alias("n"))
        # Shares of taxa asked by others that are not ready yet are worked out again when those are.
        now = taken(late.join(done.unionByName(ready), "tax_id", "left_semi"), grown).join(ready, "tax_id", "left_semi")
        got, done = stored(got.unionByName(now)), stored(done.unionByName(ready))
    gains = got.groupBy("tax_id").agg(F.sum("got").alias("gain"))
    losses = got.groupBy(F.col("other").alias("tax_id")).agg(F.sum("got").alias("loss"))
    return n.join(gains, "tax_id", "left").join(losses, "tax_id", "left").select("tax_id", (F.col("n") + F.coalesce("gain", F.lit(0)) - F.coalesce("loss", F.lit(0))).cast("bigint").alias("n"))


def own_counts(database: DataFrame) -> DataFrame:
    return database.filter("tax_id = other").select("tax_id", F.col("db").alias("own"))


def pruned(counts: DataFrame, database: DataFrame) -> DataFrame:
    """Leaves that the database never finds count nothing."""
    return counts.join(own_counts(database), "tax_id", "left").select("tax_id", F.when(F.col("own") == 0, 0).otherwise(F.col("n")).alias("n"))


def scaled(counts: DataFrame, database: DataFrame, totals: DataFrame) -> DataFrame:
    """Leaves to a thousandth of their database total (tax_id, total); ancestors by the leaves' mean change."""
    rows = counts.join(own_counts(database), "tax_id", "left").join(totals, "tax_id", "left")
    leaf = F.col("own").isNotNull() & ((F.col("own") != 0) | (F.col("n") == 0))
    now = F.when(leaf, F.floor(F.col("n") * 1000 / F.col("total"))).alias("m")
    part = rows.select("tax_id", "n", now)
    sums = part.agg(F.coalesce(F.sum(F.when(F.col("m").isNotNull(), F.col("n"))), F.lit(0)).alias("before"), F.coalesce(F.sum("m"), F.lit(0)).alias("after"))
    return part.crossJoin(F.broadcast(sums)).select("tax_id", F.coalesce("m", F.floor(F.col("n") * F.col("after") / F.greatest(F.col("before"), F.lit(1)))).cast("bigint").alias("n"))


def percentages(counts: DataFrame) -> DataFrame:
    """Taxa with their whole percentage of everything classified."""
    total = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("tax_id", "n", F.floor(100 * F.col("n") / F.col("all")).cast("bigint").alias("percent")).orderBy(F.desc("n"), "tax_id")


def lineage(nodes: DataFrame, names: dict[str, int] | None = None) -> DataFrame:
    """tax_id, level, ancestor: the ancestor at each known rank (nodes have rank)."""
    ranks = nodes.select(F.col("tax_id").alias("ancestor"), B.rank_level(F.col("rank")).alias("level")).filter(F.col("level") != B.UNRANKED)
    return closure(nodes).join(ranks, "ancestor").groupBy("tax_id", "level").agg(F.min_by("ancestor", "distance").alias("ancestor"))


def named(headers: DataFrame, by_number: DataFrame, by_name: DataFrame) -> DataFrame:
    """file_num, tax_id: by number (gi), else by name without regard to case, else 0."""
    first = headers.join(by_number, "gi", "left")
    other = by_name.select(F.lower("name").alias("key"), F.col("tax_id").alias("by_name")).groupBy("key").agg(F.min("by_name").alias("by_name"))
    return first.join(other, F.lower("name") == F.col("key"), "left").select("file_num", F.coalesce("tax_id", "by_name", F.lit(0)).alias("tax_id"))


def used(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Nodes above used leaves, and how many leaves each has."""
    return leaves.join(closure(nodes), "tax_id").groupBy(F.col("ancestor").alias("tax_id")).agg(F.count("*").alias("magnitude"))


def by_word_size(lines: DataFrame, genome_length: DataFrame) -> DataFrame:
    """size, tax_id, n: reads over the mean genome length, of the first line for each size and position."""
    first = lines.groupBy("size", "position").agg(F.min_by(F.struct("tax_id", "reads"), "line").alias("x"))
    rows = first.select("size", "x.tax_id", "x.reads").join(genome_length, "tax_id", "left")
    return rows.groupBy("size", "tax_id").agg(F.sum(F.col("reads") / F.coalesce("length", F.lit(1.0))).alias("n"))


def coverage(hits: DataFrame) -> DataFrame:
    """file_num, position, size, n: of several words at a place the longest counts."""
    return hits.groupBy("file_num", "position").agg(F.max_by(F.struct("size", "n"), F.struct("size", "n")).alias("x")).select("file_num", "position", "x.size", "x.n")


def parents(paths: DataFrame) -> DataFrame:
    """tax_id, level, parent: the nearest known rank above, two levels further up at most."""
    w = Window.partitionBy("file_num").orderBy("level")
    known = lambda k: F.when(F.lag("tax_id", k).over(w) != 0, F.lag("tax_id", k).over(w))
    return paths.withColumn("parent", F.coalesce(known(1), known(2), F.lit(0))).filter("tax_id != 0").select("tax_id", "level", "parent").distinct()


def escaped(text: Column) -> Column:
    """text as an attribute's value."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for plain, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(name))
    return out


def krona(tree: DataFrame, names: DataFrame, nodes: DataFrame, title: str = "taxa") -> DataFrame:
    """key and value: the elements of an HTML tree, in the order of key; the depth-first order of `tree_rows`.

    A node's end stands behind all keys that begin with its path, so that the nesting is the order and nothing is walked.
    tree: rows of tree_rows, names: tax_id and name, nodes: tax_id and rank. A taxon without a name has its number.
    """
    rows = tree.withColumnRenamed("TaxId", "tax_id").join(names.select("tax_id", "name"), "tax_id", "left").join(nodes.select("tax_id", "rank"), "tax_id", "left")
    number = F.col("tax_id").cast("string")
    rank = F.when(F.coalesce("rank", F.lit("no rank")) != "no rank", F.concat(F.lit("<rank><val>"), escaped(F.col("rank")), F.lit("</val></rank>"))).otherwise("")
    begin = F.concat(F.lit('<node name="'), escaped(F.coalesce("name", number)), F.lit('"><magnitude><val>'), F.col("CountIncludingChildren").cast("string"), F.lit("</val></magnitude>"), rank, F.lit("<taxid><val>"), number, F.lit("</val></taxid>"))
    both = rows.select(F.explode(F.array(F.struct(F.col("path").alias("key"), begin.alias("value")), F.struct(F.concat("path", F.lit("~")).alias("key"), F.lit("</node>").alias("value")))).alias("x")).select("x.*")
    edges = [("", f'<html><body><h1>{title}</h1><div><krona><attributes magnitude="magnitude"><attribute display="Magnitude">magnitude</attribute><attribute display="Rank">rank</attribute><attribute display="Taxon">taxid</attribute></attributes>'), ("~", "</krona></div></body></html>")]
    return both.unionByName(tree.sparkSession.createDataFrame(edges, "key string, value string"))


def write_krona(elements: DataFrame, path: str) -> None:
    """The elements as text files, in order within and between files."""
    elements.repartitionByRange("key").sortWithinPartitions("key").select("value").write.text(path)
