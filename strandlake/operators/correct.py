"""Detecting and correcting errors in reads.

A word (witness) with one frequent letter before it marks the rarer letters there as errors. An error is a place in a
read, (seq_id, pos), so errors of all witness lengths are grouped by it without following intervals through an index.
Lengths are taken from the shortest on: a longer witness has some of the places of each of its beginnings, so it can mark
nothing unless these have a frequent letter and a second one, and only such places are looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases as B
from . import compare, search
from .storage import stored


def log_binomial(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


@dataclass(frozen=True)
class Expectations:
    """Expected numbers for a genome, reads and an error rate per base, after the HiTEC paper."""

    reads: int
    length: int
    genome: float
    rate: float

    def destructible(self, w: int) -> float:
        """Reads that a witness of w letters could spoil."""
        one = (1 - (1 - self.rate) ** w) * (1 - self.rate) * 0.75 * -math.expm1(self.genome * math.log1p(-(0.25**w)))
        return self.reads * (1 - self.rate) ** self.length * (1 - (1 - one) ** (self.length - w))

    def erroneous(self) -> float:
        return self.reads * (1 - (1 - self.rate) ** self.length)

    def specific_length(self, most: float = 1e-4) -> int:
        """The least witness length that spoils less than a share of the erroneous reads."""
        return next((w for w in range(1, self.length + 1) if self.destructible(w) < most * self.erroneous()), self.length)

    def pairs(self, support: int, w: int, right: bool) -> float:
        """Witness and neighbour pairs that are right (or wrong) and have this support."""
        q = (self.length - w) * (1 - self.rate) ** w * ((1 - self.rate) if right else self.rate / 3) / self.genome
        if not 0 < q < 1:
            return 0.0
        return math.exp(log_binomial(self.reads, support) + support * math.log(q) + (self.reads - support) * math.log1p(-q)) * self.genome

    def support(self, w: int) -> int:
        """The least support at which right pairs outnumber wrong ones, and two more."""
        s = 1
        while s < self.reads and self.pairs(s, w, True) < self.pairs(s, w, False):
            s += 1
        return s + 2


def suspicious(contexts: DataFrame, support: int) -> DataFrame:
    """Words before which exactly one letter has the support and another letter stands more rarely; `correct` is the first."""
    strong = sum(((compare.a(c) >= support).cast("int") for c in "CGNT"), (compare.a("A") >= support).cast("int"))
    weak = compare.any_of([(compare.a(c) > 0) & (compare.a(c) < support) for c in "ACGNT"])
    return contexts.filter((strong == 1) & weak).withColumn("correct", F.coalesce(*[F.when(compare.a(c) >= support, c) for c in "ACGNT"]))


def witnesses(reads: DataFrame, least: int, most: int, support: int, step: int = 8) -> DataFrame:
    """k, word, seq_id, pos, prev, correct: the places, but at starts of reads, of the suspicious words of least to most letters.

    After the first length `step` lengths are counted at once.
    """
    live = stored(search.words(reads, least).filter("pos > 0").join(reads.select("seq_id", "bases"), "seq_id").select("seq_id", "pos", "prev", "bases"))
    found, k = None, least
    while k <= most:
        last = k if k == least else min(k + step - 1, most)
        sized = live.select("*", F.explode(F.sequence(F.lit(k), F.lit(last))).alias("k")).filter(F.col("pos") + F.col("k") <= F.length("bases"))
        rows = sized.withColumn("word", F.col("bases").substr(F.col("pos") + 1, F.col("k"))).filter(~F.col("word").contains("N"))
        letters = sum(((compare.a(c) > 0).cast("int") for c in "CGNT"), (compare.a("A") > 0).cast("int"))
        open_ = compare.any_of([compare.a(c) >= support for c in "ACGNT"]) & (letters > 1)
        counts = stored(compare.counted(rows, "a").filter(open_))
        now = stored(rows.join(suspicious(counts, support).select("word", "correct"), "word").select("k", "word", "seq_id", "pos", "prev", "correct"))
        found = now if found is None else found.unionByName(now)
        live = stored(rows.filter(F.col("k") == last).join(counts.select("word"), "word", "left_semi").select("seq_id", "pos", "prev", "bases"))
        if live.isEmpty():
            break
        k = last + 1
    return found


def errors(marked: DataFrame) -> DataFrame:
    """seq_id, position (of the wrong letter), wrong, correct, shortest_witness, longest_witness, of the places of `witnesses`.

    The correct letter is that of the shortest witness.
    """
    rows = marked.filter(F.col("prev") != F.col("correct")).select("seq_id", (F.col("pos") - 1).alias("position"), F.col("prev").alias("wrong"), "correct", "k")
    return rows.groupBy("seq_id", "position", "wrong").agg(F.min_by("correct", "k").alias("correct"), F.min("k").alias("shortest_witness"), F.max("k").alias("longest_witness"))


def correctors(found: DataFrame, marked: DataFrame, reads: DataFrame, support: int, longest: int, step: int = 6) -> DataFrame:
    """found with `corrector`: the correct letter and what stands before it in other reads, letter by letter, as long as
    one has the support (of several the last of the alphabet), at most `longest` letters; leftmost letter last.

    The ways to the left from a witness are counted by their next `step` letters first, so what is walked in one group has
    at most 5 ** step rows, however often the witness stands.
    """
    bases = reads.select("seq_id", "bases")
    found = stored(found.join(bases, "seq_id").withColumn("word", F.col("bases").substr(F.col("position") + 2, F.col("shortest_witness"))).drop("bases"))
    back = F.reverse(F.col("bases").substr(F.lit(1), F.col("pos") - 1)).alias("back")
    right = marked.filter(F.col("prev") == F.col("correct")).join(found.select("word").distinct(), "word", "left_semi")
    ways = stored(right.join(bases, "seq_id").select("word", back).groupBy("word", "back").agg(F.count("*").alias("n")))
    same, parts = Window.partitionBy("word"), None
    for done in range(0, longest - 1, step):
        now = F.col("back").substr(done + 1, step)
        rows = ways.groupBy("word", now.alias("next")).agg(F.sum("n").alias("n")).select("*", F.lit("").alias("got"), F.lit(True).alias("open"))
        for j in range(1, min(step, longest - 1 - done) + 1):
            letter = F.col("next").substr(j, 1)
            frequent = [F.when(F.sum(F.when(letter == c, F.col("n"))).over(same) >= support, c) for c in "TNGCA"]
            rows = rows.withColumn("best", F.when(F.col("open"), F.coalesce(*frequent))).filter(F.col("best").isNull() | (letter == F.col("best")))
            rows = rows.withColumn("got", F.concat("got", F.coalesce("best", F.lit("")))).withColumn("open", F.col("best").isNotNull())
        here = stored(rows.groupBy("word").agg(F.max("got").alias("got"), F.bool_or("open").alias("open")))
        part = here.select("word", F.struct(F.lit(done).alias("done"), "got").alias("part"))
        parts = part if parts is None else parts.unionByName(part)
        ways = stored(ways.join(here.filter("open").select("word", "got"), "word").filter(now == F.col("got")).select("word", "back", "n"))
        if ways.isEmpty():
            break
    if parts is None:
        return found.drop("word").withColumn("corrector", F.col("correct"))
    paths = parts.groupBy("word").agg(F.array_join(F.sort_array(F.collect_list("part")).getField("got"), "").alias("path"))
    return found.join(paths, "word").withColumn("corrector", F.concat("correct", "path")).drop("word", "path")


def mapped_back(found: DataFrame, n: int | Column, length: int | Column) -> DataFrame:
    """Errors in reverse complements (seq_id of n or more) told of the reads themselves; corrector_start is added.
    length: of every read, or a column of found.

    A corrector is written from the error to the left: that of a forward read is turned round and begins to the left of
    the error, that of a reverse complement is complemented and begins at it.
    """
    turned = F.col("seq_id") >= n
    position = F.when(turned, length - 1 - F.col("position")).otherwise(F.col("position"))
    rows = found.withColumn("__turned", turned).withColumn("__position", position)
    return rows.select(
        F.when(F.col("__turned"), F.col("seq_id") - n).otherwise(F.col("seq_id")).alias("seq_id"),
        F.col("__position").cast("int").alias("position"),
        F.col("__turned").cast("int").alias("reverse_strand"),
        F.when(F.col("__turned"), F.translate("corrector", *B.COMPLEMENTS)).otherwise(F.reverse("corrector")).alias("corrector"),
        F.when(F.col("__turned"), F.col("__position")).otherwise(F.col("__position") - F.length("corrector") + 1).cast("int").alias("corrector_start"),
        "shortest_witness",
        "longest_witness",
    )


def in_file_order(found: DataFrame) -> DataFrame:
    return found.orderBy("seq_id", "position", "corrector_start", "corrector")


def stitched(reads: DataFrame, found: DataFrame) -> DataFrame:
    """Reads with their first correction put on: what stands before the corrector, then the corrector."""
    first = found.groupBy("seq_id").agg(F.min(F.struct("position", "corrector_start", "corrector")).alias("c"))
    both = reads.join(first, "seq_id", "left")
    return both.select("seq_id", F.when(F.col("c").isNull(), F.col("bases")).otherwise(F.concat(F.col("bases").substr(F.lit(1), F.greatest(F.col("c.corrector_start"), F.lit(0))), F.col("c.corrector"))).alias("bases"))


def overlaid(quality: str, least: int, trim: bool) -> Column:
    """bases and quals of a read (bases, quals, fixes) without insertions or deletions: a fold of its fixes.

    Fixes go by falling longest witness. The first is laid over its place in the read; the place of any other is where its
    witness first stands in what the read has become, and there is none if it doesn't. Fixes with a witness of less than
    `least` letters are left out. trim: a read keeps its length where a fix begins or ends beyond it.
    """
    ordered = F.array_sort(F.transform("fixes", lambda f: F.struct((-f["longest_witness"]).alias("order"), f["position"].alias("p"), f["corrector_start"].alias("start"), f["corrector"].alias("letters"), (f["reverse_strand"] == 1).alias("turned"), f["longest_witness"].alias("n"))))

    def laid(now: Column, fix: Column) -> Column:
        size, n = F.length(fix["letters"]), fix["n"]
        witness = F.when(fix["turned"], F.substr("bases", fix["p"] - n + 1, n)).otherwise(F.substr("bases", fix["p"] + 2, n))
        stands = F.call_function("instr", now["bases"], witness)
        error = F.when(now["first"], fix["p"]).when(fix["turned"], stands - 1 + n).otherwise(stands - 2)
        start = F.when(fix["turned"], error).otherwise(error - size + 1)
        skipped = (n < least) | ~now["first"] & (stands == 0)
        kept = F.greatest(start, F.lit(0))  # letters in front of the fix
        behind = F.greatest(start + size, F.lit(0)) + 1

        def over(text: Column, patch: Column) -> Column:
            whole = F.concat(F.substr(text, F.lit(1), kept), patch, F.substr(text, behind, F.length(text)))
            return F.substr(whole, F.greatest(-start, F.lit(0)) + 1, F.length("bases")) if trim else whole

        changed = F.struct(over(now["bases"], fix["letters"]).alias("bases"), over(now["quals"], F.call_function("repeat", F.lit(quality), size)).alias("quals"), F.lit(False).alias("first"))
        return F.when(skipped, F.struct(now["bases"].alias("bases"), now["quals"].alias("quals"), F.lit(False).alias("first"))).otherwise(changed)

    begin = F.struct(F.col("bases").alias("bases"), F.coalesce("quals", F.lit("")).alias("quals"), F.lit(True).alias("first"))
    return F.aggregate(ordered, begin, laid)


MATCH, OTHER, GAP = 2, -1, -1
LANES = 512


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as rows of code points, and their lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(sizes.max(initial=0))), -1, np.int64)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out, sizes


def alignment_starts(x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where in x and y the local alignment begins that ends at the last letter but one of either, for all pairs at once.

    The score table is filled by anti-diagonals, a step for all pairs. A cell keeps no move but the place at the table's
    edge where its way began, which it has from the cell it came from: none of better score counts before a gap in y, that
    before a gap in x, that before a pair of letters, where they score the same.
    """
    (a, n), (b, m) = coded(x), coded(y)
    rows, width = a.shape[0], a.shape[1] + 1
    lane = np.arange(rows)
    from_x, from_y = n - 1, m - 1  # pairs that end at an edge begin there
    blank = lambda: np.zeros((rows, width), np.int64)
    # Of a diagonal: score, and the edge place in x and in y, by the place in x.
    last, now = [blank() for _ in range(3)], [blank() for _ in range(3)]
    ended = n + m - 2
    for d in range(1, int(ended.max(initial=0)) + 1):
        before, last, now = last, now, [blank() for _ in range(3)]
        if d < width:
            now[1][:, d] = d
        now[2][:, 0] = d
        i = np.arange(max(1, d - b.shape[1]), min(width - 1, d - 1) + 1)
        if len(i):
            j = d - i
            pair = before[0][:, i - 1] + np.where(a[:, i - 1] == b[:, j - 1], MATCH, OTHER)
            scores = np.stack([np.zeros_like(pair), last[0][:, i - 1] + GAP, last[0][:, i] + GAP, pair])
            choice = scores.argmax(axis=0)  # the first of the best
            now[0][:, i] = scores.max(axis=0)
            for edge in (1, 2):
                diagonal = before[edge][:, i - 1]
                now[edge][:, i] = np.choose(choice, [diagonal, last[edge][:, i - 1], last[edge][:, i], diagonal])
        here = (ended == d) & (n > 1) & (m > 1)
        from_x = np.where(here, now[1][lane, n - 1], from_x)
        from_y = np.where(here, now[2][lane, n - 1], from_y)
    return from_x, from_y


def realigned(reads: list[str], fixes: list[list[dict]]) -> list[str]:
    """Reads with their correctors aligned to them, so that they may insert or delete letters; the k-th fix of all reads at once."""
    out = list(reads)
    for k in range(max(map(len, fixes), default=0)):
        jobs = []  # read, where its error stands, the fix
        for r, mine in enumerate(fixes):
            if k < len(mine):
                fix, n, p = mine[k], mine[k]["longest_witness"], mine[k]["position"]
                turned = bool(fix["reverse_strand"])
                stands = p - n if turned else p + 1
                if k:
                    stands = out[r].find(reads[r][max(stands, 0) : p if turned else stands + n])
                if not k or stands >= 0:
                    jobs.append((r, stands + n if turned else stands - 1, fix["corrector"], turned))
        for at in range(0, len(jobs), LANES):
            part = jobs[at : at + LANES]
            # A turned corrector is aligned to what follows the error, from the read's end on; any other to what leads up to it.
            x = [c[::-1] if turned else c for _, _, c, turned in part]
            y = [out[r][p:][::-1] if turned else out[r][: p + 1] for r, p, _, turned in part]
            used = [len(t) - s for t, s in zip(y, alignment_starts(x, y)[1].tolist(), strict=True)]
            for (r, p, c, turned), u in zip(part, used, strict=True):
                first, behind = (p, p + u) if turned else (max(p + 1 - u, 0), p + 1)
                out[r] = out[r][:first] + c + out[r][behind:]
    return out


def applied(reads: DataFrame, found: DataFrame, how: str = "no-indels", quality: str = "#", least: int = 0, trim: bool = False) -> DataFrame:
    """seq_id, bases, quals of all reads after correction; reads without errors pass through the left join."""
    if how == "stitch":
        return stitched(reads, found)
    fixes = F.sort_array(F.collect_list(F.struct("position", "corrector_start", "corrector", "reverse_strand", "longest_witness"))).alias("fixes")
    both = reads.select("seq_id", "bases", "quals").join(found.groupBy("seq_id").agg(fixes), "seq_id", "left")
    if how == "no-indels":
        done = both.withColumn("x", F.when(F.col("fixes").isNotNull(), overlaid(quality, least, trim)))
        return done.select("seq_id", F.coalesce("x.bases", "bases").alias("bases"), F.coalesce("x.quals", "quals").alias("quals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            bases, own = x.column("bases").to_pylist(), [f or [] for f in x.column("fixes").to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column("seq_id"), pa.array(realigned(bases, own), pa.string()), x.column("quals")], names=["seq_id", "bases", "quals"])

    return both.filter("bases is not null").mapInArrow(run, "seq_id bigint, bases string, quals string")


def records(corrected: DataFrame) -> DataFrame:
    """seq_id and record, the FASTA text of each corrected read: reads are named by their number."""
    return corrected.select("seq_id", F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\n"), F.col("bases")).alias("record"))
