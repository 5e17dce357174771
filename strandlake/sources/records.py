"""Line records of files of any size, read in splits.

Spark's text reader cuts a file at byte ranges and gives a range the lines that begin in it. A task puts the records
together whose lines it has all of: it finds the first line of a record by its mark (`>`; or `@` with `+` two lines on,
which no line of qualities has), and takes lines in step from there. A first pass leaves the number of lines of each range
and the lines in front of the first record and behind the last one, which are a few for each range. Running sums of those
numbers place every range in its file and every file in the whole, so records get their numbers, and the lines left over
are grouped by theirs. Lines are never sorted or shuffled, but for those.

Empty lines at a file's end are nothing; empty files give no record; a record that lacks lines has nulls there. Compressed
files have one range. A record that doesn't begin where its number says, after a wrong mark, is an error when it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import stored

#: Lines of a record, and its marks: line and first letter.
KINDS = {"fasta": (2, ((0, ">"),)), "fastq": (4, ((0, "@"), (2, "+"))), "seq": (1, ())}
SURVEY = "file string, at bigint, line bigint, value string, lines bigint, filled bigint"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (where its range begins) and value of every line, in order within a range."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def first_record(values: pa.Array, marks: tuple[tuple[int, str], ...]) -> int:
    """The first line that begins a record, or -1."""
    begins = np.ones(len(values), bool)
    for k, letter in marks:
        here = pc.starts_with(values, letter).to_numpy(zero_copy_only=False)
        begins &= np.r_[here[k:], np.zeros(min(k, len(here)), bool)]
    found = np.flatnonzero(begins)
    return int(found[0]) if len(found) else -1


def in_ranges(batches: Iterator[pa.RecordBatch], per: int, marks: tuple[tuple[int, str], ...]) -> Iterator[tuple[str, int, int, pa.Array, bool | None]]:
    """file, range, number of the first line within it, lines, and whether they are whole records; last of a range, with
    its number of lines, no lines and None."""
    now: tuple[str, int] | None = None
    held, first, in_step = pa.array([], pa.string()), 0, False  # lines not yet given out

    def given(last: bool) -> Iterator[tuple[str, int, int, pa.Array, bool | None]]:
        nonlocal held, first, in_step
        if not in_step:
            skip = first_record(held, marks)
            in_step = skip >= 0
            if skip > 0:
                yield *now, first, held[:skip], False
                held, first = held[skip:], first + skip
        whole = len(held) // per * per if in_step else 0
        if whole:
            yield *now, first, held[:whole], True
            held, first = held[whole:], first + whole
        if last:
            if len(held):
                yield *now, first, held, False
            yield *now, first + len(held), held[:0], None
            held, first, in_step = held[:0], 0, False

    for batch in batches:
        file, at = batch.column("file").to_pylist(), batch.column("at").to_numpy()
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | np.array([x != y for x, y in zip(file[1:], file[:-1], strict=True)], bool)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            key = file[a], int(at[a])
            if now is not None and key != now:
                yield from given(True)
            now = key
            held = pa.concat_arrays([held, batch.column("value")[a:b]])
            yield from given(False)
    if now is not None:
        yield from given(True)


def surveyed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """For each range a row with its lines and the last one that isn't empty (from 1), and a row for each line left over."""
    per, marks = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = 0
        for file, at, first, found, whole in in_ranges(batches, per, marks):
            said = np.flatnonzero(pc.binary_length(found).to_numpy(zero_copy_only=False)) if len(found) else []
            filled = first + int(said[-1]) + 1 if len(said) else filled
            n = 1 if whole is None else 0 if whole else len(found)
            line = np.arange(first, first + n)
            empty = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([at] * n, pa.int64()), empty if whole is None else pa.array(line, pa.int64()), pa.nulls(n, pa.string()) if n != len(found) or whole is None else found, pa.array([first], pa.int64()) if whole is None else empty, pa.array([filled], pa.int64()) if whole is None else empty], names=["file", "at", "line", "value", "lines", "filled"])
            filled = 0 if whole is None else filled

    return lines(spark, path).mapInArrow(run, SURVEY)


def wholes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """file, at, line (of its first one, within the range) and p0, p1, ... of the records that lie in one range."""
    per, marks = KINDS[kind]
    names = ["file", "at", "line", *[f"p{k}" for k in range(per)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, at, first, found, whole in in_ranges(batches, per, marks):
            if whole:
                n = len(found) // per
                place = np.arange(n) * per
                parts = [found.take(pa.array(place + k)) for k in range(per)]
                for k, letter in marks:
                    if not pc.all(pc.or_(pc.starts_with(parts[k], letter), pc.equal(parts[0], ""))).as_py():
                        raise ValueError(f"a record begins out of step in {file}")
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array(first + place, pa.int64()), *parts], names=names)

    return lines(spark, path).mapInArrow(run, "file string, at bigint, line bigint, " + ", ".join(f"p{k} string" for k in range(per)))


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """seq_id (from 0, by the files' names and the places in them) and p0, p1, ..., the lines of each record."""
    per, marks = KINDS[kind]
    if kind == "seq":
        return singles(spark, path)
    survey = stored(surveyed(spark, path, kind))
    ranges = survey.filter("lines is not null").select("file", "at", "lines", "filled")
    ahead = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = stored(ranges.select("file", "at", ahead.alias("ahead"), F.when(F.col("filled") > 0, ahead + F.col("filled")).otherwise(0).alias("end")))
    files = ranges.groupBy("file").agg(F.floor((F.max("end") + per - 1) / per).alias("n"))  # one row a file
    files = files.select("file", F.col("n"), F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = stored(ranges.join(files, "file").select("file", "at", "ahead", "base", "n"))
    line = F.col("ahead") + F.col("line")
    begins = F.when(line % per == 0, F.col("base") + F.floor(line / per)).otherwise(F.raise_error(F.concat(F.lit("a record begins out of step in "), F.col("file"))).cast("bigint"))
    inner = wholes(spark, path, kind).join(placed, ["file", "at"]).filter(F.floor(line / per) < F.col("n")).select(begins.alias("seq_id"), *[f"p{k}" for k in range(per)])
    rest = survey.filter("line is not null").join(placed, ["file", "at"]).filter(F.floor(line / per) < F.col("n"))
    rest = rest.groupBy((F.col("base") + F.floor(line / per)).alias("seq_id")).agg(*[F.max(F.when(line % per == k, F.col("value"))).alias(f"p{k}") for k in range(per)])
    return inner.unionByName(rest)


def singles(spark: SparkSession, path: str) -> DataFrame:
    """Records of one line: those that aren't empty, by ranges and places in them."""
    rows = lines(spark, path).filter("value != ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, at, first, found, whole in in_ranges(batches, 1, ()):
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array([at] * len(found), pa.int64()), pa.array(np.arange(first, first + len(found)), pa.int64()), found], names=["file", "at", "line", "p0"])

    ranges = stored(rows.groupBy("file", "at").agg(F.count("*").alias("n")))
    files = ranges.groupBy("file").agg(F.sum("n").alias("m"))  # one row a file
    files = files.select("file", F.coalesce(F.sum("m").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stored(ranges.select("file", "at", ahead.alias("ahead")).join(files, "file"))
    return rows.mapInArrow(run, "file string, at bigint, line bigint, p0 string").join(placed, ["file", "at"]).select((F.col("base") + F.col("ahead") + F.col("line")).alias("seq_id"), "p0")
