"""Readers and writers of reads, cycles, base calls, transforms and side files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases as B
from ..functions import runs as R
from ..operators import packing as P
from . import records

#: File endings of the formats.
ENDINGS = {".fa": "fasta", ".fasta": "fasta", ".fastq": "fastq", ".fq": "fastq", ".seq": "seq", ".bcl": "bcl", ".cyc": "cyc"}
READ = "seq_id bigint, name string, bases string, quals string"


def format_of(path: str, start: str | None = None) -> str:
    """The format by file ending, or by the first letter of the content."""
    low = path.rstrip("/").lower()
    for ending, name in ENDINGS.items():
        if low.endswith(ending) or low.endswith(ending + ".gz"):
            return name
    if low.rpartition("/")[2].startswith("cyc."):
        return "cyc"
    if start:
        first = start[0]
        return "fasta" if first == ">" else "fastq" if first == "@" else "seq" if first.upper() in B.ALPHABET else _unknown(path)
    return _unknown(path)


def _unknown(path: str) -> str:
    raise ValueError(f"{path}: the format isn't known by its ending or content")


def sniffed(spark: SparkSession, path: str) -> str:
    try:
        return format_of(path)
    except ValueError:
        head = spark.read.text(path).filter("value != ''").head(1)
        return format_of(path, head[0][0] if head else None)


def checked(reads: DataFrame) -> DataFrame:
    """Reads of one length; another length is an error when the row is read."""
    first = reads.agg(F.min(F.length("bases")).alias("least"))
    held = reads.crossJoin(F.broadcast(first))
    return held.filter(F.when(F.length("bases") == F.col("least"), True).otherwise(F.raise_error(F.concat(F.lit("read of another length: "), F.col("seq_id").cast("string"))).cast("boolean"))).drop("least")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    return records.read(spark, path, "fasta").select("seq_id", F.substring("p0", 2, 1 << 30).alias("name"), F.col("p1").alias("bases"), F.lit(None).cast("string").alias("quals"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    return records.read(spark, path, "fastq").select("seq_id", F.substring("p0", 2, 1 << 30).alias("name"), F.col("p1").alias("bases"), F.col("p3").alias("quals"))


def seq(spark: SparkSession, path: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return records.read(spark, path, "seq").select("seq_id", none.alias("name"), F.col("p0").alias("bases"), none.alias("quals"))


def cycles(spark: SparkSession, stem: str) -> DataFrame:
    """seq_id, cycle, base (and qual) from one file a cycle: byte k of file n is letter n of read k."""
    def bytes_of(pattern: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"\.(\d+)$", 1).cast("int").alias("cycle"), F.decode("content", "ISO-8859-1").alias("text"))
        return files.select("cycle", F.posexplode(F.split("text", "")).alias("seq_id", name)).filter(F.col(name) != "")

    folder, _, name = stem.rpartition("/")
    base = bytes_of(f"{stem}.*", "base")
    try:
        qual = bytes_of(f"{folder}/qual.{name}.*" if folder else f"qual.{name}.*", "qual")
    except Exception as error:  # no such files: Spark says so when it lists them
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return base.select("seq_id", "cycle", "base", F.lit(None).cast("string").alias("qual"))
    return base.join(qual, ["seq_id", "cycle"], "left").select("seq_id", "cycle", "base", "qual")


def to_cycles(reads: DataFrame) -> DataFrame:
    """Reads letter by letter: seq_id, cycle (from 0), base, qual."""
    rows = reads.select("seq_id", "quals", F.posexplode(F.split("bases", "")).alias("cycle", "base")).filter("base != ''")
    return rows.select("seq_id", "cycle", "base", F.col("quals").substr(F.col("cycle") + 1, F.lit(1)).alias("qual"))


def from_cycles(rows: DataFrame) -> DataFrame:
    """Letters back to reads; letters on end are joined before the shuffle."""
    one = rows.select("seq_id", "cycle", "base", "qual")
    kinds = [f"{name} {one.schema[c].dataType.simpleString()}" for name, c in (("seq_id", "seq_id"), ("at", "cycle"))]
    pieces = one.mapInArrow(P.read_pieces, ", ".join([*kinds, "bases string, quals string"]))
    both = F.sort_array(F.collect_list(F.struct("at", "bases", "quals")))
    return pieces.groupBy("seq_id").agg(both.alias("x")).select("seq_id", F.concat(F.lit("Read "), F.col("seq_id").cast("string")).alias("name"), F.array_join("x.bases", "").alias("bases"), F.array_join("x.quals", "").alias("quals"))


#: Bytes in front of the clusters of a base-call and of a filter file; of a base-call file the first four count them.
CALL_HEAD, FILTER_HEAD = 4, 12
#: Where lane, cycle and tile stand in a path, and lane and tile of a filter.
CALL_PATH = r"L(\d+)/C(\d+)\.1/(?:.*/)?([^/]+?)\.bcl"
FILTER_PATH = r"L(\d+)/(?:.*/)?([^/]+?)\.filter"
SLICE = 1 << 16


def cluster_bytes(spark: SparkSession, path: str, head: int, name: str) -> DataFrame:
    """path, cluster and a column `name` with its byte, of tile files; a file's bytes are handed on in slices.

    What a file holds beyond the clusters that its header counts isn't read; a file with no whole header has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                body = raw[head:]
                if head == CALL_HEAD:
                    body = body[: int.from_bytes(raw[:head].tobytes(), "little")]
                for a in range(0, len(body), SLICE):
                    part = body[a : a + SLICE].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([where] * len(part), pa.string()), pa.array(np.arange(a, a + len(part))), pa.array(part)], names=["path", "cluster", name])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, f"path string, cluster bigint, {name} int")


def called(rows: DataFrame, passing: DataFrame | None, keys: list[str]) -> DataFrame:
    """base and qual of bytes; clusters whose byte in the filter is 0 go, those beyond its end or without one stay."""
    if passing is not None:
        rows = rows.join(passing, [*keys, "cluster"], "left").filter(F.coalesce(F.col("pass") != 0, F.lit(True))).drop("pass")
    return rows.withColumns({"base": B.unpacked_base(F.col("byte")), "qual": B.unpacked_quality(F.col("byte"))}).drop("byte")


def base_calls(spark: SparkSession, path: str, filters: str | None = None) -> DataFrame:
    """tile, cluster, base, qual of the base-call files of one cycle; tiles are named by their files."""
    named = lambda rows: rows.withColumn("tile", F.regexp_extract("path", r"([^/]+?)\.\w+$", 1)).drop("path")
    passing = named(cluster_bytes(spark, filters, FILTER_HEAD, "pass")) if filters else None
    return called(named(cluster_bytes(spark, path, CALL_HEAD, "byte")), passing, ["tile"]).select("tile", "cluster", "base", "qual")


def run_folder(spark: SparkSession, folder: str) -> DataFrame:
    """lane, tile, cluster, cycle (from 0), base, qual of a whole run: its lanes, cycles and tiles are what its folders hold.

    All files are one scan, a task's share of files at a time; filters are those beside the cycles' folders.
    """
    top = f"{folder}/Data/Intensities/BaseCalls"
    lane = F.regexp_extract("path", CALL_PATH, 1).cast("int").alias("lane")
    calls = cluster_bytes(spark, f"{top}/L*/C*.1", CALL_HEAD, "byte").filter(F.col("path").rlike(CALL_PATH))
    calls = calls.select(lane, F.regexp_extract("path", CALL_PATH, 3).alias("tile"), "cluster", (F.regexp_extract("path", CALL_PATH, 2).cast("int") - 1).alias("cycle"), "byte")
    try:
        passing = cluster_bytes(spark, f"{top}/L*/*.filter", FILTER_HEAD, "pass").select(F.regexp_extract("path", FILTER_PATH, 1).cast("int").alias("lane"), F.regexp_extract("path", FILTER_PATH, 2).alias("tile"), "cluster", "pass")
    except Exception as error:  # no such files: Spark says so when it lists them
        if "PATH_NOT_FOUND" not in str(error):
            raise
        passing = None
    return called(calls, passing, ["lane", "tile"]).select("lane", "tile", "cluster", "cycle", "base", "qual")


def from_run(rows: DataFrame) -> DataFrame:
    """The reads of a run, transposed in one shuffle: lane, tile, cluster, bases, quals."""
    both = F.sort_array(F.collect_list(F.struct("cycle", "base", "qual")))
    return rows.groupBy("lane", "tile", "cluster").agg(both.alias("x")).select("lane", "tile", "cluster", F.array_join("x.base", "").alias("bases"), F.array_join("x.qual", "").alias("quals"))


def write_run(letters: DataFrame, folder: str, per_tile: int = 1 << 20) -> None:
    """Letters (seq_id, cycle, base, qual) as a run of one lane: a base-call file for each cycle and tile of per_tile reads.

    A read that has no letter at a cycle has a byte 0 there, which reads as N. A line feed ends a file, behind what its
    header counts.
    """
    rows = letters.select("cycle", F.floor(F.col("seq_id") / per_tile).alias("tile"), (F.col("seq_id") % per_tile).cast("int").alias("cluster"), B.packed(F.col("base"), F.col("qual")).alias("byte"))
    sizes = rows.groupBy("tile").agg((F.max("cluster") + 1).alias("size"))
    files = rows.groupBy("cycle", "tile").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "byte"))).alias("at")).join(sizes, "tile")
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    head = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: byte(F.call_function("shiftright", F.col("size"), k * 8).bitwiseAND(255))), "")
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: byte(F.coalesce(F.try_element_at("at", k), F.lit(0)))), "")
    value = F.unhex(F.concat(head, body)).cast("string").alias("value")
    out = files.select(value, F.format_string("C%d.1", F.col("cycle") + 1).alias("c"), F.format_string("s_1_%d", F.col("tile")).alias("t"))
    spark = letters.sparkSession
    out.write.partitionBy("c", "t").text(f"{folder}/written")
    # The run's own names: one rename a file.
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    top = path(f"{folder}/written")
    system = top.getFileSystem(conf)
    for status in system.globStatus(path(f"{folder}/written/c=*/t=*/part-*")):
        old = status.getPath()
        tile, cycle = (p.getName().partition("=")[2] for p in (old.getParent(), old.getParent().getParent()))
        new = path(f"{folder}/Data/Intensities/BaseCalls/L001/{cycle}/{tile}.bcl")
        system.mkdirs(new.getParent())
        system.rename(old, new)
    system.delete(top, True)


def run_length(spark: SparkSession, path: str, kind: str = "v3") -> DataFrame:
    """run_no, ch, run of a run-length coded transform (`v3`, or `nibble`)."""
    parse = R.v3_parsed if kind == "v3" else R.nibble_parsed

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for path_, content in zip(x["path"], x["content"], strict=True):
                found = parse(bytes(content))
                yield pd.DataFrame({"file": path_, "run_no": range(len(found)), "ch": [c for c, _ in found], "run": [n for _, n in found]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, run_no bigint, ch string, run bigint")


def ascii_transform(spark: SparkSession, path: str) -> DataFrame:
    """file, rank, ch of a transform of one byte a letter."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return whole.select("file", F.posexplode(F.split("value", "")).alias("rank", "ch")).filter("ch != ''")


def kmers(rows: DataFrame) -> DataFrame:
    """First word of each line (column value); a word of one letter is an error."""
    word = F.get(F.split(F.trim("value"), r"\s+"), F.lit(0))
    one = rows.select(word.alias("kmer")).filter("kmer != ''")
    return one.filter(F.when(F.length("kmer") >= 2, True).otherwise(F.raise_error(F.concat(F.lit("a word of one letter: "), F.col("kmer"))).cast("boolean")))


def numbers(rows: DataFrame) -> DataFrame:
    """First number of each line, each once."""
    return rows.select(F.regexp_extract("value", r"^\s*(\d+)", 1).try_cast("bigint").alias("seq_id")).filter("seq_id is not null").distinct()


def intervals(rows: DataFrame) -> DataFrame:
    x = F.split(F.trim("value"), r"\s+")
    return rows.filter("trim(value) != ''").select(F.get(x, F.lit(0)).alias("kmer"), F.get(x, F.lit(1)).cast("bigint").alias("position"), F.get(x, F.lit(2)).cast("bigint").alias("count"))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    schema = "seq_id bigint, position int, reverse_strand int, corrector string, corrector_start int, shortest_witness int, longest_witness int"
    return spark.read.csv(path, sep=" ", header=True, schema=schema)


def write_corrections(found: DataFrame, path: str) -> None:
    names = {"seq_id": "read", "corrector": "correction"}
    found.select("seq_id", "position", "reverse_strand", "corrector", "corrector_start", "shortest_witness", "longest_witness").withColumnsRenamed(names).write.csv(path, sep=" ", header=True)


def dump(rows: DataFrame, *names: str) -> DataFrame:
    r"""Fields of a dump whose lines are split by tab, bar, tab."""
    x = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return rows.select(*[F.trim(F.get(x, F.lit(k))).alias(n) for k, n in enumerate(names)])


def scientific_names(rows: DataFrame) -> DataFrame:
    return dump(rows, "tax_id", "name", "unique_name", "kind").filter(F.col("kind").contains("scientific")).select(F.col("tax_id").cast("bigint"), "name")


def tax_nodes(rows: DataFrame) -> DataFrame:
    return dump(rows, "tax_id", "parent_id", "rank").select(F.col("tax_id").cast("bigint"), F.col("parent_id").cast("bigint"), "rank")


def tax_paths(rows: DataFrame) -> DataFrame:
    """file_num, level, tax_id from lines of a number and its ranks; empty and # lines are skipped."""
    x = F.split(F.trim("value"), r"\s+")
    return rows.filter("trim(value) != '' and not startswith(value, '#')").select(F.get(x, F.lit(0)).cast("bigint").alias("file_num"), F.posexplode(F.slice(x, 2, 1000)).alias("level", "t")).select("file_num", "level", F.col("t").cast("bigint").alias("tax_id"))


def normalisation(rows: DataFrame) -> DataFrame:
    """tax_id, total, other, db from lines `FINAL: genome taxId main sum Counts: tax:n ...`."""
    x = F.split(F.trim("value"), r"\s+")
    each = rows.filter("startswith(value, 'FINAL:')").select(F.get(x, F.lit(2)).cast("bigint").alias("tax_id"), F.get(x, F.lit(4)).cast("bigint").alias("total"), F.explode(F.slice(x, 7, 100000)).alias("p"))
    p = F.split("p", ":")
    return each.select("tax_id", "total", F.get(p, F.lit(0)).cast("bigint").alias("other"), F.get(p, F.lit(1)).cast("bigint").alias("db")).groupBy("tax_id", "other").agg(F.sum("db").alias("db"), F.sum("total").alias("total"))
