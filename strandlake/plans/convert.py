"""Conversions between formats: which are legal, and what each one writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases as B
from ..sources import files

#: Legal pairs. Run-length kinds other than v3 and nibble are written only.
LEGAL = {
    "fastq": {"fastq", "fasta", "seq", "cyc"},
    "fasta": {"fasta", "seq", "cyc", "fastq"},
    "seq": {"fasta", "fastq", "cyc"},
    "cyc": {"fasta", "fastq", "seq", "bcl"},
    "bcl": {"cyc"},
    "runfolder": {"cyc"},
    "bwt_ascii": {"bwt_rle", "bwt_rle53", "bwt_rle_v2", "bwt_rle_v3"},
    "bwt_rle": {"bwt_ascii"},
    "bwt_rle_v3": {"bwt_ascii"},
}
#: Pairs for which a length, or the removal of padding, may be asked.
SIZED = {("fastq", "fasta"), ("fastq", "fastq"), ("fastq", "seq"), ("fasta", "seq"), ("fasta", "fasta")}


def legal(source: str, target: str, length: int | None = None, unpad: bool = False) -> None:
    if target not in LEGAL.get(source, ()):
        raise ValueError(f"{source} can't be converted to {target}")
    if (length or unpad) and (source, target) not in SIZED:
        raise ValueError(f"a length can't be asked of {source} to {target}")


def shaped(reads: DataFrame, length: int | None = None, unpad: bool = False) -> DataFrame:
    if unpad:
        reads = reads.select("seq_id", "name", B.without_padding(F.col("bases"), F.col("bases")).alias("bases"), B.without_padding(F.col("quals"), F.col("bases")).alias("quals"))
    if length:
        reads = reads.select("seq_id", "name", B.to_length(F.col("bases"), length).alias("bases"), B.to_length(F.col("quals"), length).alias("quals"))
    return reads


def with_missing(reads: DataFrame, other: DataFrame) -> DataFrame:
    """Names and qualities that reads lack, from the records of the same number."""
    side = other.select("seq_id", F.col("name").alias("n2"), F.col("quals").alias("q2"))
    return reads.join(side, "seq_id", "left").select("seq_id", F.coalesce("name", "n2").alias("name"), "bases", F.coalesce("quals", "q2").alias("quals"))


def record_text(reads: DataFrame, target: str) -> DataFrame:
    """seq_id and the record's text: a reads' name, or `seq` and its number."""
    name = F.coalesce("name", F.concat(F.lit("seq"), F.col("seq_id").cast("string")))
    quals = F.coalesce("quals", F.lit(""))
    texts = {
        "fasta": F.concat(F.lit(">"), name, F.lit("\n"), F.col("bases")),
        "fastq": F.concat(F.lit("@"), name, F.lit("\n"), F.col("bases"), F.lit("\n+\n"), quals),
        "seq": F.col("bases"),
    }
    return reads.select("seq_id", texts[target].alias("value"))


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    kind = kind or files.sniffed(spark, path)
    if kind == "cyc":
        return files.from_cycles(files.cycles(spark, path))
    return {"fasta": files.fasta, "fastq": files.fastq, "seq": files.seq}[kind](spark, path)


def convert(spark: SparkSession, source: str, target_path: str, target: str, kind: str | None = None, length: int | None = None, unpad: bool = False, missing_from: str | None = None, ids: DataFrame | None = None) -> None:
    """Reads `source`, keeps the records asked for, and writes text records sorted by number."""
    kind = kind or files.sniffed(spark, source)
    legal(kind, target, length, unpad)
    reads = read(spark, source, kind)
    if ids is not None:
        reads = reads.join(ids.select("seq_id").distinct(), "seq_id", "left_semi")
    if missing_from:
        reads = with_missing(reads, read(spark, missing_from))
    text = record_text(shaped(reads, length, unpad), target)
    text.repartitionByRange("seq_id").sortWithinPartitions("seq_id").select("value").write.text(target_path)
