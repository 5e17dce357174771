"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder of this machine does if the session runs in this process alone; a cluster needs the
    setting, since its executors can't see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes `df` as a compressed table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # The shuffle files of this job go when it ends; what later jobs read is the table.
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def released(*frames: DataFrame) -> None:
    """Deletes tables written by `stored` once no later job reads them."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df itself; from now on its session hands Python a few MB at a time, so that long texts don't fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def column(name: str) -> Column:
    """The column of that very name, whatever dots and backticks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame) -> DataFrame:
    """doc_id, text and box, which holds all other columns by place: their names, whatever they are, clash with nothing."""
    return df.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[column(c).alias(f"c{k}") for k, c in enumerate(df.columns) if c not in ("doc_id", "text")]).alias("box"))


def unboxed(df: DataFrame, like: DataFrame, *added: str) -> DataFrame:
    """The columns of `like`, which was boxed; and those of df that are named, in place of any of the same name."""
    own = [F.col(c) if c in ("doc_id", "text") else F.col("box").getField(f"c{k}").alias(c) for k, c in enumerate(like.columns) if c not in added]
    return df.select(*own, *added)


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; a null text stands for an empty one."""
    small_batches(df)
    names = columns or ("doc_id", "text")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "text" else F.col(c) for c in names])
