"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine for a session in this process alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    # The shuffle files of this job go when it ends; what later jobs read is the table.
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    written(df, path)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_passes(passes: list[DataFrame]) -> DataFrame:
    """Writes frames of the same columns one after the other, so that only one's shuffle files are there at a time; the rows of all,
    with pass, the frame's place in the list."""
    spark = passes[0].sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    for k, df in enumerate(passes):
        written(df, f"{path}/pass={k}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passes[0].schema)
    return spark.read.schema(f"{schema}, pass int").parquet(path)


def released(df: DataFrame | None) -> None:
    """Deletes a table written by `stored` that no later job reads; takes None."""
    for file in df.inputFiles()[:1] if df is not None else ():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
