"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, in local mode (tests), a temporary one."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, keeps columns compressed and gives later joins a
    plain scan, so that adaptive execution may split a skewed side.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    if partitions:
        df = df.coalesce(partitions)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so other columns never clash."""
    return df.select(*[F.col(f"`{c}`").alias(a) for a, c in columns.items()])


def with_arrival(df: DataFrame, name: str) -> DataFrame:
    """``df`` with distinct whole numbers that follow its rows' order in the files it is read from.

    Files are ordered by the part and piece numbers that Spark gave them. A table that is not
    read from files is numbered in the order of its partitions.
    """
    if not df.inputFiles():
        return df.withColumn(name, F.monotonically_increasing_id())
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    piece = F.regexp_extract("_metadata.file_name", r"-c(\d+)\.", 1)
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    return df.withColumn(name, F.shiftleft(number(part), 42) + F.shiftleft(number(piece), 34) + F.col("_metadata.row_index"))
