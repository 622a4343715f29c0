"""Purged walk-forward folds over session numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def expanding_windows(spark: SparkSession, sessions: int, train: int, test: int, purge: int, embargo: int) -> DataFrame:
    """Expanding calendar windows: train [1, train_end], test [test_start, test_end]."""
    first = train + purge + embargo + 1
    return _folds(spark, sessions, first, test).withColumn("train_start", F.lit(1)).withColumn("train_end", F.col("test_start") - 1 - purge - embargo)


def evaluator_folds(spark: SparkSession, sessions: int, min_train: int, test: int, horizon: int, embargo: int) -> DataFrame:
    """Evaluator folds; the first test follows min_train sessions, the label's reach and the embargo."""
    return _folds(spark, sessions, min_train + horizon + 1 + embargo + 1, test)


def _folds(spark: SparkSession, sessions: int, first: int, test: int) -> DataFrame:
    if first > sessions:
        return spark.createDataFrame([], "fold int, test_start int, test_end int")
    starts = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(sessions), F.lit(test))).alias("test_start"))
    out = starts.withColumn("test_end", F.least(F.col("test_start") + test - 1, F.lit(sessions)))
    return out.withColumn("fold", ((F.col("test_start") - first) / test).cast("int")).select("fold", "test_start", "test_end")


def train_rows(panel: DataFrame, folds: DataFrame, embargo: int) -> DataFrame:
    """Labelled rows before the test whose label ends before the test less the embargo."""
    purged = (F.col("session_index") < F.col("test_start")) & (F.col("label_end") < F.col("test_start") - embargo)
    return panel.where("label is not null").join(F.broadcast(folds), purged)


def inference_rows(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold's test sessions, labelled or not."""
    return panel.join(F.broadcast(folds), F.col("session_index").between(F.col("test_start"), F.col("test_end")))


def test_rows(panel: DataFrame, folds: DataFrame) -> DataFrame:
    return inference_rows(panel, folds).where("label is not null")


def usable_folds(train: DataFrame, min_rows: int, min_sessions: int) -> DataFrame:
    """Folds with enough training rows and sessions."""
    sizes = train.groupBy("fold").agg(F.count("*").alias("n_rows"), F.countDistinct("session_index").alias("n_sessions"))
    return sizes.where((F.col("n_rows") >= min_rows) & (F.col("n_sessions") >= min_sessions))


def split_at(df: DataFrame, day: str, training_end, test_start) -> DataFrame:
    """Rows marked train or test by date boundaries; rows between are left out."""
    part = F.when(F.col(day) <= F.lit(training_end), "train").when(F.col(day) >= F.lit(test_start), "test")
    return df.withColumn("part", part).where("part is not null")
