"""Typed scans and sinks. Schemas are given, never inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.pit import number_sessions

OBSERVATIONS = "session date, asset string, field string, value double, available_at timestamp, source_row_id string"
UNIVERSE = "asset string, valid_from date, valid_to date, known_at timestamp"
SESSIONS = "session date, open_at timestamp, decision_at timestamp"
BARS = "day date, asset string, open double, high double, low double, close double, dollar_volume double, borrow_available boolean"
SIGNALS = "signal_id string, asset string, score double, available_at timestamp, snapshot_hash string"
TRAINING = "day date, strategy_id string, return double, available_at timestamp"
MARKET = "day date, close double, available_at timestamp"
EXCHANGE_SESSIONS = "exchange string, session string, open_at timestamp, close_at timestamp"
SESSION_BARS = "exchange string, asset string, open_at timestamp, end_at timestamp, open double, high double, low double, close double, kind string"
SPAN = "struct<start:int,end:int,quote:string>"
SOURCE = f"dataset_id string, source_key string, observation_id string, observed_on date, value double, published_at timestamp, retrieved_at timestamp, extracted_at timestamp, source_hash string, spans array<{SPAN}>"
EXPOSURE = "asset string, source_key string, valid_from date, valid_to date, available_at timestamp, weight double"
FEATURE_REQUEST = "sources array<struct<{}>>, exposures array<struct<{}>>, sessions array<struct<session:date,decision_at:timestamp>>"


def missing_columns(df: DataFrame, schema: str) -> list[str]:
    """Schema columns that a table lacks; other columns are tolerated."""
    wanted = StructType.fromDDL(schema).fieldNames()
    return [c for c in wanted if c not in df.columns]


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet with a fixed schema; filters and columns reach the reader."""
    return spark.read.schema(schema).parquet(path)


def observations(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    out = scan(spark, path, OBSERVATIONS)
    return out.where(F.col("field").isin(fields)) if fields else out


def sessions(spark: SparkSession, path: str) -> DataFrame:
    return number_sessions(scan(spark, path, SESSIONS))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a malformed row fails the read."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def signals_csv(spark: SparkSession, path: str, name: str | None = None, id_column: str = "signal_id") -> DataFrame:
    """Signals whose id column is signal_id or strategy_id, read as strategy."""
    out = csv(spark, path, SIGNALS.replace("signal_id", id_column)).withColumnRenamed(id_column, "strategy")
    return out.where(F.col("strategy") == name) if name else out


def training_vectors(returns: DataFrame) -> DataFrame:
    """Each sleeve's returns in day order, as one array."""
    path = F.array_sort(F.collect_list(F.struct("day", "ret")))
    return returns.groupBy("sleeve").agg(F.transform(path, lambda s: s["ret"]).alias("returns"), F.count("*").alias("n"))


def feature_request(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A nested JSON request as sources, exposures and sessions tables."""
    struct = lambda ddl: ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))
    schema = FEATURE_REQUEST.format(struct(SOURCE), struct(EXPOSURE))
    request = spark.read.schema(schema).json(path, multiLine=True)
    return tuple(request.select(F.explode(c).alias("x")).select("x.*") for c in ("sources", "exposures", "sessions"))


def event_rows(events: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of a JSON array inside each event's payload (works on streams too)."""
    parsed = events.withColumn("__rows", F.from_json(F.get_json_object("payload", f"$.{column}"), f"array<struct<{schema}>>"))
    return parsed.select(*events.columns, F.explode_outer("__rows").alias("__r")).select(*[c for c in events.columns if c != "payload"], "__r.*")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON records, each with the name of its file."""
    return spark.read.schema(schema).json(path).withColumn("file_name", F.col("_metadata.file_name"))


def write_features(df: DataFrame, path: str) -> None:
    """Long feature rows as Parquet, partitioned by year; an empty table keeps its schema."""
    columns = StructType.fromDDL(OBSERVATIONS).fieldNames()
    df.select(*columns).withColumn("year", F.year("session")).write.partitionBy("year").parquet(path)


def write_predictions(predictions: DataFrame, calendar: DataFrame, strategy: str, snapshot: str, table: str, signals: str) -> None:
    """All prediction rows as Parquet, and the scored ones as a signals CSV dated by their decision."""
    predictions.write.parquet(table)
    known = predictions.where("score is not null").join(F.broadcast(calendar.select("session", "decision_at")), "session")
    known.select(F.lit(strategy).alias("strategy_id"), "asset", "score", F.col("decision_at").alias("available_at"), F.lit(snapshot).alias("snapshot_hash")).write.csv(signals, header=True)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.csv(path, header=True)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: it is used in several places, or must not be made anew."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file's content."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("digest"), "length")


def manifest_mismatches(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed against a manifest (file_name, digest)."""
    joined = digests.select("file_name", F.col("digest").alias("found")).join(manifest.select("file_name", F.col("digest").alias("expected")), "file_name", "full")
    return joined.where(~F.col("found").eqNullSafe(F.col("expected")))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, counting repeats; empty if equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def field_provenance(fields: DataFrame, manifest: DataFrame) -> DataFrame:
    """Provenance of each field: clock (unknown without one) and whether a language model was used."""
    found = manifest.groupBy("field").agg(F.min("clock").alias("clock"), F.bool_or(F.col("kind") == "llm").alias("uses_llm"))
    return fields.select("field").distinct().join(found, "field", "left").select("field", F.coalesce("clock", F.lit("unknown")).alias("clock"), F.coalesce("uses_llm", F.lit(False)).alias("uses_llm"))
