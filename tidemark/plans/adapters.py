"""The driver's tables in the shapes the operators take, and the same shapes as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.pit import dense_panel, number_sessions
from tidemark.sources.tables import scratch, stored

__all__ = ["scratch", "stored"]


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def month(c: str = "l_shipdate"):
    return F.to_date(F.date_trunc("month", F.col(c).cast("timestamp")))


def calendar(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "lineitem").select(month().alias("session")).distinct()
    days = days.withColumn("open_at", F.col("session").cast("timestamp_ntz")).withColumn("decision_at", F.date_add("session", 26).cast("timestamp_ntz"))
    return stored(number_sessions(days))


def observations(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem")
    return l.select(
        month().alias("session"),
        F.col("l_suppkey").alias("asset"),
        F.lit("price").alias("field"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"),
        (F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber"))).alias("available_at"),
        *[F.col(c).alias(a) for a, c in (("t1", "l_orderkey"), ("t2", "l_linenumber"), ("t3", "l_partkey"), ("t4", "l_quantity"), ("t5", "l_extendedprice"))],
    )


TIES = ["t1", "t2", "t3", "t4", "t5"]


def universe(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem")
    end = F.when(F.max(F.col("l_linestatus") == "O"), F.lit(None)).otherwise(F.expr("date_add(session, cast(max(l_quantity) as int))"))
    return l.withColumn("session", month()).groupBy(F.col("l_suppkey").alias("asset"), "session").agg(end.cast("date").alias("valid_to"), F.min("l_shipdate").alias("known_at")).withColumnRenamed("session", "valid_from")


def cells(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem")
    return l.groupBy(month().alias("session"), F.col("l_suppkey").alias("asset")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.sum("l_quantity").alias("volume"),
        F.count_if(F.col("l_linestatus") == "O").alias("open_lines"),
    )


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Supplier x month with price, volume, sector and market price; eligible if a line is open."""
    suppliers = read(spark, d, "supplier").select(F.col("s_suppkey").alias("asset"), F.pmod(F.col("s_nationkey"), F.lit(5)).alias("sector"))
    dense = dense_panel(cells(spark, d), calendar(spark, d), suppliers, ["price", "volume", "open_lines"]).join(suppliers, "asset")
    sector = dense.groupBy("session_index", "sector").agg(F.avg("price").alias("sector_price"))
    market = dense.groupBy("session_index").agg(F.avg("price").alias("market_price"))
    out = dense.join(sector, ["session_index", "sector"]).join(F.broadcast(market), "session_index")
    return out.withColumn("eligible", F.coalesce(F.col("open_lines") > 0, F.lit(False)))


def exposures(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem")
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("source_key"))
    rows = l.join(part, "l_partkey").select(
        F.col("l_suppkey").alias("asset"),
        "source_key",
        month().alias("valid_from"),
        F.when(F.col("l_returnflag") == "R", F.date_add(month(), 60)).alias("valid_to"),
        F.col("l_shipdate").alias("available_at"),
        F.round(10 * F.col("l_discount") - 0.2, 2).alias("weight"),
    )
    return rows.groupBy("asset", "source_key", "valid_from", "available_at").agg(F.max("weight").alias("weight"), F.max("valid_to").alias("valid_to"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Order prices by brand and month as revisable facts; a few are withdrawn."""
    l = read(spark, d, "lineitem")
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("source_key"))
    rows = l.join(part, "l_partkey")
    return rows.groupBy("source_key", F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.lit("#"), (F.dayofmonth("l_shipdate") % 3).cast("string")).alias("observation_id"), F.col("l_shipdate").alias("published_at")).agg(
        F.max(F.when(F.col("l_quantity") < 49, F.col("l_quantity"))).alias("value")
    ).withColumn("observed_on", F.to_date(F.date_trunc("month", F.col("published_at").cast("timestamp")))).withColumn("extracted_at", F.col("published_at") + F.make_dt_interval(F.lit(2)))


def signals(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("event_type").alias("strategy"), F.col("user_id").alias("asset"), F.col("value").alias("score"), F.col("ts").alias("available_at"), "event_id")


def event_days(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Monthly supplier bars; first and last price by a total order."""
    l = read(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("asset"), (F.col("s_acctbal") > 0).alias("borrow_available"))
    out = l.groupBy(month().alias("day"), F.col("l_suppkey").alias("asset")).agg(
        F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"), F.round(F.sum("l_extendedprice"), 2).alias("dollar_volume")
    )
    return out.join(s, "asset")


def sleeve_returns(spark: SparkSession, d: str) -> DataFrame:
    """Monthly return of each priority's mean order price: day, sleeve, ret."""
    o = read(spark, d, "orders")
    m = o.groupBy(month("o_orderdate").alias("day"), F.col("o_orderpriority").alias("sleeve")).agg(F.avg("o_totalprice").alias("level"))
    from pyspark.sql import Window

    before = F.lag("level").over(Window.partitionBy("sleeve").orderBy("day"))
    return m.withColumn("ret", F.round(F.col("level") / before - 1, 8)).where("ret is not null").select("day", "sleeve", "ret")


#: SQL twins, in the order they build on each other.
SQL = {
    "cal": "SELECT s AS session, CAST(s AS TIMESTAMP) AS open_at, CAST(s + INTERVAL 26 DAY AS TIMESTAMP) AS decision_at, row_number() OVER (ORDER BY s) AS session_index FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS s FROM lineitem)",
    "obs": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS session, l_suppkey AS asset, 'price' AS field, l_extendedprice / l_quantity AS value, l_shipdate + to_days(l_linenumber) AS available_at, l_orderkey AS t1, l_linenumber AS t2, l_partkey AS t3, l_quantity AS t4, l_extendedprice AS t5 FROM lineitem",
    "uni": "SELECT l_suppkey AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS valid_from, CASE WHEN max(l_linestatus) = 'O' THEN NULL ELSE CAST(date_trunc('month', l_shipdate) AS DATE) + CAST(max(l_quantity) AS INTEGER) END AS valid_to, min(l_shipdate) AS known_at FROM lineitem GROUP BY 1, 2, date_trunc('month', l_shipdate)",
    "cells": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS session, l_suppkey AS asset, avg(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS volume, count(*) FILTER (l_linestatus = 'O') AS open_lines FROM lineitem GROUP BY 1, 2",
    "dense": "SELECT c.session, c.session_index, c.decision_at, s.s_suppkey AS asset, s.s_nationkey % 5 AS sector, x.price, x.volume, x.open_lines FROM cal c CROSS JOIN supplier s LEFT JOIN cells x ON x.session = c.session AND x.asset = s.s_suppkey",
    "panel": "SELECT *, avg(price) OVER (PARTITION BY session_index, sector) AS sector_price, avg(price) OVER (PARTITION BY session_index) AS market_price, coalesce(open_lines > 0, FALSE) AS eligible FROM dense",
    "expo": "SELECT asset, source_key, valid_from, available_at, max(weight) AS weight, max(valid_to) AS valid_to FROM (SELECT l_suppkey AS asset, p_brand AS source_key, CAST(date_trunc('month', l_shipdate) AS DATE) AS valid_from, CASE WHEN l_returnflag = 'R' THEN CAST(date_trunc('month', l_shipdate) AS DATE) + 60 END AS valid_to, l_shipdate AS available_at, round(10 * l_discount - 0.2, 2) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2, 3, 4",
    "src": "SELECT p_brand AS source_key, strftime(l_shipdate, '%Y-%m') || '#' || CAST(day(l_shipdate) % 3 AS VARCHAR) AS observation_id, l_shipdate AS published_at, max(CASE WHEN l_quantity < 49 THEN l_quantity END) AS value, CAST(date_trunc('month', l_shipdate) AS DATE) AS observed_on, l_shipdate + INTERVAL 2 DAY AS extracted_at FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, l_shipdate",
    "sig": "SELECT event_type AS strategy, user_id AS asset, value AS score, ts AS available_at, event_id FROM events",
    "days": "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events",
    "bars": "SELECT day, asset, open, high, low, close, dollar_volume, s_acctbal > 0 AS borrow_available FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS day, l_suppkey AS asset, min_by(p, o) AS open, max(p) AS high, min(p) AS low, max_by(p, o) AS close, round(sum(l_extendedprice), 2) AS dollar_volume FROM (SELECT *, l_extendedprice / l_quantity AS p, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS o FROM lineitem) GROUP BY 1, 2) JOIN supplier ON s_suppkey = asset",
    "sleeves": "SELECT day, sleeve, ret FROM (SELECT day, sleeve, round(level / lag(level) OVER (PARTITION BY sleeve ORDER BY day) - 1, 8) AS ret FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, o_orderpriority AS sleeve, avg(o_totalprice) AS level FROM orders GROUP BY 1, 2)) WHERE ret IS NOT NULL",
}
NEEDS = {"dense": ["cal", "cells"], "panel": ["dense"]}


def with_sql(*names: str) -> str:
    """A WITH clause of the named adapters and those they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order)
