"""Session books as joins: entries before a close, exits after the next open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import divide

from .pit import next_session


def round_trips(books: DataFrame, calendar: DataFrame, bars: DataFrame, ratio: Callable[[Column, Column], Column] = divide) -> DataFrame:
    """One trade per book and session with exact bars at entry and exit.

    Entry is close - m minutes, exit next open + k minutes. Every trade has the same
    notional (starting capital, capped and levered, net of entry cost): results do not
    compound. Trades without one of the bars are absent; ``missing_round_trips`` has them.
    A trade whose entry price is zero has no quantity: its results are NULL. With ``columns.quotient``
    as ``ratio`` they are those of IEEE arithmetic: NaN, or minus infinity for a short with a price at its exit.
    """
    rate = F.col("cost_bps") / 10_000
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    notional = F.least("starting_cash", "max_capital") * F.col("leverage") / (1 + rate * F.col("leverage"))
    trips = planned(books, calendar)
    opens = bars.select("exchange", "asset", F.col("open_at").alias("entry_at"), F.col("open").alias("entry_price"), F.col("kind").alias("entry_kind"))
    exits = bars.where("kind = 'intraday'").select("exchange", "asset", F.col("open_at").alias("exit_at"), F.col("open").alias("exit_price"))
    out = trips.join(opens, ["exchange", "asset", "entry_at", "entry_kind"]).join(exits, ["exchange", "asset", "exit_at"])
    out = out.withColumn("notional", notional).withColumn("quantity", ratio(sign * F.col("notional"), F.col("entry_price")))
    out = out.withColumn("gross_pnl", F.col("quantity") * (F.col("exit_price") - F.col("entry_price")))
    out = out.withColumn("costs", rate * (F.col("notional") + F.abs("quantity") * F.col("exit_price")))
    out = out.withColumn("net_pnl", F.col("gross_pnl") - F.col("costs"))
    return out.withColumn("trade_return", ratio(F.col("net_pnl"), F.col("notional")))


def planned(books: DataFrame, calendar: DataFrame) -> DataFrame:
    """Entry and exit instants of every book and session that has a next session."""
    minutes = lambda c: F.make_dt_interval(F.lit(0), F.lit(0), F.col(c))
    days = next_session(calendar, "open_at").where("next_open_at is not null")
    trips = books.join(F.broadcast(days), "exchange")  # the calendar is small, books grow
    trips = trips.withColumn("entry_at", F.col("close_at") - minutes("entry_minutes_before_close")).withColumn("exit_at", F.col("next_open_at") + minutes("exit_minutes_after_next_open"))
    return trips.withColumn("entry_kind", F.when(F.col("entry_minutes_before_close") == 0, "auction").otherwise("intraday"))


def first_session_touch(trades: DataFrame, bars: DataFrame, stop: float, target: float) -> DataFrame:
    """First stop or target crossing of each trade inside its held interval, at bar open or within the bar."""
    held = trades.join(bars.where("kind = 'intraday'"), ["exchange", "asset"]).where("open_at >= entry_at and open_at < exit_at")
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    s, t = F.col("entry_price") * (1 - sign * stop), F.col("entry_price") * (1 + sign * target)
    at_open = F.when(sign * (F.col("open") - s) <= 0, "stop_loss").when(sign * (F.col("open") - t) >= 0, "take_profit")
    inside = F.when((F.col("low") <= s) & (s <= F.col("high")), "stop_loss").when((F.col("low") <= t) & (t <= F.col("high")), "take_profit")
    hit = held.withColumn("reason", F.coalesce(at_open, inside)).where("reason is not null")
    level = F.when(F.col("reason") == "stop_loss", s).otherwise(t)
    hit = hit.withColumn("exit_price", F.when(at_open.isNotNull(), F.col("open")).otherwise(level))
    return hit.groupBy("trade_id").agg(F.min(F.struct("open_at", "reason", "exit_price")).alias("e")).select("trade_id", "e.*")


def trade_nav(trades: DataFrame, starting_cash: float, *by: str) -> DataFrame:
    """NAV after each exit: starting cash plus the running net result; NULL from a trade on that was entered at price zero
    and has no result. Where it has one (NaN or an infinity, of ``columns.quotient``), that goes on in the sum."""
    order = Window.partitionBy(*by).orderBy("exit_at", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    undefined = F.count_if((F.col("entry_price") == 0) & F.col("exit_price").isNotNull() & F.col("net_pnl").isNull()).over(order) > 0
    return trades.withColumn("nav", F.when(~undefined, starting_cash + F.sum("net_pnl").over(order)))
