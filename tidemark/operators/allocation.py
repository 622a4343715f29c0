"""Selection, allocation and the set-based parts of a portfolio's accounting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import factors


def select_quantile(scores: DataFrame, long_quantile: float, short_quantile: float, *by: str) -> DataFrame:
    """Long and short selections per group, ties by asset: at least one, never overlapping.

    Adds leg ('long' or 'short') to the chosen rows of a long-short sleeve with two or more candidates.
    """
    over = Window.partitionBy(*by)
    up = F.row_number().over(over.orderBy("score", "asset"))
    n = F.count("*").over(over)
    longs = F.least(F.greatest(F.floor(n * long_quantile), F.lit(1)), n - 1)
    shorts = F.least(n - longs, F.greatest(F.floor(n * short_quantile), F.lit(1)))
    leg = F.when(up > n - longs, "long").when(up <= shorts, "short")
    return scores.withColumn("__n", n).withColumn("leg", leg).where((F.col("__n") >= 2) & F.col("leg").isNotNull()).drop("__n")


def select_side(scores: DataFrame, quantile: float, side: str, *by: str) -> DataFrame:
    """The top quantile of a one-sided sleeve, as leg ``side``."""
    over = Window.partitionBy(*by)
    down = F.row_number().over(over.orderBy(F.desc("score"), F.desc("asset")))
    most = F.greatest(F.floor(F.count("*").over(over) * quantile), F.lit(1))
    return scores.withColumn("__k", down).withColumn("__m", most).where("__k <= __m").withColumn("leg", F.lit(side)).drop("__k", "__m")


def target_weights(selected: DataFrame, budget: Column, two_legs: Column, *by: str) -> DataFrame:
    """Equal weights within each leg; two legs share the sleeve's budget by halves; shorts are negative."""
    n = F.count("*").over(Window.partitionBy(*by, "leg"))
    sign = F.when(F.col("leg") == "short", -1.0).otherwise(1.0)
    return selected.withColumn("weight", sign * F.when(two_legs, budget / 2).otherwise(budget) / n)


def rebalance_days(calendar: DataFrame, every: int) -> DataFrame:
    """Sessions whose index from 0 divides by ``every``."""
    return calendar.where((F.col("session_index") - 1) % every == 0)


def combine_sleeves(weights: DataFrame, cap: float, *by: str) -> DataFrame:
    """Sum of the sleeves' weights per asset, clipped to [-cap, cap]."""
    return weights.groupBy(*by, "asset").agg(F.greatest(F.lit(-cap), F.least(F.lit(cap), F.sum("weight"))).alias("weight"))


def equal_weights(sleeves: DataFrame) -> DataFrame:
    return sleeves.select("sleeve").distinct().withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(F.lit(0))))


def inverse_volatility(returns: DataFrame, cap: float, *by: str) -> DataFrame:
    """Weights proportional to 1 / sample deviation with a cap; capped mass goes to the rest in proportion.

    Closed form of the repeated capping: with sleeves in falling order, the first k are
    capped for the smallest k at which the next one's share of what remains is within the cap.
    """
    strength = returns.groupBy(*by, "sleeve").agg((1.0 / F.greatest(F.coalesce(F.stddev_samp("ret"), F.lit(0.0)), F.lit(1e-8))).alias("strength"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = over.orderBy(F.desc("strength"), "sleeve")
    k = F.row_number().over(order) - 1
    rest = F.sum("strength").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = strength.withColumn("k", k).withColumn("rest", rest)
    within = (1 - F.col("k") * cap) * F.col("strength") / F.col("rest") <= cap + 1e-15
    first = F.min(F.when(within, F.col("k"))).over(over)
    tail = F.max(F.when(F.col("k") == F.col("first"), F.col("rest"))).over(over)
    out = ranked.withColumn("first", first).withColumn("tail", tail)
    weight = F.when(F.col("first").isNull() | (F.col("k") < F.col("first")), F.lit(cap)).otherwise((1 - F.col("first") * cap) * F.col("strength") / F.col("tail"))
    return out.withColumn("weight", weight).select(*by, "sleeve", "weight")


def project_capped_simplex(v: np.ndarray, cap: float) -> np.ndarray:
    """Euclidean projection on weights in [0, cap] that sum to one, by bisection."""
    low, high = v.min() - cap, v.max()
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > 1 else (low, mid)
    return np.clip(v - high, 0, cap)


def capped_minimum(c: np.ndarray, cap: float) -> tuple[np.ndarray, float]:
    """Weights from 0 to ``cap`` that sum to 1 with the least w'Cw, and how far they are from optimality.

    Active-set method: on the free weights the equality problem is solved exactly; a step that
    leaves the box stops at the first bound, which joins the active ones; at its solution the bound
    whose multiplier has the wrong sign most leaves them. The residual is the greatest
    change of a weight under a unit projected-gradient step, with gradients in units of the mean variance.
    """
    n = len(c)
    unit = max(float(np.trace(c)) / n, 1e-300)
    c = (c + c.T) / (2 * unit)
    w = np.full(n, 1 / n)
    low, high = np.zeros(n, bool), w >= cap
    for _ in range(50 * n + 50):
        free = ~(low | high)
        m = int(free.sum())
        if m:
            system = np.zeros((m + 1, m + 1))
            system[:m, :m], system[:m, m], system[m, :m] = 2 * c[np.ix_(free, free)], -1, 1
            right = np.append(-2 * c[np.ix_(free, ~free)] @ w[~free], 1 - w[~free].sum())
            solved = np.linalg.lstsq(system, right, rcond=1e-13)[0]
            step = solved[:m] - w[free]
            room = np.where(step > 0, cap - w[free], w[free])
            far = np.abs(step) > room + 1e-15
            if far.any():
                ratio = np.where(far, room / np.maximum(np.abs(step), 1e-300), np.inf)
                k = int(ratio.argmin())
                w[free] += ratio[k] * step
                at = np.flatnonzero(free)[k]
                (high if step[k] > 0 else low)[at] = True
                w[at] = cap if step[k] > 0 else 0.0
                continue
            w[free] = solved[:m]
        gradient = 2 * c @ w
        level = gradient[free].mean() if m else (gradient[high].max(initial=-np.inf) + gradient[low].min(initial=np.inf)) / 2
        if not np.isfinite(level):
            level = gradient.max() if high.any() else gradient.min()
        wrong = np.where(low, level - gradient, np.where(high, gradient - level, 0.0))
        k = int(wrong.argmax())
        if wrong[k] <= 1e-12:
            break
        low[k] = high[k] = False
    residual = np.abs(w - np.clip(w - (2 * c @ w - level), 0, cap)).max()
    return w, float(max(residual, abs(w.sum() - 1)))


def minimum_variance(covariances: DataFrame, cap: float, by: str) -> DataFrame:
    """Minimum-variance weights of many windows: ``by``, sleeve, weight, residual (0 at the optimum).

    ``covariances`` is long (by, sleeve_a, sleeve_b, covariance), as the covariance operator
    gives it; a group holds one window's sleeves squared. A window whose sleeves times ``cap`` stay below 1 has
    NULL weights.
    """

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot(index="sleeve_a", columns="sleeve_b", values="covariance").sort_index().sort_index(axis=1)
        names = table.index.tolist()
        w, residual = (None, None) if len(names) * cap < 1 - 1e-12 else capped_minimum(table.to_numpy(float), cap)
        return pd.DataFrame({by: frame[by].iloc[0], "sleeve": names, "weight": w, "residual": residual})

    kinds = dict(covariances.dtypes)
    return covariances.groupBy(by).applyInPandas(solve, f"{by} {kinds[by]}, sleeve {kinds['sleeve_a']}, weight double, residual double")


def order_deltas(targets: DataFrame, positions: DataFrame, bars: DataFrame, nav: float, offset_bps: float) -> DataFrame:
    """Orders from holdings to targets with limit prices; assets without a bar give none.

    A short that grows without borrow is cut to closing the long.
    """
    both = targets.select("day", "asset", "weight").join(positions.select("day", "asset", "quantity"), ["day", "asset"], "full").join(bars, ["day", "asset"])
    held, wanted = F.coalesce("quantity", F.lit(0.0)), F.coalesce("weight", F.lit(0.0)) * nav / F.col("close")
    blocked = (wanted < F.least(held, F.lit(0.0))) & ~F.col("borrow_available")
    size = F.when(blocked, -F.greatest(held, F.lit(0.0))).otherwise(wanted - held)
    limit = F.col("close") * F.when(F.col("order_quantity") > 0, 1 - offset_bps / 10_000).otherwise(1 + offset_bps / 10_000)
    return both.withColumn("order_quantity", size).where(F.abs("order_quantity") >= 1e-12).withColumn("limit_price", limit).select("day", "asset", "order_quantity", "limit_price")


def next_bar_fills(orders: DataFrame, bars: DataFrame, slippage_bps: float, participation: float) -> DataFrame:
    """Price and size of each order at its asset's next bar; orders that the bar does not reach give none."""
    order = Window.partitionBy("asset").orderBy("day")
    after = bars.select("asset", "day", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("day", "open", "high", "low", "dollar_volume")])
    o = orders.join(after, ["asset", "day"])
    buy, limit, slip = F.col("order_quantity") > 0, F.col("limit_price"), slippage_bps / 10_000
    reached = F.when(buy, F.col("next_low") <= limit).otherwise(F.col("next_high") >= limit)
    bought = F.least(limit, F.col("next_high"), F.least("next_open", limit) * (1 + slip))
    sold = F.greatest(limit, F.col("next_low"), F.greatest("next_open", limit) * (1 - slip))
    priced = o.where(reached).withColumn("price", F.when(buy, bought).otherwise(sold))
    most = F.col("next_dollar_volume") * participation / F.col("price")
    return priced.withColumn("filled", F.greatest(-most, F.least(most, F.col("order_quantity")))).select("asset", "day", "next_day", "price", "filled")


def first_touch(positions: DataFrame, bars: DataFrame, stop: float, target: float) -> DataFrame:
    """First protective exit of each position over later bars: day, reason and price.

    A gap through the target at the open comes first, then the stop, then the target.
    """
    held = positions.join(bars, "asset").where("day > entry_day")
    long, entry = F.col("quantity") > 0, F.col("entry_price")
    s = F.when(long, entry * (1 - stop)).otherwise(entry * (1 + stop))
    t = F.when(long, entry * (1 + target)).otherwise(entry * (1 - target))
    gap = F.when(long, F.col("open") >= t).otherwise((t > 0) & (F.col("open") <= t))
    stopped = F.when(long, F.col("low") <= s).otherwise(F.col("high") >= s)
    reached = F.when(long, F.col("high") >= t).otherwise((t > 0) & (F.col("low") <= t))
    reason = F.when(gap, "take_profit").when(stopped, "stop_loss").when(reached, "take_profit")
    price = F.when(gap, F.col("open")).when(stopped, F.when(long, F.least("open", s)).otherwise(F.greatest("open", s))).otherwise(t)
    hit = held.withColumn("reason", reason).withColumn("exit_price", price).where("reason is not null")
    return hit.groupBy("position_id").agg(F.min(F.struct("day", "reason", "exit_price")).alias("e")).select("position_id", F.col("e.day").alias("exit_day"), F.col("e.reason").alias("reason"), F.col("e.exit_price").alias("exit_price"))


def combine_signals(signals: DataFrame, how: str, n_signals: int) -> DataFrame:
    """Mean of the signals' scores (linear_equal) or centred ranks (rank_equal), where all are present."""
    value = F.col("score") if how == "linear_equal" else factors.centered_rank(F.col("score"), "day", "strategy")
    parts = signals.withColumn("__v", value)
    return parts.groupBy("day", "asset").agg(F.avg("__v").alias("score"), F.count("__v").alias("n")).where(F.col("n") == n_signals).drop("n")


def nav_series(nav: DataFrame, initial: float, *by: str) -> DataFrame:
    """Returns, running peak (including the initial cash), drawdown and turnover on the prior NAV."""
    order = Window.partitionBy(*(by or (F.lit(0),))).orderBy("day")
    before = F.lag("nav", 1, initial).over(order)
    peak = F.greatest(F.lit(initial), F.max("nav").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = nav.withColumn("previous", before).withColumn("peak", peak)
    out = out.withColumn("return", F.col("nav") / F.col("previous") - 1).withColumn("drawdown", F.col("nav") / F.col("peak") - 1)
    return out.withColumn("turnover", F.col("traded") / F.col("previous")) if "traded" in nav.columns else out


def metrics(series: DataFrame, initial: float, *by: str) -> DataFrame:
    """Final value, total return, largest drawdown, turnover and commission of nav_series rows."""
    return series.groupBy(*by).agg(
        F.max_by("nav", "day").alias("final_nav"),
        (F.max_by("nav", "day") / initial - 1).alias("total_return"),
        (-F.min("drawdown")).alias("max_drawdown"),
        F.sum("turnover").alias("gross_turnover"),
        F.sum("commission").alias("commission_cost"),
    )


def positions_from_fills(fills: DataFrame, *by: str) -> DataFrame:
    return fills.groupBy(*by, "asset").agg(F.sum("quantity").alias("quantity"))


def cash_from_fills(fills: DataFrame, initial: float, *by: str) -> DataFrame:
    return fills.groupBy(*by).agg((F.lit(initial) - F.sum(F.col("quantity") * F.col("price") + F.col("commission"))).alias("cash"))


def borrow_cost(positions: DataFrame, bars: DataFrame, annual_rate: float) -> DataFrame:
    """Accrual on shorts marked at the prior close, actual/365: day, asset, cost."""
    order = Window.partitionBy("asset").orderBy("day")
    prior = bars.withColumn("prior_close", F.lag("close").over(order)).withColumn("days", F.datediff("day", F.lag("day").over(order)))
    short = positions.where("quantity < 0").join(prior.where("prior_close is not null"), ["day", "asset"])
    return short.select("day", "asset", (-F.col("quantity") * F.col("prior_close") * annual_rate * F.col("days") / 365).alias("cost"))
