"""Information coefficients and summary statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import factors


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation aggregate; 0 where either side does not vary.

    A variance below 1e-24 of the squared mean is rounding, not variation.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    vx, vy = F.var_pop(x), F.var_pop(y)
    real = (vx > 1e-24 * F.avg(x * x)) & (vy > 1e-24 * F.avg(y * y))
    return F.when(real, F.try_divide(F.covar_pop(x, y), F.sqrt(vx * vy))).otherwise(0.0)


def rank_ic(df: DataFrame, score: str, outcome: str, *by: str) -> DataFrame:
    """Rank correlation of score and outcome per group (ic, n), over rows that have both.

    Groups whose outcome does not vary are left out.
    """
    both = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ranked = both.select(*by, factors.rank(F.col(score), *by).alias("__s"), factors.rank(F.col(outcome), *by).alias("__o"), F.col(outcome).alias("__y"))
    out = ranked.groupBy(*by).agg(correlation(F.col("__s"), F.col("__o")).alias("ic"), F.count("*").alias("n"), F.min("__y").alias("__lo"), F.max("__y").alias("__hi"))
    return out.where("__lo < __hi").drop("__lo", "__hi")


def similarity(scores: DataFrame, library: DataFrame, *by: str) -> DataFrame:
    """Mean absolute correlation with each library factor (factor, similarity).

    ``scores`` has by, asset, score; ``library`` has by, asset, factor, score.
    """
    joined = scores.withColumnRenamed("score", "__s").join(library, [*by, "asset"])
    daily = joined.groupBy("factor", *by).agg(correlation(F.col("__s"), F.col("score")).alias("c"))
    return daily.groupBy("factor").agg(F.avg(F.abs("c")).alias("similarity"))


def turnover(weights: DataFrame) -> DataFrame:
    """Half the summed absolute weight change from each session to the next; absent weights are zero."""
    now = weights.select("session_index", "asset", "weight")
    then = weights.select((F.col("session_index") + 1).alias("session_index"), "asset", F.col("weight").alias("before"))
    last = weights.agg(F.max("session_index").alias("last"))
    moved = now.join(then, ["session_index", "asset"], "full").join(F.broadcast(last)).where("session_index <= last")
    first = Window.partitionBy(F.lit(0))
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    out = moved.groupBy("session_index").agg((F.sum(change) / 2).alias("turnover"))
    return out.withColumn("__first", F.min("session_index").over(first)).where("session_index > __first").drop("__first")


def half_life(decay: DataFrame, *by: str) -> DataFrame:
    """Smallest horizon whose value is at most half of the first horizon's; NULL if none."""
    start = F.min_by("value", "horizon").over(Window.partitionBy(*by))
    at = decay.withColumn("__first", start)
    return at.groupBy(*by).agg(F.min(F.when(F.col("value") <= F.col("__first") / 2, F.col("horizon"))).alias("half_life"))


def stability(folds: DataFrame, *by: str) -> DataFrame:
    """Share of folds with a positive metric, and whether at least two folds and 60 % are."""
    share = F.avg(F.when(F.col("metric") > 0, 1.0).otherwise(0.0))
    out = folds.groupBy(*by).agg(share.alias("stability"), F.count("*").alias("n_folds"))
    return out.withColumn("persistent", (F.col("n_folds") >= 2) & (F.col("stability") >= 0.6))


def adjusted_p(p: Column, trials: Column) -> Column:
    """Bonferroni: least(1, p x trials)."""
    return F.least(F.lit(1.0), p * trials)


def conditional_performance(df: DataFrame, *by: str) -> DataFrame:
    """Probability-weighted score x outcome per state; ``probabilities`` is an array."""
    rows = df.select(*by, "score", "outcome", F.posexplode("probabilities").alias("state", "p"))
    total = F.sum("p")
    return rows.groupBy(*by, "state").agg(F.try_divide(F.sum(F.col("p") * F.col("score") * F.col("outcome")), total).alias("performance"))


def conditional_ic(daily: DataFrame, *by: str) -> DataFrame:
    """Weighted mean IC and Kish effective days per state, from daily ic and ``probabilities``."""
    rows = daily.select(*by, "ic", F.posexplode("probabilities").alias("state", "p"))
    p = F.col("p")
    return rows.groupBy(*by, "state").agg(F.try_divide(F.sum(p * F.col("ic")), F.sum(p)).alias("ic"), F.try_divide(F.sum(p) * F.sum(p), F.sum(p * p)).alias("effective_days"))


def state_moments(df: DataFrame, *by: str) -> DataFrame:
    """Weighted mean, volatility, loss probability and negative contribution per state.

    ``df`` has ret and ``probabilities``; the variance is taken about the mean from raw moments.
    """
    rows = df.select(*by, "ret", F.posexplode("probabilities").alias("state", "p"))
    p, r = F.col("p"), F.col("ret")
    total = F.sum(p)
    mean, square = F.sum(p * r) / total, F.sum(p * r * r) / total
    return rows.where("p > 0").groupBy(*by, "state").agg(
        mean.alias("mean_return"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("volatility"),
        (F.sum(F.when(r < 0, p).otherwise(0.0)) / total).alias("loss_probability"),
        (F.sum(p * F.least(r, F.lit(0.0))) / total).alias("negative_contribution"),
        (total * total / F.sum(p * p)).alias("effective_days"),
    )


def capacity(df: DataFrame, participation: float, *by: str) -> DataFrame:
    """Smallest volume x participation / turnover."""
    return df.groupBy(*by).agg(F.min(F.col("volume") * participation / F.greatest("turnover", F.lit(1e-12))).alias("capacity"))


def coverage(df: DataFrame, score: str) -> DataFrame:
    """Scored rows over eligible rows."""
    return df.agg(F.coalesce(F.try_divide(F.count(score), F.count_if("eligible")), F.lit(0.0)).alias("coverage"))


SERIES = ["raw", "baseline", "augmented"]


def daily_series(predictions: DataFrame, raw: str, outcome: str) -> DataFrame:
    """Rank coefficients per fold and session of the score itself and of both models, on the same rows.

    ``predictions`` has fold, session_index, ``raw``, baseline, augmented and ``outcome``.
    Result: fold, session_index, n, raw, baseline, augmented, incremental (augmented less baseline).
    """
    scored = predictions.where(F.col(outcome).isNotNull()).select("fold", "session_index", F.col(outcome).alias("__y"), F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.col(raw if s == "raw" else s).alias("score")) for s in SERIES])).alias("s")).select("fold", "session_index", "__y", "s.*")
    each = rank_ic(scored, "score", "__y", "fold", "session_index", "series")
    one = lambda s: F.max(F.when(F.col("series") == s, F.col("ic"))).alias(s)
    wide = each.groupBy("fold", "session_index").agg(F.max("n").alias("n"), *[one(s) for s in SERIES])
    return wide.withColumn("incremental", F.col("augmented") - F.col("baseline"))


def long_series(daily: DataFrame) -> DataFrame:
    """daily_series as fold, session_index, series, ic."""
    return daily.unpivot(["fold", "session_index"], [*SERIES, "incremental"], "series", "ic")


def fold_evidence(daily: DataFrame, training: DataFrame, folds: DataFrame) -> DataFrame:
    """One row per measured fold: training bounds and label end, test bounds, rows, measured sessions and mean coefficients.

    ``training`` has the folds' purged training rows (fold, session_index, label_end);
    ``daily`` comes from daily_series.
    """
    fitted = training.groupBy("fold").agg(F.min("session_index").alias("train_start"), F.max("session_index").alias("train_end"), F.max("label_end").alias("last_label_end"), F.count("*").alias("n_train"))
    means = [F.avg(s).alias(f"mean_{s}_ic") for s in [*SERIES, "incremental"]]
    measured = daily.groupBy("fold").agg(F.sum("n").alias("n_test"), F.count("*").alias("n_sessions"), *means)
    return fitted.join(folds.select("fold", "test_start", "test_end"), "fold").join(measured, "fold")


def covariance(returns: DataFrame, shrinkage: float) -> DataFrame:
    """Sample covariance of sleeves, off-diagonals shrunk by (1 - shrinkage)."""
    left = returns.select("day", F.col("sleeve").alias("sleeve_a"), F.col("ret").alias("a"))
    right = returns.select("day", F.col("sleeve").alias("sleeve_b"), F.col("ret").alias("b"))
    out = left.join(right, "day").groupBy("sleeve_a", "sleeve_b").agg(F.covar_samp("a", "b").alias("covariance"))
    return out.withColumn("covariance", F.when(F.col("sleeve_a") == F.col("sleeve_b"), F.col("covariance")).otherwise(F.col("covariance") * (1 - shrinkage)))


def block_bootstrap(series: DataFrame, block: int, samples: int, seed: int) -> DataFrame:
    """Circular moving-block bootstrap of a mean: interval, and one-sided centred p.

    ``series`` has idx (from 0) and value. Block starts come from an integer generator that
    SQL engines share: ((sample * 7919 + block number * 104729 + seed) * 1103515245 + 12345)
    modulo 2147483648, then modulo the length.
    """
    n = series.agg(F.count("*").alias("n"), F.avg("value").alias("center"))
    starts = series.sparkSession.range(samples).withColumnRenamed("id", "sample").join(F.broadcast(n))
    starts = starts.withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block) - 1)))
    start = ((F.col("sample") * 7919 + F.col("b") * 104729 + seed) * 1103515245 + 12345) % 2147483648 % F.col("n")
    places = starts.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("b") * block + F.col("k") < F.col("n"))
    means = places.withColumn("idx", (F.col("start") + F.col("k")) % F.col("n")).join(series, "idx").groupBy("sample", "center").agg(F.avg("value").alias("mean"))
    return means.agg(
        F.percentile("mean", F.lit(0.025)).alias("low"),
        F.percentile("mean", F.lit(0.975)).alias("high"),
        ((1 + F.count_if(F.col("mean") - F.col("center") >= F.col("center") - F.lit(1e-12))) / (F.count("*") + 1)).alias("p_value"),
    )


def content_hash(df: DataFrame, part_rows: int = 20_000, fan: int = 3) -> DataFrame:
    """Order-free SHA-256 of all rows, as a tree over the prefixes of their hashes.

    The leaves hold the sorted row hashes of one prefix, of about ``part_rows`` rows; each
    level above joins up to 16**``fan`` of the level below. The depth follows from the number
    of rows, so equal tables have equal hashes however they are partitioned.
    """
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    n = df.count()
    digits = max(0, math.ceil(math.log(max(n / part_rows, 1), 16)))
    level = df.select(h.alias("h"), h.alias("key"))
    while True:
        at = F.substring("key", 1, digits) if digits else F.lit("")
        inside = F.transform(F.sort_array(F.collect_list(F.struct("key", "h"))), lambda s: s["h"])
        level = level.groupBy(at.alias("key")).agg(F.sha2(F.array_join(inside, ""), 256).alias("h"))
        if not digits:
            return level.select(F.col("h").alias("hash"), F.lit(n).cast("long").alias("n_rows"))
        digits = max(0, digits - fan)
