"""Fold-wise models and latent market states."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import softmax
from tidemark.sources.tables import stored


def gram_sums(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Per session: n, sums and products of features and target. One map-side combined pass."""
    both = rows.where(" and ".join(f"`{c}` is not null" for c in [*features, target]))
    aggs = [F.count("*").alias("n"), F.sum(target).alias("y")]
    aggs += [F.sum(c).alias(f"x{i}") for i, c in enumerate(features)]
    aggs += [F.sum(F.col(c) * F.col(target)).alias(f"xy{i}") for i, c in enumerate(features)]
    aggs += [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"xx{i}_{j}") for i, j in combinations_with_replacement(range(len(features)), 2)]
    return both.groupBy("session_index", "label_end").agg(*aggs)


def fold_totals(rows: DataFrame, folds: DataFrame, features: list[str], target: str, embargo: int) -> DataFrame:
    """Gram sums of every expanding fold's purged training rows: one row a fold.

    Sums per session are joined to the folds they train, so the panel is read once.
    """
    sums = gram_sums(rows, features, target)
    names = [c for c in sums.columns if c not in ("session_index", "label_end")]
    purged = (F.col("session_index") < F.col("test_start")) & (F.col("label_end") < F.col("test_start") - embargo)
    return sums.join(F.broadcast(folds.select("fold", "test_start")), purged).groupBy("fold").agg(*[F.sum(c).alias(c) for c in names])


def _moments(r: dict, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, standardised cross products and right side of a fold's sums, and the features' scales."""
    n, mean = r["n"], np.array([r[f"x{i}"] for i in range(p)]) / r["n"]
    cross = np.array([[r[f"xx{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) - n * np.outer(mean, mean)
    side = np.array([r[f"xy{i}"] for i in range(p)]) - mean * r["y"]
    scale = np.sqrt(np.maximum(np.diag(cross) / n, 0))
    scale[scale <= 1e-12 * (1 + np.abs(mean))] = 1.0
    return mean, cross / np.outer(scale, scale), side / scale, scale


def _ridge(r: dict, p: int, alpha: float) -> tuple[float, list[float]]:
    mean, cross, side, scale = _moments(r, p)
    w = np.linalg.solve(cross + alpha * np.eye(p), side) / scale if p else np.zeros(0)
    return float(r["y"] / r["n"] - w @ mean), w.tolist()


def ridge(rows: DataFrame, folds: DataFrame, features: list[str], target: str, alpha: float, embargo: int) -> DataFrame:
    """Ridge on standardised features for every expanding fold: fold, n, intercept, coefficients."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(r["fold"], r["n"], *_ridge(r, len(features), alpha)) for r in frame.to_dict("records")]
        return pd.DataFrame(out, columns=["fold", "n", "intercept", "coefficients"])

    return fold_totals(rows, folds, features, target, embargo).groupBy("fold").applyInPandas(solve, "fold int, n long, intercept double, coefficients array<double>")


def ridge_pair(rows: DataFrame, folds: DataFrame, baseline: list[str], score: str, target: str, alpha: float, embargo: int) -> DataFrame:
    """Ridge on ``baseline`` and on ``baseline`` plus ``score``, both fitted on the rows that have all of them.

    Per fold: n, baseline_intercept, baseline_coefficients, augmented_intercept,
    augmented_coefficients. Both fits use the same sums. Without baseline features the
    baseline is 0.
    """
    kinds = "fold int, n long, baseline_intercept double, baseline_coefficients array<double>, augmented_intercept double, augmented_coefficients array<double>"

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.to_dict("records"):
            base = _ridge(r, len(baseline), alpha) if baseline else (0.0, [])
            out.append((r["fold"], r["n"], *base, *_ridge(r, len(baseline) + 1, alpha)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in kinds.split(", ")])

    return fold_totals(rows, folds, [*baseline, score], target, embargo).groupBy("fold").applyInPandas(solve, kinds)


def predict_pair(rows: DataFrame, models: DataFrame, baseline: list[str], score: str) -> DataFrame:
    """Rows (with fold) and the predictions ``baseline`` and ``augmented`` of a ridge pair; models are a row a fold."""
    dot = lambda cs, w: sum((F.col(c) * F.get(w, F.lit(i)) for i, c in enumerate(cs)), F.lit(0.0))
    out = rows.join(F.broadcast(models.drop("n")), "fold")
    out = out.withColumn("__b", F.col("baseline_intercept") + dot(baseline, "baseline_coefficients")).withColumn("augmented", F.col("augmented_intercept") + dot([*baseline, score], "augmented_coefficients"))
    return out.drop("baseline_intercept", "baseline_coefficients", "augmented_intercept", "augmented_coefficients").withColumnRenamed("__b", "baseline")


def predict_linear(rows: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """Rows (with fold) and their linear prediction; models are a few rows."""
    x = F.array(*[F.col(c) for c in features])
    dot = F.aggregate(F.zip_with(x, "coefficients", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.join(F.broadcast(models.select("fold", "intercept", "coefficients")), "fold").withColumn("prediction", F.col("intercept") + dot).drop("intercept", "coefficients")


def ridge_without_intercept(rows: DataFrame, features: list[str], target: str, penalty: float, *by: str) -> DataFrame:
    """Minimiser of mean squared error + penalty x |w|^2 per group, no intercept: coefficients."""
    p = len(features)
    aggs = [F.count("*").alias("n")]
    aggs += [F.sum(F.col(c) * F.col(target)).alias(f"xy{i}") for i, c in enumerate(features)]
    aggs += [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"xx{i}_{j}") for i, j in combinations_with_replacement(range(p), 2)]
    both = rows.where(" and ".join(f"`{c}` is not null" for c in [*features, target]))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.to_dict("records"):
            xx = np.array([[r[f"xx{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / r["n"]
            w = np.linalg.solve(xx + penalty * np.eye(p), np.array([r[f"xy{i}"] for i in range(p)]) / r["n"])
            out.append((*[r[b] for b in by], w.tolist()))
        return pd.DataFrame(out, columns=[*by, "coefficients"])

    schema = ", ".join(f"{b} {dict(rows.dtypes)[b]}" for b in by) + ", coefficients array<double>"
    return both.groupBy(*by).agg(*aggs).groupBy(*by).applyInPandas(solve, schema)


def elastic_net(rows: DataFrame, folds: DataFrame, features: list[str], target: str, alpha: float, embargo: int, l1_ratio: float = 0.5, rounds: int = 1000) -> DataFrame:
    """Elastic net on standardised features for every expanding fold: fold, n, intercept, coefficients.

    Minimises |y - Xw|^2 / 2n + alpha (l1 |w| + (1 - l1) |w|^2 / 2) by coordinate descent on
    the folds' sums, so rows are read once and the descent sees one small matrix a fold.
    """
    p = len(features)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.to_dict("records"):
            mean, cross, side, scale = _moments(r, p)
            cross, side, w = cross / r["n"], side / r["n"], np.zeros(p)
            for _ in range(rounds):
                before = w.copy()
                for j in range(p):
                    if cross[j, j] > 0:
                        pull = side[j] - cross[j] @ w + cross[j, j] * w[j]
                        w[j] = np.sign(pull) * max(abs(pull) - alpha * l1_ratio, 0) / (cross[j, j] + alpha * (1 - l1_ratio))
                if np.abs(w - before).max() < 1e-12:
                    break
            w = w / scale
            out.append((r["fold"], r["n"], float(r["y"] / r["n"] - w @ mean), w.tolist()))
        return pd.DataFrame(out, columns=["fold", "n", "intercept", "coefficients"])

    return fold_totals(rows, folds, features, target, embargo).groupBy("fold").applyInPandas(solve, "fold int, n long, intercept double, coefficients array<double>")


def bucket_model(rows: DataFrame, value: str, states: int, *by: str) -> DataFrame:
    """Baseline state model: mean of each rank bucket, and the sample variance of all values."""
    over = Window.partitionBy(*by)
    known = rows.where(F.col(value).isNotNull())
    r, n = F.row_number().over(over.orderBy(value, "session_index")), F.count("*").over(over)
    bucket = F.floor((r * states - 1) / n).cast("int")
    spread = F.greatest(F.var_samp(value).over(over), F.lit(1e-8))
    return known.withColumn("state", bucket).withColumn("__v", spread).groupBy(*by, "state").agg(F.avg(value).alias("mean"), F.max("__v").alias("variance"), F.count("*").alias("n"))


def filter_states(series: DataFrame, means: list[float], variances: list[float], stay: float, *by: str, chunk: int = 4096) -> DataFrame:
    """Filtered probabilities along each series with a sticky transition, from equal ones before the first session.

    A step is a product with transition x emissions, so steps are associative: a series is cut into
    runs of ``chunk`` session numbers, every run but the last becomes one states x states matrix (scaled to a greatest entry of 1), a
    series' matrices give the probabilities that each run begins with, and runs are then filtered side by side.
    The rows are written once. A task steps the runs of a batch together and keeps one state between batches; where no series
    has two runs, nothing but that pass over the rows is done.
    """
    k = len(means)
    move = np.full((k, k), (1 - stay) / max(k - 1, 1))
    np.fill_diagonal(move, stay)
    mean, variance = np.array(means), np.array(variances)
    run = F.floor(F.col("session_index") / chunk).cast("long")
    rows = stored(series.where("session_index is not null").select(*by, "session_index", "value", run.alias("__run")))
    keys = ", ".join(f"`{c}` {t}" for c, t in series.select(*by).dtypes)
    index = dict(series.dtypes)["session_index"]

    def emissions(x: np.ndarray) -> np.ndarray:
        log = -((x[:, None] - mean) ** 2) / (2 * variance) - 0.5 * np.log(variance)
        return np.exp(log - log.max(axis=1, keepdims=True))

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("session_index", kind="stable")
        whole = np.eye(k)
        for emit in emissions(frame["value"].to_numpy(float)):
            whole = (whole @ move) * emit
            whole /= whole.max()
        return frame[[*by, "__run"]].head(1).assign(matrix=[whole.ravel().tolist()])

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        frame, p, out = frame.sort_values("__run"), np.full(k, 1 / k), []
        for matrix in frame["matrix"]:
            out.append(p.tolist())
            if matrix is not None:
                p = p @ np.array(matrix).reshape(k, k)
                p /= p.sum()
        return frame[[*by, "__run"]].assign(first=out)

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = np.full(k, 1 / k)
        for frame in frames:
            if not len(frame):
                continue
            nth, first = frame["__n"].to_numpy(), frame["first"]
            start = np.union1d(0, np.flatnonzero(nth == 1))
            state = np.full((len(start), k), 1 / k)
            if nth[0] != 1:
                state[0] = p  # the run goes on from the batch before
            size = np.diff(np.append(start, len(frame)))
            given = first.iloc[start].notna().to_numpy()
            if given.any():
                state[given] = np.stack(first.iloc[start[given]].to_list())
            at, left = start + given, size - given
            out = emissions(frame["value"].to_numpy(float))
            order = np.argsort(-left, kind="stable")
            for t in range(left.max()):
                live = order[: np.searchsorted(-left[order], -t)]
                q = (state[live] @ move) * out[at[live] + t]
                state[live] = out[at[live] + t] = q / q.sum(axis=1, keepdims=True)
            p = state[-1].copy()
            yield frame[[*by, "session_index"]].assign(probabilities=out.tolist())[first.isna().to_numpy()]

    marked = rows.withColumn("first", F.lit(None).cast("array<double>"))
    ends = rows.agg(F.min("__run").alias("lo"), F.max("__run").alias("hi")).first()
    if ends["lo"] != ends["hi"]:
        runs = stored(rows.groupBy(*by, "__run").agg(F.count("*").alias("__rows")))
        last = runs.groupBy(*by).agg(F.max("__run").alias("__last"))
        matrices = rows.join(last.hint("merge"), [*by]).where("__run < __last").drop("__last").groupBy(*by, "__run").applyInPandas(product, f"{keys}, __run long, matrix array<double>")
        firsts = runs.drop("__rows").join(matrices.hint("merge"), [*by, "__run"], "left").groupBy(*by).applyInPandas(begin, f"{keys}, __run long, first array<double>")
        # what a run begins with is a row before its own
        marked = marked.unionByName(firsts, allowMissingColumns=True)
    order = Window.partitionBy(*by, "__run").orderBy(F.asc_nulls_first("session_index"))
    marked = marked.withColumn("__n", F.row_number().over(order)).select(*by, "session_index", "value", "first", "__n")
    return marked.mapInPandas(steps, f"{keys}, session_index {index}, probabilities array<double>")


def centroid_states(rows: DataFrame, value: str, states: int, *by: str) -> DataFrame:
    """Soft assignment to order-statistic centroids: softmax of negative squared distance."""
    order = Window.partitionBy(*by).orderBy(value, "session_index")
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = rows.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(order)).withColumn("__n", n)
    marks = [F.max(F.when(F.col("__r") == F.floor(F.lit((2 * i + 1) / (2 * states)) * F.col("__n")) + 1, F.col(value))).over(Window.partitionBy(*by)) for i in range(states)]
    centred = ranked.withColumn("centroids", F.array(*marks))
    scores = F.transform("centroids", lambda c: -(F.col(value) - c) * (F.col(value) - c))
    return centred.withColumn("probabilities", softmax(scores)).drop("__r", "__n")


def standardise(train: DataFrame, rows: DataFrame, features: list[str], by: str = "fold") -> DataFrame:
    """Rows scaled by their fold's training mean and population deviation (0 counts as 1)."""
    sums = train.groupBy(by).agg(*[f(c).alias(f"__{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = rows.join(F.broadcast(sums), by)
    for c in features:
        deviation = F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
        out = out.withColumn(c, (F.col(c) - F.col(f"__m_{c}")) / deviation)
    return out.drop(*[f"__{k}_{c}" for c in features for k in "ms"])


def ensemble(scores: DataFrame) -> DataFrame:
    """Equal-weight mean of the models' scores per session and asset."""
    return scores.groupBy("session_index", "asset").agg(F.avg("score").alias("score"))


def market_features(panel: DataFrame, price: str, window: int, min_assets: int) -> DataFrame:
    """Equal-weight return, its trailing mean and population deviation; full windows of known sessions."""
    by = Window.partitionBy("asset").orderBy("session_index")
    before = F.lag(price).over(by)
    both = F.col("eligible") & F.lag("eligible").over(by)
    moved = panel.withColumn("__r", F.when(both & (before > 0), F.try_divide(F.col(price), before) - 1))
    daily = moved.groupBy("session_index").agg(F.avg("__r").alias("market_return"), F.count("__r").alias("n_assets"))
    daily = daily.withColumn("market_return", F.when(F.col("n_assets") >= min_assets, F.col("market_return")))
    return series_features(daily, "market_return", "session_index", window)


def series_features(series: DataFrame, value: str, order: str, window: int) -> DataFrame:
    """Trailing mean and population deviation of one series over full windows."""
    over = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(-(window - 1), 0)
    full = F.count(value).over(over) == window
    return series.withColumn("trailing_mean", F.when(full, F.avg(value).over(over))).withColumn("trailing_deviation", F.when(full, F.stddev_pop(value).over(over)))


def runs(df: DataFrame, index: str, *by: str) -> DataFrame:
    """Runs of consecutive index values: first, last and length."""
    island = F.col(index) - F.row_number().over(Window.partitionBy(*(by or (F.lit(0),))).orderBy(index))
    return df.withColumn("__island", island).groupBy(*by, "__island").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("length")).drop("__island")


def training_suffix(features: DataFrame, value: str, last_train: int) -> DataFrame:
    """Sessions up to ``last_train`` after the last one there whose value is missing."""
    upto = features.where(F.col("session_index") <= last_train)
    gap = F.max(F.when(F.col(value).isNull(), F.col("session_index"))).over(Window.partitionBy(F.lit(0)))
    return upto.withColumn("__gap", F.coalesce(gap, F.lit(-1))).where(F.col("session_index") > F.col("__gap")).drop("__gap")
