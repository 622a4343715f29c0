"""Latent market states per walk-forward fold: fit on the past, filter forward, report every fold.

A fold fits on the contiguous sessions with all features that end at its ``train_end``, so a
transition always means one session. Later sessions only filter. One group holds one row a session, and a report has
one row for every method and fold, whatever happened:

    ok             fitted to the tolerance
    not_converged  fitted, but the likelihood still moved (or fell) when the rounds ended
    insufficient   fewer than max(20, 5 x states) contiguous training sessions
    missing        no features at all, none measured, or some lacking between training and the last measured session
    unavailable    the numbers broke down (the diagnostic says how)

A session without features moves the states by the transition alone (a masked step) where
states are filtered for their own sake, and is disclosed in reports.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import conditional_ic

METHODS = ("hmm", "gaussian_mixture")
FLOOR = 1e-4


@dataclass
class Fit:
    """Diagonal Gaussian states by rising first mean, in standardised units, and how the fit ended."""

    start: np.ndarray
    move: np.ndarray | None
    mean: np.ndarray
    variance: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    history: list[float] = field(default_factory=list)
    tolerance: float = 0.0
    most: int = 0

    @property
    def iterations(self) -> int:
        return len(self.history)

    @property
    def converged(self) -> bool:
        """The last round raised the log-likelihood by less than the tolerance; running out of rounds or falling is not that."""
        return len(self.history) > 1 and 0 <= self.history[-1] - self.history[-2] < self.tolerance

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return -0.5 * ((z[:, None, :] - self.mean) ** 2 / self.variance + np.log(2 * np.pi * self.variance)).sum(axis=2)


def _begin(x: np.ndarray, states: int, tolerance: float, most: int) -> tuple[Fit, np.ndarray, np.ndarray]:
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - centre) / scale
    bucket = np.minimum(np.argsort(np.argsort(z[:, 0], kind="stable"), kind="stable") * states // len(z), states - 1)
    nothing = np.zeros((states, x.shape[1]))
    return Fit(np.full(states, 1 / states), None, nothing, nothing, centre, scale, [], tolerance, most), z, np.eye(states)[bucket]


def _moments(fit: Fit, z: np.ndarray, post: np.ndarray) -> np.ndarray:
    mass = np.maximum(post.sum(axis=0), 1e-9)
    fit.mean = post.T @ z / mass[:, None]
    fit.variance = np.maximum(np.stack([post[:, k] @ (z - fit.mean[k]) ** 2 / mass[k] for k in range(len(mass))]), FLOOR)
    return mass


def _sorted(fit: Fit) -> Fit:
    order = np.argsort(fit.mean[:, 0], kind="stable")
    fit.start, fit.mean, fit.variance = fit.start[order], fit.mean[order], fit.variance[order]
    fit.move = None if fit.move is None else fit.move[np.ix_(order, order)]
    return fit


def fit_mixture(x: np.ndarray, states: int, most: int = 200, tolerance: float = 1e-3) -> Fit:
    """Gaussian mixture by EM from rank buckets of the first column; tolerance on the mean log-likelihood."""
    fit, z, post = _begin(x, states, tolerance, most)
    while True:
        mass = _moments(fit, z, post)
        fit.start = mass / mass.sum()
        joint = fit.log_emissions(x) + np.log(fit.start)
        top = joint.max(axis=1, keepdims=True)
        level = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
        fit.history.append(float(level.mean()))
        post = np.exp(joint - level)
        if fit.iterations >= most or (fit.iterations > 1 and fit.history[-1] - fit.history[-2] < tolerance):
            return _sorted(fit)


def fit_hmm(x: np.ndarray, states: int, most: int = 100, tolerance: float = 1e-2) -> Fit:
    """Hidden Markov model by Baum-Welch from rank buckets of the first column; tolerance on the log-likelihood."""
    fit, z, post = _begin(x, states, tolerance, most)
    _moments(fit, z, post)
    fit.move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(fit.move, 0.9 if states > 1 else 1.0)
    while True:
        forward, scale, emit, level = forward_steps(fit, fit.log_emissions(x))
        fit.history.append(level)
        back, pairs = np.ones_like(forward), np.zeros((states, states))
        for t in range(len(z) - 2, -1, -1):
            right = emit[t + 1] * back[t + 1] / scale[t + 1]
            pairs += np.outer(forward[t], right)
            back[t] = fit.move @ right
        if fit.iterations >= most or (fit.iterations > 1 and fit.history[-1] - fit.history[-2] < tolerance):
            return _sorted(fit)
        post = forward * back
        post /= post.sum(axis=1, keepdims=True)
        pairs = np.maximum(pairs * fit.move, 1e-300)
        fit.start, fit.move = post[0], pairs / pairs.sum(axis=1, keepdims=True)
        _moments(fit, z, post)


def forward_steps(fit: Fit, log: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Filtered probabilities, each step's scale, shifted emissions and the log-likelihood; a row of NaN is a masked step."""
    known = np.isfinite(log).all(axis=1)
    top = np.where(known, np.where(known[:, None], log, 0).max(axis=1), 0.0)
    emit = np.where(known[:, None], np.exp(np.where(known[:, None], log, 0) - top[:, None]), 1.0)
    out, scale, p = np.empty_like(emit), np.empty(len(emit)), fit.start
    for t in range(len(emit)):
        a = emit[t] * (p if t == 0 else p @ fit.move)
        scale[t] = a.sum()
        p = out[t] = a / scale[t]
    return out, scale, emit, float(np.log(scale).sum() + top.sum())


def filtered(fit: Fit, x: np.ndarray) -> np.ndarray:
    """State probabilities of consecutive sessions, each from its past alone; NaN rows have none in a mixture."""
    if fit.move is not None:
        return forward_steps(fit, fit.log_emissions(x))[0]
    joint = fit.log_emissions(x) + np.log(fit.start)
    joint -= joint.max(axis=1, keepdims=True)
    return np.exp(joint) / np.exp(joint).sum(axis=1, keepdims=True)


def with_train_end(folds: DataFrame, horizon: int, embargo: int) -> DataFrame:
    """Folds with the last session whose label, ``horizon`` + 1 sessions on, ends before the test less the embargo."""
    return folds.withColumn("train_end", F.col("test_start") - embargo - horizon - 2)


def _grid(features: DataFrame, folds: DataFrame, names: list[str], methods: tuple[str, ...]) -> DataFrame:
    """Every method and fold with the sessions up to the fold's end; one row without a session where there is none."""
    spans = folds.select("fold", "train_end", "test_start", "test_end").withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    rows = features.select("session_index", *[F.col(n).cast("double").alias(n) for n in names])
    # a row a session on either side
    return spans.join(rows, F.col("session_index") <= F.col("test_end"), "left")


def _suffix(known: np.ndarray, end: int) -> int:
    """First session of the contiguous known ones that end at ``end`` (from 1); ``end`` + 1 if it lacks features."""
    start = end + 1
    while start > 1 and known[start - 1]:
        start -= 1
    return start


def _series(frame: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Features by session number, which are known, the last training session and the last of the test."""
    end, last = int(frame["train_end"].iloc[0]), int(frame["test_end"].iloc[0])
    x = np.full((max(last, end) + 1, len(names)), np.nan)
    rows = frame[frame["session_index"].notna()]
    x[rows["session_index"].astype(int)] = rows[names].to_numpy(float)
    return x, np.isfinite(x).all(axis=1), end, last


FITTERS: dict[str, Callable[..., Fit]] = {"hmm": fit_hmm, "gaussian_mixture": fit_mixture}


def fold_states(features: DataFrame, folds: DataFrame, names: list[str], states: int, method: str) -> DataFrame:
    """fold, session_index, probabilities from the fold's first training session to its test's end; folds that cannot be fitted give none."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, known, end, last = _series(frame, names)
        start, out = _suffix(known, end), []
        if end + 1 - start >= max(20, 5 * states):
            fit = FITTERS[method](x[start : end + 1], states)
            out = [(frame["fold"].iloc[0], start + k, p.tolist() if np.isfinite(p).all() else None) for k, p in enumerate(filtered(fit, x[start : last + 1]))]
        return pd.DataFrame(out, columns=["fold", "session_index", "probabilities"])

    return _grid(features, folds, names, (method,)).groupBy("fold").applyInPandas(run, "fold int, session_index int, probabilities array<double>")


def fold_parameters(features: DataFrame, folds: DataFrame, names: list[str], states: int, method: str = "hmm") -> DataFrame:
    """Start, mean, deviation and stay of every state of every fold that can be fitted, and how the fit ended."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, known, end, _ = _series(frame, names)
        start, out = _suffix(known, end), []
        if end + 1 - start >= max(20, 5 * states):
            fit = FITTERS[method](x[start : end + 1], states)
            for k in range(states):
                mean, deviation = fit.mean[k] * fit.scale + fit.centre, np.sqrt(fit.variance[k]) * fit.scale
                stay = float(fit.move[k, k]) if fit.move is not None else None
                out.append((frame["fold"].iloc[0], k, float(fit.start[k]), stay, mean.tolist(), deviation.tolist(), fit.converged, fit.iterations))
        return pd.DataFrame(out, columns=["fold", "state", "start", "stay", "mean", "deviation", "converged", "iterations"])

    kinds = "fold int, state int, start double, stay double, mean array<double>, deviation array<double>, converged boolean, iterations int"
    return _grid(features, folds, names, (method,)).groupBy("fold").applyInPandas(run, kinds)


REPORT = "method string, fold int, status string, diagnostic string, train_first int, train_last int, n_train int, missing_sessions array<int>, converged boolean, iterations int, iteration_limit_reached boolean, probabilities array<struct<session_index:int,probabilities:array<double>>>"


def fold_reports(features: DataFrame, folds: DataFrame, measured: DataFrame, names: list[str], states: int, methods: tuple[str, ...] = METHODS, most: int | None = None) -> DataFrame:
    """One row per method and fold (REPORT); probabilities are those of the fold's ``measured`` (fold, session_index) sessions."""
    days = measured.groupBy("fold").agg(F.sort_array(F.collect_set("session_index")).alias("measured"))
    rows = _grid(features, folds, names, methods).join(days, "fold", "left")
    options = {} if most is None else {"most": most}

    def report(frame: pd.DataFrame) -> dict:
        first = frame.iloc[0]
        x, known, end, last = _series(frame, names)
        start = _suffix(known, end)
        found = first["measured"]
        inside = [] if found is None else [int(t) for t in found if int(first["test_start"]) <= t <= last]
        reach = inside[-1] if inside else last
        lacking = [t for t in range(end + 1, reach + 1) if not known[t]]
        out = {"method": first["method"], "fold": int(first["fold"]), "train_first": start, "train_last": end, "n_train": end + 1 - start, "missing_sessions": lacking}
        if not known.any():
            return out | {"status": "missing", "diagnostic": "No session has features."}
        if end + 1 - start < max(20, 5 * states):
            return out | {"status": "insufficient", "diagnostic": f"{end + 1 - start} contiguous training sessions, {max(20, 5 * states)} are needed."}
        if not inside:
            return out | {"status": "missing", "diagnostic": "No session of the test is measured."}
        if lacking:
            return out | {"status": "missing", "diagnostic": f"{len(lacking)} sessions between training and the last measured one lack features."}
        try:
            with np.errstate(invalid="raise", divide="raise", over="raise"):
                fit = FITTERS[first["method"]](x[start : end + 1], states, **options)
                p = filtered(fit, x[start : reach + 1])[np.array(inside) - start]
            if not np.isfinite(p).all():
                raise FloatingPointError("probabilities are not finite")
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as broken:
            return out | {"status": "unavailable", "diagnostic": f"{type(broken).__name__}: {broken}"}
        ended = {"converged": fit.converged, "iterations": fit.iterations, "iteration_limit_reached": fit.iterations >= fit.most}
        states_of = [{"session_index": t, "probabilities": q.tolist()} for t, q in zip(inside, p, strict=True)]
        return out | ended | {"status": "ok" if fit.converged else "not_converged", "diagnostic": None, "probabilities": states_of}

    columns = [c.split()[0] for c in REPORT.replace("array<struct<session_index:int,probabilities:array<double>>>", "x").split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = report(frame)
        return pd.DataFrame([[found.get(c) for c in columns]], columns=columns, dtype=object)

    return rows.groupBy("method", "fold").applyInPandas(run, REPORT)


def walk_forward(reports: DataFrame, daily: DataFrame) -> DataFrame:
    """``reports`` (written) with ``conditional``: per state its raw, baseline, augmented and incremental coefficient and effective days.

    ``daily`` has fold, session_index, series (raw, baseline, augmented) and ic. Reports
    without probabilities keep their row with none.
    """
    p = reports.select("method", "fold", F.explode("probabilities").alias("p")).select("method", "fold", "p.*")
    found = conditional_ic(daily.join(p, ["fold", "session_index"]), "method", "fold", "series")
    of = lambda name: F.max(F.when(F.col("series") == name, F.col("ic")))
    states = found.groupBy("method", "fold", "state").agg(of("raw").alias("raw"), of("baseline").alias("baseline"), of("augmented").alias("augmented"), F.max("effective_days").alias("effective_days"))
    states = states.withColumn("incremental", F.col("augmented") - F.col("baseline"))
    row = F.struct("state", "raw", "baseline", "augmented", "incremental", "effective_days")
    return reports.drop("probabilities").join(states.groupBy("method", "fold").agg(F.sort_array(F.collect_list(row)).alias("conditional")), ["method", "fold"], "left")
