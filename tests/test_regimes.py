"""Regime fits, masked filters and every status of the report."""

import numpy as np
import pytest
from tidemark.operators import regimes

NAMES = ["x", "y"]
FOLD = "fold int, train_end int, test_start int, test_end int"


def series(n=120, seed=2):
    """Two regimes of 20 sessions each in turn."""
    rng = np.random.default_rng(seed)
    high = np.arange(n)[:, None] // 20 % 2
    x = np.where(high, rng.normal(4, 0.5, (n, 2)), rng.normal(0, 1, (n, 2)))
    return [(t + 1, float(v[0]), float(v[1])) for t, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "session_index int, x double, y double")


def test_states_follow_the_regimes_and_look_only_back(spark):
    spans = spark.createDataFrame([(0, 80, 85, 100), (1, 100, 105, 120)], FOLD)
    for method in regimes.METHODS:
        got = {(r["fold"], r["session_index"]): r["probabilities"] for r in regimes.fold_states(frame(spark, series()), spans, NAMES, 2, method).collect()}
        assert len(got) == 100 + 120
        assert all((p[1] > 0.9) == ((t - 1) // 20 % 2 == 1) for (_, t), p in got.items() if (t - 1) % 20 > 1)
        changed = [r if r[0] <= 90 else (r[0], -50.0, 7.0) for r in series()]
        other = {(r["fold"], r["session_index"]): r["probabilities"] for r in regimes.fold_states(frame(spark, changed), spans, NAMES, 2, method).collect()}
        assert all(got[0, t] == other[0, t] for t in range(1, 91))


def test_masked_steps(spark):
    """A session without features moves the states by the transition; the next one starts from there."""
    rows = series()
    gap = [r if r[0] not in (95, 96) else (r[0], None, r[2]) for r in rows if r[0] != 97]
    spans = spark.createDataFrame([(0, 80, 85, 110)], FOLD)
    got = {r["session_index"]: np.array(r["probabilities"]) for r in regimes.fold_states(frame(spark, gap), spans, NAMES, 2, "hmm").collect()}
    x = np.array([r[1:] for r in rows])
    fit = regimes.fit_hmm(x[:80], 2)
    p = got[94]
    for t in (95, 96, 97):
        p = p @ fit.move
        assert np.allclose(got[t], p, atol=1e-12)
    a = np.exp(fit.log_emissions(x[97:98])[0]) * (p @ fit.move)
    assert np.allclose(got[98], a / a.sum(), atol=1e-12)
    mixture = {r["session_index"]: r["probabilities"] for r in regimes.fold_states(frame(spark, gap), spans, NAMES, 2, "gaussian_mixture").collect()}
    assert mixture[95] is None and mixture[97] is None and mixture[98] is not None


def test_parameters_find_the_states(spark):
    spans = spark.createDataFrame([(0, 120, 121, 120), (1, 12, 13, 14)], FOLD)
    got = regimes.fold_parameters(frame(spark, series()), spans, NAMES, 2).orderBy("state").collect()
    assert [r["fold"] for r in got] == [0, 0] and got[0]["converged"] and got[0]["iterations"] > 1
    assert np.allclose(got[0]["mean"], [0, 0], atol=0.4) and np.allclose(got[1]["mean"], [4, 4], atol=0.3)
    assert np.allclose(got[0]["deviation"], [1, 1], atol=0.3) and np.allclose(got[1]["deviation"], [0.5, 0.5], atol=0.2)
    assert all(r["stay"] > 0.8 for r in got)


def test_likelihood_rises_and_equals_enumeration():
    x = np.array([r[1:] for r in series(60)])
    for fitter in regimes.FITTERS.values():
        fit = fitter(x, 2)
        assert (np.diff(fit.history) > -1e-9).all() and fit.converged
        assert not fitter(x, 2, most=1).converged
    fit = regimes.fit_hmm(x[:40], 2)
    log = fit.log_emissions(x[:6])
    log[2] = np.nan
    total, last = 0.0, np.zeros(2)
    for path in np.ndindex(*[2] * 6):
        p = fit.start[path[0]] * np.prod([fit.move[a, b] for a, b in zip(path, path[1:])]) * np.exp(sum(log[t, s] for t, s in enumerate(path) if t != 2))
        total += p
        last[path[-1]] += p
    out, _, _, level = regimes.forward_steps(fit, log)
    assert np.allclose(level, np.log(total)) and np.allclose(out[-1], last / total)


@pytest.fixture(scope="module")
def reports(spark):
    """Folds that end in each way."""
    rows = {r[0]: r for r in series(200)}
    rows[60] = (60, None, 1.0)  # cuts fold 1's training to 70 .. 61
    del rows[131]  # lacks between training and test of fold 3
    spans = [(0, 50, 55, 59), (1, 70, 75, 80), (2, 100, 105, 110), (3, 130, 135, 140), (4, 160, 165, 170), (5, 180, 185, 190)]
    measured = [(f, t) for f, _, a, b in spans if f != 4 for t in range(a + 1, b)] + [(0, 9), (3, 150)]
    f = spark.createDataFrame(spans, FOLD)
    m = spark.createDataFrame(measured, "fold int, session_index int")
    out = regimes.fold_reports(frame(spark, list(rows.values())), f, m, NAMES, 2).collect()
    return {(r["method"], r["fold"]): r for r in out}, f, m


def test_every_method_and_fold_has_a_row(reports):
    got = reports[0]
    assert set(got) == {(m, f) for m in regimes.METHODS for f in range(6)}
    for m in regimes.METHODS:
        assert [got[m, f]["status"] for f in range(6)] == ["ok", "insufficient", "ok", "missing", "missing", "ok"]
        assert (got[m, 1]["train_first"], got[m, 1]["train_last"], got[m, 1]["n_train"]) == (61, 70, 10)
        assert (got[m, 2]["train_first"], got[m, 2]["n_train"]) == (61, 40) and got[m, 2]["missing_sessions"] == []
        assert got[m, 3]["missing_sessions"] == [131] and got[m, 3]["probabilities"] is None
        assert "measured" in got[m, 4]["diagnostic"]
        assert [p["session_index"] for p in got[m, 0]["probabilities"]] == [56, 57, 58]
        assert all(abs(sum(p["probabilities"]) - 1) < 1e-9 for p in got[m, 5]["probabilities"])
        assert got[m, 0]["converged"] and got[m, 0]["iterations"] > 1 and not got[m, 0]["iteration_limit_reached"]


def test_not_converged_unavailable_and_no_features(spark, reports):
    _, f, m = reports
    two = spark.createDataFrame([(0, 50, 55, 59)], FOLD)
    short = regimes.fold_reports(frame(spark, series(200)), two, m, NAMES, 2, most=2).collect()
    assert {r["status"] for r in short} == {"not_converged"} and all(r["iterations"] == 2 and r["iteration_limit_reached"] and r["probabilities"] for r in short)
    wild = [(t, x * 1e200 if t % 2 else x, y) for t, x, y in series(60)]
    broken = regimes.fold_reports(frame(spark, wild), two, m, NAMES, 2).collect()
    assert {r["status"] for r in broken} == {"unavailable"} and all(r["diagnostic"] for r in broken)
    none = regimes.fold_reports(frame(spark, []), f, m, NAMES, 2).collect()
    assert len(none) == 12 and {r["status"] for r in none} == {"missing"}
    assert regimes.fold_reports(frame(spark, series(60)), f.limit(0), m, NAMES, 2).count() == 0


def test_conditional_coefficients(spark):
    p = [(t, [0.25, 0.75]) for t in range(4)]
    rows = [("hmm", 0, "ok", None, 1, 2, 2, [], True, 3, False, p), ("mix", 1, "missing", "why", 1, 2, 2, [7], None, None, None, None)]
    daily = [(0, t, s, c * t) for t in range(4) for s, c in (("raw", 0.1), ("baseline", 0.2), ("augmented", 0.5))]
    got = regimes.walk_forward(spark.createDataFrame(rows, regimes.REPORT), spark.createDataFrame(daily, "fold int, session_index int, series string, ic double")).orderBy("fold").collect()
    assert got[1]["status"] == "missing" and got[1]["conditional"] is None and got[1]["diagnostic"] == "why"
    for k, c in enumerate(got[0]["conditional"]):
        assert c["state"] == k and np.allclose([c["raw"], c["baseline"], c["augmented"], c["incremental"], c["effective_days"]], [0.15, 0.3, 0.75, 0.45, 4])
