"""Allocation, models, sessions, ledgers and streams on small fixtures."""

import datetime
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import allocation, folds, ledger, models, sessions
from tidemark.sources import tables as T


def test_purge_by_label_end(spark):
    panel = spark.createDataFrame([(t, "a", 0.1, t + 2) for t in range(1, 41)], "session_index int, asset string, label double, label_end int")
    f = folds.evaluator_folds(spark, 40, 20, 10, 1, 1)
    train = folds.train_rows(panel, f, 1).collect()
    assert train and all(r["label_end"] < r["test_start"] - 1 for r in train)
    assert {(r["test_start"], r["test_end"]) for r in f.collect()} == {(24, 33), (34, 40)}


def fixture(spark, n=60, assets=8, seed=91):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(1, n + 1):
        for i in range(assets):
            x, z = rng.normal(size=2)
            rows.append((t, f"a{i}", float(x), float(z), float(0.1 * x + 0.1 * z + 0.02 * rng.normal()), t + 2))
    return spark.createDataFrame(rows, "session_index int, asset string, x double, z double, y double, label_end int")


def test_ridge_matches_numpy(spark):
    panel, f = fixture(spark), folds.evaluator_folds(spark, 60, 30, 10, 1, 1)
    got = {r["fold"]: r for r in models.ridge(panel, f, ["x", "z"], "y", 2.0, 1).collect()}
    data = panel.toPandas()
    for r in f.collect():
        t = data[(data["session_index"] < r["test_start"]) & (data["label_end"] < r["test_start"] - 1)]
        x = t[["x", "z"]].to_numpy()
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        w = np.linalg.solve(z.T @ z + 2 * np.eye(2), z.T @ (t["y"] - t["y"].mean())) / x.std(axis=0)
        assert np.allclose(got[r["fold"]]["coefficients"], w) and got[r["fold"]]["n"] == len(t)


def test_future_rows_leave_earlier_fits_alone(spark):
    panel, f = fixture(spark), folds.evaluator_folds(spark, 60, 30, 10, 1, 1)
    changed = panel.withColumn("y", F.when(F.col("session_index") > 45, 9.0).otherwise(F.col("y")))
    fit = lambda p: [r["coefficients"] for r in models.ridge(p, f, ["x"], "y", 1.0, 1).orderBy("fold").collect()]
    assert fit(panel)[0] == fit(changed)[0]


def test_elastic_net_meets_its_optimality_conditions(spark):
    panel, f = fixture(spark), folds.evaluator_folds(spark, 60, 30, 10, 1, 1)
    got = {r["fold"]: r for r in models.elastic_net(panel, f, ["x", "z"], "y", 0.1, 1).collect()}
    data = panel.toPandas()
    for r in f.collect():
        t = data[(data["session_index"] < r["test_start"]) & (data["label_end"] < r["test_start"] - 1)]
        x, y = t[["x", "z"]].to_numpy(), t["y"].to_numpy()
        z, w = (x - x.mean(axis=0)) / x.std(axis=0), np.array(got[r["fold"]]["coefficients"]) * x.std(axis=0)
        pull = z.T @ (y - y.mean() - z @ w) / len(y) - 0.05 * w  # equals 0.05 times the sign, or lies within
        assert all(abs(p - 0.05 * np.sign(v)) < 1e-9 if v else abs(p) <= 0.05 + 1e-9 for p, v in zip(pull, w)) and w.any()


def test_incremental_evidence_of_a_known_and_a_repeated_factor(spark):
    from tidemark.operators import stats

    panel, f = fixture(spark).withColumn("flip", -F.col("x")), folds.evaluator_folds(spark, 60, 30, 10, 1, 1)
    test = folds.inference_rows(panel, f)
    series = {}
    for score in ("z", "flip"):
        fits = models.ridge_pair(panel, f, ["x"], score, "y", 1.0, 1)
        daily = stats.daily_series(models.predict_pair(test, fits, ["x"], score), score, "y")
        series[score] = daily.toPandas()
        evidence = stats.fold_evidence(daily, folds.train_rows(panel.withColumnRenamed("y", "label"), f, 1), f).orderBy("fold").collect()
        assert [(r["test_start"], r["test_end"], r["n_sessions"]) for r in evidence] == [(34, 43, 10), (44, 53, 10), (54, 60, 7)]
        assert all(r["last_label_end"] < r["test_start"] - 1 and r["n_train"] == 8 * r["train_end"] and r["n_test"] == 8 * r["n_sessions"] for r in evidence)
    assert series["z"]["incremental"].mean() > 0.15
    assert np.allclose(series["flip"]["incremental"], 0) and series["flip"]["raw"].mean() < 0 < series["flip"]["baseline"].mean()


def test_online_filter_equals_the_batch_filter(spark, tmp_path):
    from tidemark.streaming import books

    rng = np.random.default_rng(1)
    rows = [(b, t, float(v)) for b in (1, 2) for t, v in enumerate(rng.normal(size=30))]
    schema = "book_id long, step long, value double"
    for part in (rows[:40], rows[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = books.drain(books.online_filter(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), [-1.0, 1.0], 1.0, 0.9), str(tmp_path / "out")).collect()
    move = np.array([[0.9, 0.1], [0.1, 0.9]])
    for b in (1, 2):
        p = np.full(2, 0.5)
        mine = {r["step"]: r["probabilities"] for r in got if r["book_id"] == b}
        for _, t, v in [r for r in rows if r[0] == b]:
            p = (p @ move) * np.exp(-((v - np.array([-1.0, 1.0])) ** 2) / 2)
            p /= p.sum()
            assert np.allclose(mine[t], p)


def test_filtered_states(spark):
    rows = [("s", t, v) for t, v in enumerate([0.0, 0.1, 3.0, 3.1])]
    series = spark.createDataFrame(rows, "series string, session_index int, value double")
    got = models.filter_states(series, [0.0, 3.0], [1.0, 1.0], 0.9, "series").orderBy("session_index").collect()
    p = np.array([0.5, 0.5])
    for r, v in zip(got, [0.0, 0.1, 3.0, 3.1]):
        p = (p @ np.array([[0.9, 0.1], [0.1, 0.9]])) * np.exp(-((v - np.array([0.0, 3.0])) ** 2) / 2)
        p /= p.sum()
        assert np.allclose(r["probabilities"], p)


@pytest.mark.parametrize("chunk", [1, 7, 64, 4096])
def test_long_series_are_filtered_in_runs(spark, chunk):
    """Runs of any length give the sequential filter, over gaps in the session numbers and far-off values."""
    rng = np.random.default_rng(4)
    at = np.sort(rng.choice(900, 300, replace=False))
    values = {"a": rng.normal(size=300) * 3, "b": np.where(rng.random(300) < 0.05, 400.0, rng.normal(size=300)), "c": rng.normal(size=1)}
    rows = [(s, int(t), float(v)) for s, x in values.items() for t, v in zip(at, x)]
    series = spark.createDataFrame(rows, "series string, session_index int, value double").repartition(5)
    got = {(r["series"], r["session_index"]): r["probabilities"] for r in models.filter_states(series, [0.0, 3.0, -1.0], [1.0, 2.0, 0.5], 0.9, "series", chunk=chunk).collect()}
    assert len(got) == len(rows)
    move = np.full((3, 3), 0.05) + 0.85 * np.eye(3)
    for s, x in values.items():
        p = np.full(3, 1 / 3)
        for t, v in zip(at, x):
            log = np.log(p @ move) - (v - np.array([0.0, 3.0, -1.0])) ** 2 / (2 * np.array([1.0, 2.0, 0.5])) - 0.5 * np.log([1.0, 2.0, 0.5])
            p = np.exp(log - log.max())
            p /= p.sum()
            assert np.abs(p - got[s, int(t)]).max() < 1e-12


def test_minimum_variance(spark):
    cov = np.diag([0.04, 0.01, 0.02])
    rows = [(w, f"s{i}", f"s{j}", float(cov[i, j])) for w, n in (("w", 3), ("short", 1)) for i in range(n) for j in range(n)]
    got = allocation.minimum_variance(spark.createDataFrame(rows, "window string, sleeve_a string, sleeve_b string, covariance double"), 0.9, "window").orderBy("sleeve").collect()
    w = np.array([r["weight"] for r in got if r["window"] == "w"])
    assert np.allclose(w, (1 / np.diag(cov)) / (1 / np.diag(cov)).sum(), atol=1e-12) and all(r["residual"] < 1e-9 for r in got if r["window"] == "w")
    assert [r["weight"] for r in got if r["window"] == "short"] == [None]


def test_minimum_variance_equals_enumeration():
    """Every choice of lower, upper and free weights, over random, singular and tied covariances."""
    from itertools import product

    rng = np.random.default_rng(5)
    for trial in range(60):
        n = int(rng.integers(2, 6))
        x = rng.normal(size=(n if trial % 3 else max(1, n - 2), n)) * rng.choice([0.01, 1.0, 30.0])
        c = x.T @ x + (0 if trial % 4 else 1) * np.eye(n)
        cap = float(rng.choice([1.0, 0.6, 1 / n + 0.05, 1 / n]))
        best = np.inf
        for kinds in product((0, 1, 2), repeat=n):
            kinds = np.array(kinds)
            w = np.where(kinds == 1, cap, 0.0)
            free = kinds == 2
            m = int(free.sum())
            if m:
                k = np.zeros((m + 1, m + 1))
                k[:m, :m], k[:m, m], k[m, :m] = 2 * c[np.ix_(free, free)], -1, 1
                w[free] = np.linalg.lstsq(k, np.append(-2 * c[np.ix_(free, ~free)] @ w[~free], 1 - w.sum()), rcond=1e-13)[0][:m]
            if abs(w.sum() - 1) < 1e-9 and w.min() > -1e-12 and w.max() < cap + 1e-12:
                best = min(best, w @ c @ w)
        w, residual = allocation.capped_minimum(c, cap)
        assert residual < 1e-9 and abs(w.sum() - 1) < 1e-9 and w.min() >= -1e-12 and w.max() <= cap + 1e-12
        assert w @ c @ w <= best + 1e-9 * (1 + best), (trial, n, cap)


def test_inverse_volatility_caps(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", float(v)) for i, s in enumerate([0.001, 0.02, 0.03, 0.04]) for v in rng.normal(0, s, 60)]
    got = {r["sleeve"]: r["weight"] for r in allocation.inverse_volatility(spark.createDataFrame(rows, "sleeve string, ret double"), 0.4).collect()}
    assert got["s0"] == 0.4 and abs(sum(got.values()) - 1) < 1e-12 and max(got.values()) <= 0.4 + 1e-12


def test_session_trade_over_a_clock_change(spark):
    utc = lambda d, h, m: datetime.datetime(2024, 3, d, h, m)
    calendar = spark.createDataFrame([("XNYS", "a", utc(8, 14, 30), utc(8, 21, 0)), ("XNYS", "b", utc(11, 13, 30), utc(11, 20, 0))], T.EXCHANGE_SESSIONS)
    bars = spark.createDataFrame([("XNYS", "A", utc(8, 20, 55), utc(8, 21, 0), 100.0, 100.0, 100.0, 100.0, "intraday"), ("XNYS", "A", utc(11, 13, 30), utc(11, 13, 35), 110.0, 110.0, 110.0, 110.0, "intraday")], T.SESSION_BARS)
    books = spark.createDataFrame([("x", "A", "XNYS", "long", 5, 0, 1000.0, 1000.0, 1.0, 0.0)], "book_name string, asset string, exchange string, side string, entry_minutes_before_close int, exit_minutes_after_next_open int, starting_cash double, max_capital double, leverage double, cost_bps double")
    (trade,) = sessions.round_trips(books, calendar, bars).collect()
    assert (trade["entry_at"], trade["exit_at"]) == (utc(8, 20, 55), utc(11, 13, 30))
    assert trade["trade_return"] == pytest.approx(0.1)


def test_chain_detects_each_tamper(spark):
    def chain(run, n):
        before, out = "GENESIS", []
        for k in range(n):
            h = hashlib.sha256(f"{k}\np{k}\n{before}".encode()).hexdigest()
            out.append([run, k, before, f"p{k}", h])
            before = h
        return out

    good, payload, gap, link = (chain(r, 4) for r in ("good", "payload", "gap", "link"))
    payload[2][3] = "other"
    del gap[1]
    link[3][2] = "x"
    rows = [tuple(x) for c in (good, payload, gap, link) for x in c]
    got = {tuple(r) for r in ledger.chain_breaks(spark.createDataFrame(rows, "run_id string, sequence long, previous_hash string, payload string, entry_hash string")).collect()}
    assert got == {("payload", 2, "hash"), ("gap", 2, "sequence"), ("gap", 3, "sequence"), ("link", 3, "previous")}


def test_trial_budget(spark):
    rows = [("r", 1, "a"), ("r", 2, "a"), ("r", 3, "b"), ("r", 4, "c")]
    got = ledger.reserve_trials(spark.createDataFrame(rows, "run_id string, requested int, candidate_hash string"), 2).collect()
    assert {(r["candidate_hash"], r["reservation_index"]) for r in got} == {("a", 1), ("b", 2)}


def test_every_query_has_stable_columns(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert entry.entry(spark).count() > 0
    for name in ("c1_as_of_vintage", "e6_nested_factor", "i2_target_weights", "s4_running_positions"):
        assert found[name](spark, "/root/testdata/sf0.001").count() > 0


def test_filter_states_sends_no_keys_to_the_driver(spark):
    """Short series are one pass over the rows: no join, so nothing that grows with the series is broadcast."""
    rows = [(s, t, float(s + t)) for s in range(50) for t in range(3)]
    got = models.filter_states(spark.createDataFrame(rows, "series long, session_index int, value double"), [0.0, 3.0], [1.0, 1.0], 0.9, "series")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == len(rows)


def test_filter_states_over_batches(spark):
    """Runs that cross batches go on from the state of the batch before, with and without a run's first row."""
    rng = np.random.default_rng(5)
    rows = [(s, t, float(v)) for s in "ab" for t, v in enumerate(rng.normal(size=40))]
    series = spark.createDataFrame(rows, "series string, session_index int, value double")
    want = {r[:2]: r[2] for r in models.filter_states(series, [0.0, 3.0], [1.0, 1.0], 0.9, "series").collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for chunk in (7, 4096):
            got = {r[:2]: r[2] for r in models.filter_states(series, [0.0, 3.0], [1.0, 1.0], 0.9, "series", chunk=chunk).collect()}
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def zero_price_trades(spark):
    """Three nights of one book; the second is entered at price zero."""
    at = lambda d, h: datetime.datetime(2024, 3, d, h)
    calendar = spark.createDataFrame([("X", str(d), at(d, 8), at(d, 16)) for d in (4, 5, 6, 7)], T.EXCHANGE_SESSIONS)
    opens = {(4, 14): 100.0, (5, 9): 110.0, (5, 14): 0.0, (6, 9): 5.0, (6, 14): 50.0, (7, 9): 55.0}
    bars = spark.createDataFrame([("X", "A", at(*t), at(*t), p, p, p, p, "intraday") for t, p in opens.items()], T.SESSION_BARS)
    books = spark.createDataFrame([("x", "A", "X", "long", 120, 60, 1000.0, 1000.0, 1.0, 0.0)], "book_name string, asset string, exchange string, side string, entry_minutes_before_close int, exit_minutes_after_next_open int, starting_cash double, max_capital double, leverage double, cost_bps double")
    return sessions.round_trips(books, calendar, bars)


def test_round_trip_entered_at_zero(spark):
    """the trade stays, without a quantity or result; the others are as they were."""
    got = zero_price_trades(spark).orderBy("session").collect()
    assert [(r["entry_price"], r["exit_price"]) for r in got] == [(100.0, 110.0), (0.0, 5.0), (50.0, 55.0)]
    assert [r["trade_return"] for r in got] == [pytest.approx(0.1), None, pytest.approx(0.1)] and got[1]["quantity"] is None and got[1]["net_pnl"] is None


def test_nav_after_an_entry_at_zero(spark):
    """the NAV is unknown from that trade's exit on, as in the SQL, not as if it had made nothing."""
    got = sessions.trade_nav(zero_price_trades(spark).withColumn("trade_id", F.col("session")), 1000.0, "book_name").orderBy("exit_at").collect()
    assert [r["nav"] for r in got] == [pytest.approx(1100.0), None, None]


def against_sql(spark, folder, name):
    """A query's rows and its SQL's over nights of three books with zero prices at entry, exit and both, and returns near a half of the last place."""
    import __spark_entry__ as entry
    import duckdb

    nights = [(64.0, 70.0), (1.6, 108.15), (24.0, 48.05), (4.8, 20.41), (0.06, 117.93), (5.0, 0.0), (0.0, 5.0), (0.0, 0.0), (50.0, 55.0)]
    start = datetime.datetime(2024, 3, 1)
    rows = []
    for user in (0, 1, 2):  # long, short, long; sessions of exchange k are 8 + k to 16 + k o'clock
        for day, (entered, left) in enumerate(nights[user * 3 :] + nights[: user * 3]):
            rows += [(user, start + datetime.timedelta(days=day, hours=14 + user), entered), (user, start + datetime.timedelta(days=day + 1, hours=9 + user), left)]
    values = ", ".join(f"({k}, {u}, TIMESTAMP '{at}', {v}::DOUBLE)" for k, (u, at, v) in enumerate(rows))
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, user_id, ts, value)) TO '{folder}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got, want = entry.queries()[name](spark, str(folder)).collect(), con.sql(entry.oracle_sql()[name]).fetchall()
    assert len(want) == 27
    return sorted(repr(tuple(r)) for r in got), sorted(repr(r) for r in want)


def test_round_trips_equal_their_sql(spark, tmp_path):
    """an entry at zero gives what IEEE arithmetic gives, and a return is rounded as in the SQL."""
    got, want = against_sql(spark, tmp_path, "i12_round_trips")
    assert got == want and "-inf" in str(want) and "nan" in str(want)


def test_trade_nav_equals_its_sql(spark, tmp_path):
    """from an entry at zero on the NAV is NaN, or minus infinity after a short, as the SQL's running sum."""
    got, want = against_sql(spark, tmp_path, "i14_trade_nav")
    assert got == want and "-inf" in str(want) and "nan" in str(want)
