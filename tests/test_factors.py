"""Hand-computed panels, and prefix invariance of every factor."""

import datetime
import math

import pytest
from pyspark.sql import functions as F
from tidemark.functions import columns as X
from tidemark.functions import factors as E
from tidemark.operators import stats

_ = None


def panel(spark, x, eligible=None):
    rows = [(t + 1, f"a{i}", v, True if eligible is None else eligible[t][i]) for t, row in enumerate(x) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "session_index int, asset string, x double, eligible boolean")


def grid(df, column, like):
    out = [[None] * len(r) for r in like]
    for r in df.select("session_index", "asset", column).collect():
        out[r[0] - 1][int(r[1][1:])] = r[2]
    return out


def value(spark, x, expression, eligible=None):
    p = panel(spark, x, eligible).withColumn("m", E.node(F.col("x")))
    return grid(p.withColumn("y", E.node(expression(F.col("m")))), "y", x)


def test_rank_ties_and_missing(spark):
    got = value(spark, [[7.0, 7.0, 7.0], [9.0, 2.0, 2.0], [_, 1.0, 2.0]], E.rank)
    assert got == [[0.5, 0.5, 0.5], [1.0, 0.25, 0.25], [_, 0.0, 1.0]]


LONG = [[1.0, 100.0], [2.0, 200.0], [3.0, _], [4.0, 400.0]]


@pytest.mark.parametrize(
    "expression, want",
    [
        (lambda x: E.lag(x, 1), [[_, _], [1.0, 100.0], [2.0, 200.0], [3.0, _]]),
        (lambda x: E.ts_mean(x, 2), [[_, _], [1.5, 150.0], [2.5, _], [3.5, _]]),
        (lambda x: E.ts_delta(x, 2), [[_, _], [_, _], [2.0, _], [2.0, 200.0]]),
    ],
)
def test_rolling(spark, expression, want):
    assert value(spark, LONG, expression) == want


def test_masked_operators(spark):
    one, mask = [[1.0, 2.0, 3.0]], [[True, False, True]]
    assert value(spark, one, lambda x: X.divide(x, F.lit(0.0)), mask) == [[_, _, _]]
    assert value(spark, one, E.rank, mask) == [[0.0, _, 1.0]]
    assert value(spark, one, lambda x: X.winsorize(x, 0.5), mask) == [[0.5, _, 0.5]]


def test_centered_rank_and_zscore(spark):
    assert value(spark, [[5.0], [1.0]], E.centered_rank) == [[0.0], [0.0]]
    assert value(spark, [[1.0, 2.0, 3.0]], E.centered_rank) == [[-1.0, 0.0, 1.0]]
    assert value(spark, [[4.0, 4.0, _]], E.zscore) == [[0.0, 0.0, _]]


def test_min_max_missing(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a double, b double")
    got = rows.select(X.smallest(F.col("a"), F.col("b")), X.largest(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0), (None, None)]


@pytest.mark.parametrize("expression", [E.rank, E.zscore, lambda x: E.lag(x, 2), lambda x: E.ts_delta(x, 2), lambda x: E.ts_mean(x, 3), E.centered_rank, lambda x: E.ts_mean(E.rank(x), 2)])
def test_the_future_never_changes_the_past(spark, expression):
    x = [[float(3 * t + i) for i in range(3)] for t in range(10)]
    changed = x[:7] + [[-1000.0] * 3] * 3
    assert value(spark, x, expression)[:7] == value(spark, changed, expression)[:7]


def test_window_arguments():
    for bad in (0, -1, 2521, 1.5, True):
        with pytest.raises(ValueError):
            E._window(bad)


def test_beta_is_the_slope_over_a_full_window(spark):
    x = [0.01 * ((t * 7) % 5 - 2) for t in range(8)]
    rows = [(t + 1, "a0", 0.5 * x[t] + 0.001, x[t], True) for t in range(8)]
    df = spark.createDataFrame(rows, "session_index int, asset string, y double, x double, eligible boolean")
    got = [r[0] for r in df.withColumn("b", E.rolling_beta(F.col("y"), F.col("x"), 5)).orderBy("session_index").select("b").collect()]
    assert got[:4] == [None] * 4 and all(math.isclose(b, 0.5, rel_tol=1e-9) for b in got[4:])


def test_forward_label(spark):
    rows = [(t + 1, "a0", p, 10.0, 10.0, True) for t, p in enumerate([1.0, 2.0, 3.0, 6.0])]
    df = spark.createDataFrame(rows, "session_index int, asset string, s double, c double, m double, eligible boolean")
    label = E.forward_residual(F.col("s"), F.col("c"), F.col("m"), F.lit(1.0), 1)
    assert [r[0] for r in df.withColumn("l", label).orderBy("session_index").select("l").collect()] == [0.5, 1.0, None, None]


def test_rank_ic_conventions(spark):
    rows = [(1, "a", 1.0, 5.0), (1, "b", 2.0, 6.0), (1, "c", 3.0, 9.0), (2, "a", 1.0, 1.0), (2, "b", 1.0, 2.0), (3, "a", 1.0, 4.0), (3, "b", 2.0, 4.0)]
    df = spark.createDataFrame(rows, "session_index int, asset string, s double, o double")
    got = {r["session_index"]: r["ic"] for r in stats.rank_ic(df, "s", "o", "session_index").collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0}  # no spread of scores: 0; no spread of outcomes: left out


def test_sign_flipped_copy_is_similar(spark):
    s = [(t, f"a{i}", float((i * 5 + t) % 7)) for t in range(4) for i in range(6)]
    scores = spark.createDataFrame(s, "session_index int, asset string, score double")
    library = scores.select("session_index", "asset", F.lit("flip").alias("factor"), (-F.col("score")).alias("score"))
    assert stats.similarity(scores, library, "session_index").first()["similarity"] == pytest.approx(1.0)


def test_content_hash_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(i, f"x{i % 5}") for i in range(100)], "k int, v string")
    same, other = stats.content_hash(a.orderBy(F.desc("k"))).first(), stats.content_hash(a.where("k < 99")).first()
    assert stats.content_hash(a).first() == same != other
    deep = [stats.content_hash(x, part_rows=3, fan=1).first() for x in (a, a.repartition(5), a.where("k < 99"))]  # a tree of several levels
    assert deep[0] == deep[1] != deep[2] and deep[0]["n_rows"] == 100


def test_half_life_and_stability(spark):
    d = spark.createDataFrame([("f", h, v) for h, v in ((1, 0.8), (2, 0.5), (3, 0.4), (4, 0.1))], "name string, horizon int, value double")
    assert stats.half_life(d, "name").first()["half_life"] == 3
    folds = spark.createDataFrame([("f", m) for m in (0.1, 0.2, -0.1)], "name string, metric double")
    assert stats.stability(folds, "name").first()["persistent"] is True
    assert datetime.date(2020, 1, 2).year == 2020


@pytest.mark.parametrize("partitions", [1, 13])
def test_ranks_by_ranges_equal_the_window(spark, partitions):
    """Ties over most of a session, missing values and sessions, signed zeros, and a session over many ranges."""
    import random

    from tidemark.operators import ranks

    rng = random.Random(1)
    pick = lambda: rng.choice([None, 1.0, 1.0, 1.0, -0.0, 0.0, float(rng.randrange(40)), rng.random()])
    rows = [(rng.choice([1, 1, 1, 2, None]), i, pick()) for i in range(2000)] + [(3, 9001, 5.0), (4, 9002, None)]
    df = spark.createDataFrame(rows, "session_index int, asset int, x double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["asset"]: r["rank"] for r in ranks.ranked(df, "x", "session_index").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {r["asset"]: r["y"] for r in df.withColumn("y", E.rank(F.col("x"))).collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-12 for k in want)
    assert ranks.ranked(df.limit(0), "x", "session_index").count() == 0


def test_one_session_is_split(spark):
    """Half a million assets of one session reach several range tasks, and the ranks are exact."""
    from tidemark.operators import ranks

    n = 500_000
    df = spark.range(n).select(F.lit(1).alias("session_index"), "id", ((F.col("id") * 7919) % n).cast("double").alias("x"))
    out = ranks.ranked(df, "x", "session_index")
    assert out.where(F.abs(F.col("rank") - F.col("x") / (n - 1)) > 1e-12).count() == 0
    assert df.repartitionByRange("session_index", "x").select(F.spark_partition_id().alias("p")).groupBy("p").count().where("count > 0").count() > 1
