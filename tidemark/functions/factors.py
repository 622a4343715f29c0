"""Cross-sectional and rolling factor expressions over a dense panel.

The panel has one row per (session, asset), ``session_index`` counting sessions. Every
builder returns a Column; compose them freely and mask each node with ``node``.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .columns import finite

SESSION, ASSET, INDEX, ELIGIBLE = "session_index", "asset", "session_index", "eligible"
LONGEST_WINDOW = 2520


def _window(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= LONGEST_WINDOW:
        raise ValueError(f"a window is an integer from 1 to {LONGEST_WINDOW}")
    return k


def by_asset() -> WindowSpec:
    return Window.partitionBy(ASSET).orderBy(INDEX)


def node(x: Column, eligible: str = ELIGIBLE) -> Column:
    """A node's value: finite, and only where the row is eligible."""
    return F.when(F.col(eligible), finite(x))


def rank(x: Column, *by: str) -> Column:
    """Cross-sectional rank in [0, 1]; ties share their mean rank; missing stays missing."""
    by = by or (SESSION,)
    present = x.isNull()
    low = F.rank().over(Window.partitionBy(*by, present).orderBy(x)) - 1
    ties = F.count("*").over(Window.partitionBy(*by, x)) - 1
    known = F.count(x).over(Window.partitionBy(*by))
    return F.when(x.isNotNull(), (low + ties / 2) / F.greatest(known - 1, F.lit(1)))


def centered_rank(x: Column, *by: str) -> Column:
    """Rank scaled to [-1, 1]; 0 for a lone asset."""
    known = F.count(x).over(Window.partitionBy(*(by or (SESSION,))))
    return F.when(x.isNotNull(), F.when(known > 1, 2 * rank(x, *by) - 1).otherwise(0.0))


def zscore(x: Column, *by: str) -> Column:
    """(x - mean) / population deviation across assets; a zero deviation counts as 1."""
    over = Window.partitionBy(*(by or (SESSION,)))
    deviation = F.stddev_pop(x).over(over)
    return (x - F.avg(x).over(over)) / F.when(deviation > 0, deviation).otherwise(1.0)


def lag(x: Column, k: int) -> Column:
    """x of k sessions ago for the same asset."""
    return F.lag(x, _window(k)).over(by_asset())


def ts_delta(x: Column, k: int) -> Column:
    return x - lag(x, k)


def ts_mean(x: Column, k: int) -> Column:
    """Mean of the last k sessions; missing unless all k are known."""
    over = by_asset().rowsBetween(-(_window(k) - 1), 0)
    return F.when(F.count(x).over(over) == k, F.avg(x).over(over))


def rolling_beta(y: Column, x: Column, k: int) -> Column:
    """Least-squares slope of y on x over the last k sessions, all known and x not constant."""
    if _window(k) < 2:
        raise ValueError("a slope needs two sessions")
    over = by_asset().rowsBetween(-(k - 1), 0)
    known = F.when(x.isNotNull() & y.isNotNull(), 1)
    spread = k * F.var_pop(x).over(over)
    return F.when((F.count(known).over(over) == k) & (spread > 1e-16), F.regr_slope(y, x).over(over))


def forward_residual(stock: Column, sector: Column, market: Column, beta: Column, horizon: int, eligible: str = ELIGIBLE) -> Column:
    """Residual return from the next open to ``horizon`` opens later.

    Needs a positive start and a non-negative end of all three series, and a beta.
    """
    _window(horizon)
    total, valid = None, F.col(eligible) & beta.isNotNull()
    for series, weight in ((stock, F.lit(1.0)), (sector, F.lit(-1.0)), (market, -beta)):
        start, end = F.lead(series, 1).over(by_asset()), F.lead(series, horizon + 1).over(by_asset())
        valid = valid & (start > 0) & (end >= 0)
        part = weight * (F.try_divide(end, start) - 1)
        total = part if total is None else total + part
    return F.when(valid, finite(total))


def label_end(horizon: int, last_index: Column) -> Column:
    """Session index of the label's end; NULL past the calendar."""
    end = F.col(INDEX) + horizon + 1
    return F.when(end <= last_index, end)
