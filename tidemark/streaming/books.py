"""Streaming checks and state of paper books. Every operator takes and gives streaming DataFrames.

Watermarks bound the state: event ids within the delay, one row per book (position, last
day, posterior), and open windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues


def distinct_events(events: DataFrame, clock: str, delay: str) -> DataFrame:
    """First arrival of each (book_id, event_id) within the watermark, whatever its payload.

    ``ingested`` tells a replay from a changed payload.
    """
    return events.withWatermark(clock, delay).dropDuplicatesWithinWatermark(["book_id", "event_id"])


#: The state store that map states and timers need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ingestion(StatefulProcessor):
    """Map state of one part of a book: bucket -> event ids with their payload hash and clock, until ``keep_ms`` after that clock.

    A call reads and writes a bucket once, however many of its ids come; a state call is a round trip to the JVM.
    """

    BUCKETS = 64

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("ids", "bucket long", "held binary")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """One timer a part: the earliest end of what it holds."""
        set_to = self.timer.get()[0] if self.timer.exists() else None
        if set_to is None or at < set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    @staticmethod
    def _held(value: tuple | None) -> np.ndarray:
        """Rows of ids (ascending), hashes and clocks."""
        return np.zeros((3, 0), np.int64) if value is None else np.frombuffer(bytes(value[0]), np.int64).reshape(3, -1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["clock", "hash"], kind="stable")  # one batch's events of one part of a book
        event, payload, clock = (frame[c].to_numpy(np.int64) for c in ("event_id", "hash", "clock"))
        ids, first, at = np.unique(event, return_index=True, return_inverse=True)
        known, fresh = payload[first], np.ones(len(ids), bool)
        bucket = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(self.BUCKETS)
        for b in np.unique(bucket).tolist():
            mine = np.flatnonzero(bucket == b)
            held = self._held(self.seen.getValue((b,)))
            place = np.searchsorted(held[0], ids[mine])
            found = np.append(held[0], 0)[place] == ids[mine]
            found &= place < held.shape[1]
            known[mine[found]] = held[1][place[found]]
            fresh[mine[found]] = False
            new = mine[~found]
            if len(new):
                held = np.concatenate([held, [ids[new], payload[first[new]], clock[first[new]]]], axis=1)
                self.seen.updateValue((b,), (held[:, np.argsort(held[0])].tobytes(),))
        if fresh.any():
            self._wake(int(clock[first[fresh]].min()) + self.keep_ms)
        accepted = fresh[at] & (first[at] == np.arange(len(event)))
        verdict = np.where(accepted, "accepted", np.where(known[at] == payload, "replayed", "changed"))
        yield pd.DataFrame({"book_id": key[0], "event_id": event, "clock": clock, "hash": payload, "verdict": verdict.astype(object)})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = timerValues.getCurrentWatermarkInMs(), []
        for bucket, value in list(self.seen.iterator()):
            held = self._held(value)
            kept = held[:, held[2] + self.keep_ms > now]
            if not kept.shape[1]:
                self.seen.removeKey(bucket)
            elif kept.shape[1] < held.shape[1]:
                self.seen.updateValue(bucket, (kept.tobytes(),))
            left += kept[2].tolist()
        self.timer.clear()
        if left:
            self._wake(min(left) + self.keep_ms)
        return iter(())

    def close(self) -> None:
        pass


def ingested(events: DataFrame, clock: str, delay: str, keep_seconds: int, payload: list[str], parts: int = 64) -> DataFrame:
    """Every event's verdict: accepted (first of its id in the book), replayed (same payload again) or changed (another payload).

    Gives book_id, event_id, the clock in milliseconds, the payload's hash and the verdict; what is not accepted
    belongs in a reject sink (``drain_accepted``). An id is remembered until the watermark passes its clock by
    ``keep_seconds``; a later event of that id is new again. Within a batch the earliest clock comes first. State is keyed by (book, hash of the
    id modulo ``parts``), so a busy book spreads over tasks. Start it with the setting ROCKSDB (``drain`` with ``rocksdb``).
    """
    rows = events.withWatermark(clock, delay).select("book_id", "event_id", F.xxhash64(*payload).alias("hash"), F.unix_millis(clock).alias("clock"), F.pmod(F.xxhash64("event_id"), F.lit(parts)).alias("part"), clock)
    schema = "book_id long, event_id long, clock long, hash long, verdict string"
    return rows.groupBy("book_id", "part").transformWithStateInPandas(statefulProcessor=Ingestion(1000 * keep_seconds), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def drain_accepted(verdicts: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Run ``ingested`` over what is available; accepted and changed events, the latter from the reject sink ``folder``/rejects."""

    def put(batch: DataFrame, number: int) -> None:
        batch.where("verdict = 'changed'").write.mode("overwrite").parquet(f"{folder}/rejects/batch={number}")

    accepted = drain(verdicts, folder, each=put, rocksdb=True).where("verdict = 'accepted'")
    return accepted, verdicts.sparkSession.read.schema(verdicts.schema).parquet(f"{folder}/rejects").select(*verdicts.columns)


def admit_signals(signals: DataFrame, most_age_seconds: int) -> DataFrame:
    """Signals with a verdict: ok, future or stale, from their age at ingestion."""
    age = F.unix_micros("ingested_at") - F.unix_micros("available_at")
    verdict = F.when(age < 0, "future").when(age > most_age_seconds * 1_000_000, "stale").otherwise("ok")
    return signals.withColumn("verdict", verdict)


def daily_windows(bars: DataFrame, clock: str, delay: str) -> DataFrame:
    """One row per book and UTC day once the watermark has passed it: n_bars, n_assets and repeated assets, all exact.

    Bars are counted per asset first (state: a row per asset of an open day, dealt by it), and the closed
    counts are added up per book; ``n_repeated`` assets had more than one bar.
    """
    per_asset = bars.withWatermark(clock, delay).groupBy("book_id", "asset", F.window(clock, "1 day").alias("day")).agg(F.count("*").alias("n"))
    at = F.window(F.window_time("day"), "1 day")
    out = per_asset.groupBy("book_id", at.alias("day")).agg(F.sum("n").alias("n_bars"), F.count("*").alias("n_assets"), F.count_if(F.col("n") > 1).alias("n_repeated"))
    return out.select("book_id", F.to_date("day.start").alias("day"), "n_bars", "n_assets", "n_repeated")


def complete_days(windows: DataFrame, expected: DataFrame) -> DataFrame:
    """Daily windows with a verdict: complete, incomplete (fewer assets than the book's ``expected`` n_expected) or repeated (an asset twice)."""
    verdict = F.when(F.col("n_repeated") > 0, "repeated").when(F.col("n_assets") < F.coalesce("n_expected", F.lit(0)), "incomplete").otherwise("complete")
    return windows.join(expected.select("book_id", "n_expected"), "book_id", "left").withColumn("verdict", verdict)


def running_positions(fills: DataFrame, initial: float) -> DataFrame:
    """Running quantity and cash per book (update or complete mode)."""
    spent = F.sum(F.col("quantity") * F.col("price") + F.col("commission"))
    return fills.groupBy("book_id").agg(F.sum("quantity").alias("quantity"), (F.lit(initial) - spent).alias("cash"), F.count("*").alias("n_fills"))


def chronology(events: DataFrame, clock: str) -> DataFrame:
    """Events with whether they precede one seen before for the same book (state: the last stamp)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["arrival", "event_id"], kind="stable")
        late = []
        for stamp in rows["stamp"]:
            late.append(last is not None and stamp < last)
            last = stamp if last is None else max(last, stamp)
        state.update((int(last),))
        yield pd.DataFrame({"book_id": key[0], "event_id": rows["event_id"].to_numpy(), "backdated": late})

    keyed = events.select("book_id", "event_id", F.col("arrival"), F.unix_micros(clock).alias("stamp"))
    return keyed.groupBy("book_id").applyInPandasWithState(run, "book_id long, event_id long, backdated boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def signals_before_bars(signals: DataFrame, bars: DataFrame, reach: str, delay: str) -> DataFrame:
    """Signal-bar pairs of one book and asset with the signal before the bar and within ``reach`` of it."""
    s = signals.withWatermark("available_at", delay).alias("s")
    b = bars.withWatermark("window_start", delay).alias("b")
    on = F.expr(f"s.book_id = b.book_id and s.asset = b.asset and s.available_at < b.window_start and s.available_at >= b.window_start - interval {reach}")
    return s.join(b, on).select("s.book_id", "s.asset", "s.signal_id", "b.bar_id")


def online_filter(returns: DataFrame, means: list[float], variance: float, stay: float) -> DataFrame:
    """State probabilities per book, updated return by return (state: the posterior)."""
    k = len(means)
    move = np.full((k, k), (1 - stay) / max(k - 1, 1))
    np.fill_diagonal(move, stay)
    centre = np.array(means)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = np.array(state.get[0]) if state.exists else np.full(k, 1 / k)
        rows = pd.concat(list(frames)).sort_values("step", kind="stable")
        out = []
        for value in rows["value"]:
            log = np.log(np.maximum(p @ move, 1e-300)) - (value - centre) ** 2 / (2 * variance)
            p = np.exp(log - log.max())
            p /= p.sum()
            out.append(p.tolist())
        state.update((p.tolist(),))
        yield pd.DataFrame({"book_id": key[0], "step": rows["step"].to_numpy(), "probabilities": out})

    return returns.select("book_id", "step", "value").groupBy("book_id").applyInPandasWithState(run, "book_id long, step long, probabilities array<double>", "p array<double>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, rocksdb: bool = False) -> DataFrame:
    """Run a stream over what is available now into a Parquet folder and read the result; ``rocksdb`` for map states and timers.

    A batch has a folder of its own that it overwrites, so one that is run again after a
    failure counts once. In complete mode the last batch is the result.
    """

    def put(batch: DataFrame, number: int) -> None:
        if each:
            each(batch, number)
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}")

    conf, before = stream.sparkSession.conf, stream.sparkSession.conf.get(ROCKSDB[0], None)
    if rocksdb:
        conf.set(*ROCKSDB)  # read when the query starts
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        if rocksdb:
            conf.unset(ROCKSDB[0]) if before is None else conf.set(ROCKSDB[0], before)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)


def age(now: Column, then: Column) -> Column:
    """Seconds between two instants."""
    return (F.unix_micros(now) - F.unix_micros(then)) / 1_000_000
