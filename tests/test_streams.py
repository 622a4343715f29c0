"""Ingestion verdicts, restarts and exact daily windows of the book streams."""

import datetime

import numpy as np
import pandas as pd
import pytest
from tidemark.streaming import books

EVENT = "book_id long, event_id long, at timestamp, body string"
BAR = "book_id long, asset long, at timestamp"


def clock(minutes):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=minutes)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_replayed_changed_and_expired_ids_over_restarts(spark, tmp_path):
    """Each drain is a run of its own that goes on from the checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(EVENT).parquet(source)
        accepted, rejected = books.drain_accepted(books.ingested(stream, "at", "10 minutes", 3600, ["body"], 4), out)
        return sorted((r["book_id"], r["event_id"], r["clock"]) for r in accepted.collect()), sorted((r["book_id"], r["event_id"], r["clock"]) for r in rejected.collect())

    ms = lambda m: int(clock(m).timestamp() * 1000)
    put(spark, source, [(1, 1, clock(0), "a"), (1, 2, clock(1), "b"), (2, 1, clock(1), "other book"), (1, 3, clock(2), None)], EVENT)
    first = [(1, 1, ms(0)), (1, 2, ms(1)), (1, 3, ms(2)), (2, 1, ms(1))]
    assert run() == (first, [])
    # a replay is dropped, a changed payload goes to the reject sink, after a restart
    put(spark, source, [(1, 1, clock(5), "a"), (1, 2, clock(6), "B"), (1, 3, clock(6), None), (2, 9, clock(30), "x")], EVENT)
    assert run() == (sorted([*first, (2, 9, ms(30))]), [(1, 2, ms(6))])
    # the watermark passes the hour after ids 1 to 3
    put(spark, source, [(7, 7, clock(120), "late clock")], EVENT)
    assert run() == (sorted([*first, (2, 9, ms(30)), (7, 7, ms(120))]), [(1, 2, ms(6))])
    put(spark, source, [(1, 2, clock(125), "new payload"), (7, 7, clock(126), "late clock"), (7, 7, clock(127), "changed")], EVENT)
    accepted, rejected = run()
    assert (1, 2, ms(125)) in accepted and len(accepted) == 7
    assert rejected == [(1, 2, ms(6)), (7, 7, ms(127))]


def test_exact_daily_windows(spark, tmp_path):
    """Assets and repeated ones are counted exactly, days close with the watermark, incomplete ones are told."""
    day = 24 * 60
    rows = [(1, a, clock(a % day)) for a in range(3000)] + [(1, 5, clock(60)), (2, 1, clock(3)), (1, 1, clock(day + 5)), (1, 2, clock(day + 9)), (2, 1, clock(2 * day + 120))]
    put(spark, str(tmp_path / "in"), rows, BAR)
    stream = spark.readStream.schema(BAR).parquet(str(tmp_path / "in"))
    got = books.drain(books.daily_windows(stream, "at", "1 hour"), str(tmp_path / "out"))
    days = sorted(tuple(r) for r in got.collect())
    one, two = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    first = [a for a in range(3000)]
    assert days == [(1, one, len(first) + 1, 3000, 1), (1, two, 2, 2, 0), (2, one, 1, 1, 0)]
    expected = spark.createDataFrame([(1, 3), (2, 1)], "book_id long, n_expected long")
    verdicts = {(r["book_id"], r["day"]): r["verdict"] for r in books.complete_days(got, expected).collect()}
    assert verdicts == {(1, one): "repeated", (1, two): "incomplete", (2, one): "complete"}


@pytest.mark.parametrize("parts", [1, 16])
def test_parts_do_not_show(spark, tmp_path, parts):
    rows = [(b, e % 40, clock(e), "p" if e % 3 else f"q{e}") for b in (1, 2) for e in range(100)]
    put(spark, str(tmp_path / "in"), rows, EVENT)
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    got = books.drain(books.ingested(stream, "at", "1 day", 86400, ["body"], parts), str(tmp_path / "out"), rocksdb=True).collect()
    assert len(got) == 200 and sum(r["verdict"] == "accepted" for r in got) == 80


def test_a_call_reads_and_writes_each_bucket_once():
    """State calls of a batch do not grow with its events."""

    class State(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def removeKey(self, key):
            self.calls += 1
            del self[key]

        def iterator(self):
            return iter(self.items())

    class Timer:
        at = None
        exists = lambda self: self.at is not None
        get = lambda self: self.at

        def update(self, at):
            self.at = at

        def clear(self):
            self.at = None

    class Handle:
        registerTimer = deleteTimer = lambda self, at: None

    class Clock:
        getCurrentWatermarkInMs = lambda self: 5100

    state = books.Ingestion(100)
    state.handle, state.seen, state.timer = Handle(), State(), Timer()
    rows = pd.DataFrame({"event_id": np.arange(-5000, 5000), "hash": np.arange(10000) % 7, "clock": np.arange(10000)})
    again = rows.assign(hash=(rows["event_id"] % 2 == 0) * 100 + rows["hash"], clock=rows["clock"] + 1)
    verdicts = lambda frame: next(state.handleInputRows((1, 0), iter([frame]), None)).set_index("event_id")["verdict"].to_dict()
    assert set(verdicts(rows).values()) == {"accepted"} and state.timer.at == (100,)
    want = {i: "changed" if i % 2 == 0 else "replayed" for i in range(-5000, 5000)}
    assert verdicts(again) == want
    assert state.seen.calls <= 300
    list(state.handleExpiredTimer((1, 0), Clock(), None))
    assert state.timer.at == (5101,)
    assert verdicts(again) == {i: v if i + 5000 > 5000 else "accepted" for i, v in want.items()}
