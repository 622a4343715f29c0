"""Vintages, membership, event and proxy features, and contract checks."""

import datetime

import pytest
from pyspark.sql import functions as F
from tidemark.operators import pit, quality, sweep
from tidemark.sources import tables as T


def at(day, hour=0, minute=0):
    return datetime.datetime(2020, 1, day, hour, minute)


@pytest.fixture(scope="module")
def calendar(spark):
    rows = [(datetime.date(2020, 1, d), at(d, 14), at(d, 21)) for d in (2, 3, 6)]
    return pit.number_sessions(spark.createDataFrame(rows, "session date, open_at timestamp, decision_at timestamp"))


OBS = [(2, "A", 1.0, at(2, 20), "old"), (2, "A", 99.0, at(4, 20), "future-revision"), (3, "A", 2.0, at(3, 20), "current"), (6, "A", 0.0, at(6, 20), "terminal"), (2, "B", 20.0, at(2, 22), "too-late")]


def observations(spark, rows=OBS):
    return spark.createDataFrame([(datetime.date(2020, 1, d), a, "x", v, t, i) for d, a, v, t, i in rows], T.OBSERVATIONS)


def test_as_of_vintage(spark, calendar):
    got = {(r["session"].day, r["asset"]): r["value"] for r in pit.as_of(observations(spark), calendar, ["asset", "field"], ["source_row_id"]).collect()}
    assert got == {(2, "A"): 1.0, (3, "A"): 2.0, (6, "A"): 0.0}


def test_membership_chooses_the_version_first(spark, calendar):
    first = datetime.date(2020, 1, 1)
    rows = [("A", first, None, datetime.datetime(2019, 12, 1)), ("A", first, datetime.date(2020, 1, 3), at(3, 20)), ("B", first, None, at(3))]
    got = {(r["session"].day, r["asset"]) for r in pit.membership(spark.createDataFrame(rows, T.UNIVERSE), calendar).collect()}
    assert got == {(2, "A"), (3, "A"), (3, "B"), (6, "B")}


def test_future_rows_never_change_the_past(spark, calendar):
    later = OBS + [(6, "A", 7.0, at(6, 20, 30), "new"), (6, "B", 5.0, at(6, 10), "new")]
    pick = lambda rows: sorted(map(str, pit.as_of(observations(spark, rows), calendar, ["asset", "field"], ["source_row_id"]).where("session < date'2020-01-06'").collect()))
    assert pick(OBS) == pick(later)


@pytest.fixture(scope="module")
def feature(spark):
    day = lambda d, h=20: datetime.datetime(2024, 1, d, h)
    source = [("factory", "event-1", datetime.date(2024, 1, 2), 12.0, day(2), day(3), day(5))]
    sources = spark.createDataFrame(source, "source_key string, observation_id string, observed_on date, value double, published_at timestamp, retrieved_at timestamp, extracted_at timestamp")
    exposures = spark.createDataFrame([("A", "factory", datetime.date(2024, 1, 1), None, day(1), 0.5)], T.EXPOSURE)
    sessions = spark.createDataFrame([(datetime.date(2024, 1, d), day(d, 21)) for d in (2, 3, 5, 8)], "session date, decision_at timestamp")
    return sources, exposures, pit.number_sessions(sessions)


@pytest.mark.parametrize("clock, days", [("extracted_at", {5, 8}), ("published_at", {2, 3, 5, 8})])
def test_event_feature_clocks(feature, clock, days):
    sources, exposures, calendar = feature
    usable = pit.eligible_session(sources, calendar, clock)
    got = sweep.event_sum(usable, exposures, calendar, 30).collect()
    assert {r["session"].day: r["value"] for r in got} == dict.fromkeys(days, 6.0)


def test_withdrawal_and_lag(spark, feature):
    sources, exposures, calendar = feature
    gone = sources.withColumn("value", F.lit(None).cast("double")).withColumn("published_at", F.col("published_at") + F.expr("INTERVAL 1 DAY"))
    both = pit.eligible_session(sources.unionByName(gone), calendar, "published_at")
    assert {r["session"].day for r in sweep.event_sum(both, exposures, calendar, 30).collect()} == {2}
    lagged = pit.eligible_session(sources, calendar, "published_at", 2)
    assert {r["session"].day for r in sweep.event_sum(lagged, exposures, calendar, 30).collect()} == {5, 8}


def test_zero_weight_ends_an_exposure(spark, feature):
    sources, exposures, calendar = feature
    ended = spark.createDataFrame([("A", "factory", datetime.date(2024, 1, 2), None, datetime.datetime(2024, 1, 4, 20), 0.0)], T.EXPOSURE)
    usable = pit.eligible_session(sources, calendar, "published_at")
    got = sweep.event_sum(usable, exposures.unionByName(ended), calendar, 30).collect()
    assert {r["session"].day for r in got} == {2, 3}


def test_proxy_needs_every_mapped_source(spark, feature):
    sources, exposures, calendar = feature
    other = spark.createDataFrame([("A", "mine", datetime.date(2024, 1, 4), None, datetime.datetime(2024, 1, 4, 20), 1.0)], T.EXPOSURE)
    usable = pit.eligible_session(sources, calendar, "published_at")
    alone = pit.latest_proxy(usable, exposures, calendar, 30).collect()
    paired = pit.latest_proxy(usable, exposures.unionByName(other), calendar, 30).collect()
    assert {r["session"].day for r in alone} == {2, 3, 5, 8} and {r["session"].day for r in paired} == {2, 3}


def test_urls(spark):
    cases = [("https://data.example.com/a?b=1", True), ("https://example.org:443/x", True), ("http://example.org/", False), ("https://user@example.org/", False), ("https://localhost/a", False), ("https://a.internal/", False), ("https://example.org/?api_key=1", False), ("https://example.org/#top", False), ("https://example.org:8443/", False), ("not a url", False), (None, False)]
    cases += [("https://example.org/a%00b", False), ("https://example.org/%0D%0A", False), ("https://example.org/é", False), ("https://example.org/a b", False), ("https://example.org\\@127.0.0.1/", False), ("https://example..org/a", False), ("file:///etc/passwd", False)]
    cases += [("https://example.org/?t%6Fken=1", False), ("https://example.org/?x=1%26token=2", True), ("https://example.org/?a=%C3%A9&b=%zz|{", True), ("https://example.org/?q=secret", True), ("https://example.org/?A-PI=1&my_Secret", False), ("https://example.org/" + "a" * 4096, False)]
    urls = spark.createDataFrame([(u,) for u, _ in cases], "url string")
    assert {r["url"] for r in quality.refused_urls(urls).collect()} == {u for u, ok in cases if not ok}


def test_crawl_rules(spark):
    rules = spark.createDataFrame([("h", "/private", False), ("h", "/private/open", True), ("h", "/*.pdf$", False), ("h", "/tie", False), ("h", "/tie", True), ("h", "/q?a.b", False)], "host string, rule string, allow boolean")
    cases = {"/private/x": False, "/private/open/y": True, "/z/file.pdf": False, "/z/file.pdf?x": True, "/tie": True, "/else": True, "/q?a.b": False, "/q?axb": True}
    urls = spark.createDataFrame([(p, "h", p) for p in cases], "url string, host string, path string")
    assert {r["url"]: r["allowed"] for r in quality.crawl_allowed(urls, rules).collect()} == cases


def test_schema_and_provenance(spark):
    df = spark.createDataFrame([(1, "a")], "asset int, field string")
    assert T.missing_columns(df, T.OBSERVATIONS) == ["session", "value", "available_at", "source_row_id"]
    manifest = spark.createDataFrame([("a", "as_run", "llm")], "field string, clock string, kind string")
    got = T.field_provenance(df.unionByName(spark.createDataFrame([(2, "b")], df.schema)), manifest).collect()
    assert {tuple(r) for r in got} == {("a", "as_run", True), ("b", "unknown", False)}


def test_empty_feature_sink_keeps_its_schema(spark, tmp_path):
    T.write_features(observations(spark).limit(0), str(tmp_path / "f"))
    assert spark.read.schema(T.OBSERVATIONS).parquet(str(tmp_path / "f")).count() == 0


def test_feature_request(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"sources":[{"source_key":"k","observation_id":"o","observed_on":"2024-01-02","value":1.5,"spans":[{"start":0,"end":2,"quote":"ab"}]}],"exposures":[{"asset":"A","source_key":"k","weight":0.5}],"sessions":[{"session":"2024-01-02","decision_at":"2024-01-02T21:00:00Z"}]}')
    sources, exposures, sessions = T.feature_request(spark, str(tmp_path / "r.json"))
    assert sources.first()["spans"][0]["quote"] == "ab" and exposures.first()["weight"] == 0.5 and sessions.count() == 1


def test_quotes_use_character_offsets(spark):
    docs = spark.createDataFrame([("h", "Démand: 12")], "source_hash string, text string")
    spans = spark.createDataFrame([("h", 8, 10, "12"), ("h", 7, 10, "12"), ("none", 0, 1, "x")], "source_hash string, start int, end int, quote string")
    assert quality.false_quotes(spans, docs).count() == 2


def test_bar_checks(spark):
    rows = [("2020-01-02", "A", 10.0, 11.0, 9.0, 10.0, 1.0, True), ("2020-01-02", "B", 10.0, 9.0, 8.0, 9.0, 1.0, True), ("2020-01-02", "C", -1.0, 11.0, -2.0, 3.0, 1.0, True), ("2020-01-02", "D", 10.0, 11.0, 9.0, None, 1.0, True)]
    bars = spark.createDataFrame(rows, T.BARS.replace("day date", "day string"))
    assert {r["asset"] for r in quality.bad_bars(bars).collect()} == {"B", "C", "D"}


def random_history(spark, seed):
    """Late, early and future-dated versions, revised and withdrawn events, decisions before and after their session's day."""
    import random

    rng = random.Random(seed)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    clock = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=n)
    dates = sorted(rng.sample(range(300), 40))
    calendar = [(day(n), clock(24 * n + rng.choice([-10, 2, 21]))) for n in dates]
    versions = {(rng.choice("ab"), rng.choice("XYZ"), day(rng.randrange(-40, 300)), clock(rng.randrange(-900, 24 * 320))) for _ in range(160)}
    versions = [(a, k, f, None if i % 3 else f + datetime.timedelta(rng.randrange(90)), t, rng.choice([0.0, 0.5, 1.0, -2.0])) for i, (k, a, f, t) in enumerate(sorted(versions))]
    events = []
    for i in range(90):
        k, o, o_day = rng.choice("ab"), f"e{i % 40}", day((i % 40) * 7 + (i % 3))
        events.append((k, o + k, day((i % 40) * 7), rng.choice([None, float(i + 1), float(-i)]), clock(24 * ((i % 40) * 7) + rng.randrange(24 * 60)), clock(0)))
        events[-1] = (*events[-1][:5], events[-1][4] + datetime.timedelta(hours=rng.randrange(50)))
    events = list({(e[0], e[1], e[4]): e for e in events}.values())
    frame = lambda r, s: spark.createDataFrame(r, s)
    cal = pit.number_sessions(frame(calendar, "session date, decision_at timestamp"))
    sources = frame(events, "source_key string, observation_id string, observed_on date, value double, published_at timestamp, extracted_at timestamp")
    return calendar, versions, events, cal, sources, frame(versions, T.EXPOSURE)


def every_pair(calendar, versions, events, most):
    """session, asset, source, day, weight, [(id, value)] by trying everything."""
    out = {}
    for session, decision in calendar:
        latest = {}
        for k, o, day, value, published, extracted in events:
            first = next((d for d, c in calendar if c >= extracted), None)
            if first is not None and first <= session and ((k, o) not in latest or latest[k, o][0] < published):
                latest[k, o] = (published, day, value)
        for (k, o), (_, day, value) in latest.items():
            if value is None or not 0 <= (session - day).days <= most:
                continue
            for asset in "XYZ":
                seen = [v for v in versions if v[0] == asset and v[1] == k and v[2] <= day and v[4] <= decision]
                if seen:
                    best = max(seen, key=lambda v: (v[2], v[4]))
                    if best[5] != 0 and (best[3] is None or day <= best[3]):
                        out.setdefault((session, asset, k, day, best[5]), []).append((o, value))
    return out


@pytest.mark.parametrize("seed, half_life, span", [(1, None, 200), (2, 30.0, 200), (3, 4.0, 3)])
def test_sweep_equals_every_pair(spark, monkeypatch, seed, half_life, span):
    """The sums and what they are made of; a short span spreads one session's events over several running sums."""
    monkeypatch.setattr(sweep, "SPAN", span)
    calendar, versions, events, cal, sources, exposures = random_history(spark, seed)
    # a session's decision must not come before the one before
    calendar = [(s, max(c for _, c in calendar[: i + 1])) for i, (s, c) in enumerate(calendar)]
    cal = pit.number_sessions(spark.createDataFrame(calendar, "session date, decision_at timestamp"))
    usable = pit.eligible_session(sources, cal, "extracted_at")
    want = every_pair(calendar, versions, events, 45)
    parts = sweep.contributions(usable, exposures, cal, 45).collect()
    got = {}
    for r in parts:
        got.setdefault((r["session"], r["asset"], r["source_key"], r["observed_on"], r["weight"]), []).extend(r["observation_ids"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(o for o, _ in v) for k, v in want.items()} and len(want) > 50
    sums = {}
    for (session, asset, _, day, weight), found in want.items():
        total = sums.setdefault((session, asset), [0.0, 0])
        scale = 1.0 if half_life is None else 2.0 ** (-(session - day).days / half_life)
        total[0] += sum(v for _, v in found) * weight * scale
        total[1] += len(found)
    got = {(r["session"], r["asset"]): (r["value"], r["n_events"]) for r in sweep.event_sum(usable, exposures, cal, 45, half_life).collect()}
    assert got.keys() == sums.keys()
    assert all(abs(got[k][0] - sums[k][0]) < 1e-9 * (1 + abs(sums[k][0])) and got[k][1] == sums[k][1] for k in sums)


@pytest.mark.parametrize("days", [1, 21])
def test_lineages_list_the_contributions(spark, days):
    """Ids in order, also where those of several days lie among each other (e10 between e1 and e2)."""
    _, _, _, cal, sources, exposures = random_history(spark, 4)
    coarse = F.date_add(F.lit("2020-01-01"), (F.floor(F.date_diff("observed_on", F.lit("2020-01-01")) / days) * days).cast("int"))
    usable = pit.eligible_session(sources.withColumn("observed_on", coarse), cal, "extracted_at")
    want = {}
    for r in sweep.contributions(usable, exposures, cal, 45).collect():
        want.setdefault((r["session"], r["asset"]), []).extend(f"{r['source_key']}:{i}" for i in r["observation_ids"])
    got = sweep.lineages(usable, exposures, cal, 45).collect()
    assert {(r["session"], r["asset"]): r["lineage"] for r in got} == {k: ",".join(sorted(v)) for k, v in want.items()} and len(got) == len(want) > 50
    assert sweep.lineages(usable.limit(0), exposures, cal, 45).count() == 0


def test_sweep_of_nothing(spark, feature):
    sources, exposures, calendar = feature
    usable = pit.eligible_session(sources, calendar, "published_at")
    assert sweep.event_sum(usable.limit(0), exposures, calendar, 30, 10.0).count() == 0
    assert sweep.event_sum(usable, exposures.limit(0), calendar, 30, 10.0).count() == 0
    assert sweep.contributions(usable, exposures, calendar.limit(0), 30).count() == 0


def test_versions_by_session_and_revisions_against_every_pair(spark):
    import random

    rng = random.Random(5)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    clock = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=n)
    dates = sorted(rng.sample(range(120), 30))
    calendar = pit.number_sessions(spark.createDataFrame([(day(n), clock(24 * n + 21)) for n in dates], "session date, decision_at timestamp"))
    rows = sorted({(rng.choice("AB"), day(rng.randrange(-20, 140)), clock(rng.randrange(-400, 24 * 140))) for _ in range(60)})
    rows = [(a, f, None if i % 2 else f + datetime.timedelta(rng.randrange(40)), k) for i, (a, f, k) in enumerate(rows)]
    want = set()
    for n in dates:
        for a in "AB":
            seen = [r for r in rows if r[0] == a and r[1] <= day(n) and r[3] <= clock(24 * n + 21)]
            if seen:
                best = max(seen, key=lambda r: (r[1], r[3]))
                if best[2] is None or day(n) <= best[2]:
                    want.add((day(n), a))
    got = pit.membership(spark.createDataFrame(rows, T.UNIVERSE), calendar).collect()
    assert {(r["session"], r["asset"]) for r in got} == want and len(got) == len(want)

    sources = [("s", rng.choice("xy"), rng.randrange(1, 32), clock(i), None if i % 5 == 0 else float(i), day(10 if i % 2 else 40)) for i in range(40)]
    sources = [(k, o, e, p, v, day(10 if o == "x" else 40)) for k, o, e, p, v, _ in sources]
    table = spark.createDataFrame(sources, "source_key string, observation_id string, eligible_index int, published_at timestamp, value double, observed_on date")
    for most in (None, 25):
        want = {}
        for i, n in enumerate(dates, 1):
            for o in "xy":
                seen = [r for r in sources if r[1] == o and r[2] <= i and (most is None or (day(n) - r[5]).days <= most)]
                if seen and max(seen, key=lambda r: r[3])[4] is not None:
                    want[i, o] = max(seen, key=lambda r: r[3])[4]
        got = pit.latest_revisions(table, calendar, most).collect()
        assert {(r["session_index"], r["observation_id"]): r["value"] for r in got} == want and len(got) == len(want)


def test_bars_meet_their_session(spark):
    """Sessions over midnight, over several days, nested and back to back, against a search."""
    import random

    rng = random.Random(3)
    clock = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(minutes=n)
    sessions = [("X", n, clock(s), clock(s + rng.choice([300, 600, 1500, 4000]))) for n, s in enumerate(sorted(rng.sample(range(0, 20000, 10), 40)))] + [("Y", 99, clock(1400), clock(1500))]
    bars = [("Y" if i % 9 == 0 else "X", f"a{i}", clock(o), clock(o + 30)) for i, o in enumerate(rng.choices(range(-500, 26000), k=400))] + [("Z", "none", clock(5), clock(6)), ("X", "null", None, None)]
    got = pit.bars_in_sessions(spark.createDataFrame(bars, "exchange string, asset string, open_at timestamp, end_at timestamp"), spark.createDataFrame(sessions, "exchange string, session int, open_at timestamp, close_at timestamp")).collect()
    want = {}
    for x, a, o, e in bars:
        last = max((s for s in sessions if s[0] == x and o is not None and s[2] <= o), key=lambda s: s[2], default=None)
        want[a] = last[1] if last and e <= last[3] else None
    assert {r["asset"]: r["session"] for r in got} == want and len(got) == len(bars)
    assert sum(v is not None for v in want.values()) > 100


def test_mapping_at_many_decisions(spark):
    """Rows and totals at every decision against a double loop."""
    import random

    rng = random.Random(6)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    clock = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=n)
    decisions = [(day(n), clock(24 * n + 12)) for n in (0, 7, 8, 30, 55, 90)]
    exposures = [(rng.choice("ABC"), rng.choice("st"), day(rng.randrange(-5, 95)), None if i % 3 else day(rng.randrange(100)), clock(rng.randrange(-100, 24 * 95)), rng.choice([0.5, -1.0, 2.0])) for i in range(40)]
    observations = [(rng.choice("stu"), i, None if i % 11 == 0 else float(i), clock(rng.randrange(-100, 24 * 95))) for i in range(50)]
    members, rows, totals = ["A", "B"], [], {}
    for dd, dt in decisions:
        for a, k, f, t, m, w in exposures:
            if a in members and f <= dd and (t is None or dd <= t) and m <= dt:
                for s, i, v, p in observations:
                    if s == k and p <= dt:
                        rows.append((dd, a, i, None if v is None else v * w, max(p, m)))
                        if v is not None:
                            n, total, last = totals.get((dd, a), (0, 0.0, p))
                            totals[dd, a] = (n + 1, total + v * w, max(last, p, m))
    e = spark.createDataFrame(exposures, T.EXPOSURE)
    o = spark.createDataFrame(observations, "source_key string, observation_id int, value double, published_at timestamp")
    m, d = spark.createDataFrame([(x,) for x in members + ["A"]], "asset string"), spark.createDataFrame(decisions, "decision_date date, decision_time timestamp")
    key = lambda r: tuple(map(str, r))
    got = [tuple(r) for r in pit.expand_exposures(o, e, m, d).select("decision_date", "asset", "observation_id", "asset_value", "known_at").collect()]
    assert sorted(got, key=key) == sorted(rows, key=key) and len(rows) > 100
    got = {(r["decision_date"], r["asset"]): (r["n"], r["total"], r["known_at"]) for r in pit.mapped_totals(o, e, m, d).collect()}
    assert got.keys() == totals.keys() and all(got[k][0] == totals[k][0] and abs(got[k][1] - totals[k][1]) < 1e-9 and got[k][2] == totals[k][2] for k in got)


def test_discovery_counts_make_no_pairs(spark):
    """Counts of shared-term pairs, with repeats, cases and nulls, from sets of terms: rows made do not grow with hypotheses times datasets."""
    dataset = "dataset_id long, tags array<string>, point_in_time boolean, allows_research boolean, allows_derived_features boolean, contains_personal_data boolean, license_verified_at timestamp"
    now = datetime.datetime(2024, 1, 1)
    tags = [["Red", "red", "Box"], ["box"], [None, "blue"], [], None, ["green"]]
    held = spark.createDataFrame([(i, tags[i % 6], True, True, True, i % 7 == 0, now) for i in range(300)] + [(1, ["red"], True, True, True, False, now)], dataset)
    asked = spark.createDataFrame([(i, [["RED", "box"], ["blue", None], ["none"], []][i % 4]) for i in range(200)] + [(None, ["green"]), (0, ["green"])], "hypothesis_id long, terms array<string>")
    want = {r[0]: r[1] for r in pit.discover(asked, held).groupBy("hypothesis_id").count().collect()}
    got = pit.discovery_counts(asked, held)
    assert {r["hypothesis_id"]: r["n"] for r in got.collect()} == want and len(want) == 101
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("dataset_id" in line and "hypothesis_id" in line for line in plan.splitlines())


def test_source_totals_are_those_of_the_expanded_rows(spark):
    """Counts, totals and distinct assets per decision and source, against the rows themselves; exposures are not spread over decisions."""
    import random

    rng = random.Random(7)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    clock = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=n)
    d = spark.createDataFrame([(day(n), clock(24 * n + 12)) for n in (0, 7, 8, 30, 55, 90)], "decision_date date, decision_time timestamp")
    e = spark.createDataFrame([(rng.choice("ABCD"), rng.choice("st"), day(rng.randrange(-5, 95)), None if i % 3 else day(rng.randrange(100)), clock(rng.randrange(-100, 24 * 95)), rng.choice([0.5, -1.0, None])) for i in range(60)], T.EXPOSURE)
    o = spark.createDataFrame([(rng.choice("stu"), i, None if i % 11 == 0 else float(i), clock(rng.randrange(-100, 24 * 95))) for i in range(90)], "source_key string, observation_id int, value double, published_at timestamp")
    m = spark.createDataFrame([("A",), ("B",), ("D",), ("A",)], "asset string")
    rows = pit.expand_exposures(o.where("value is not null"), e, m, d).where("datediff(decision_time, published_at) < 10")
    want = {r[:2]: r[2:] for r in rows.groupBy("decision_date", "source_key").agg(F.count("*"), F.sum("asset_value"), F.countDistinct("asset")).collect()}
    found = pit.source_totals(o, e, m, d, 10)
    got = {r[:2]: r[2:] for r in found.collect()}
    assert got.keys() == want.keys() and len(got) > 5
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) and got[k][2] == want[k][2] for k in got)
    assert "sequence(__first" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_early_features_count_equal_lines_apart(spark, tmp_path):
    """b19: a line that occurs twice is two rows, as in its SQL."""
    from __spark_entry__ import queries

    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    lines = [(1, 1, 1, 1, 5.0, 50.0, datetime.datetime(1995, 3, 30))] * 2 + [(2, 1, 1, 2, 5.0, 50.0, datetime.datetime(1995, 3, 3)), (3, 1, 1, 1, 5.0, 50.0, datetime.datetime(1995, 3, 30))]
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in queries()["b19_early_features"](spark, str(tmp_path)).collect()} == {(1, 2), (3, 1)}
