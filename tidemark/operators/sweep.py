"""Event features as a sweep over sessions.

An event (observation) counts from one session to another, and an exposure version rules a
(source, observed day, asset) from one session to another. Neither is spread over the
sessions between: both enter as differences, +x where it begins and -x where it ends, whose
running sums per asset are the feature. A half-life is a geometric scale: a value observed
on day o weighs 2 ** (o / half life) in the sums, and a session's sum is scaled back by its own date;
``SPAN`` half-lives share one sum, so that no scale leaves the range of doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import stored

from .pit import first_session, months, revision_runs

#: Half-lives that share one running sum.
SPAN = 200


def event_runs(sources: DataFrame, calendar: DataFrame, max_age_days: int) -> DataFrame:
    """Sessions ``first`` to ``last`` in which each revision is the latest one, real, and 0 to ``max_age_days`` old.

    ``sources`` is that of ``pit.latest_revisions``. Written once, as its days, their ends and its steps are all needed.
    """
    runs = revision_runs(sources, calendar, max_age_days)
    seen = first_session(runs, calendar, "session", "observed_on", "__seen")
    out = seen.select("source_key", "observation_id", "observed_on", "value", F.greatest("__from", "__seen").alias("first"), F.col("__until").alias("last"))
    return stored(out.where("first <= last"))


def weight_runs(exposures: DataFrame, days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions ``first`` to ``last`` in which a weight rules: source_key, observed_on, asset, first, last, weight.

    ``days`` has source_key, observed_on and the sessions lo to hi that matter to it. Of the versions with
    valid_from <= observed_on that the session's decision knows, the latest by (valid_from, available_at) rules;
    zero weights and versions that ended before the day give no run.

    Time is cut into months. Versions whose valid_from and first session both lie before a day's month
    compete once per month, not per day: one carried row stands for them; others meet the days of the months
    they span. All windows are over parts of (source_key, asset), by which versions are dealt once.
    """
    keys = ["source_key", "asset"]
    known = exposures.where("valid_from is not null and available_at is not null").select(*keys, "valid_from", F.col("available_at").cast("timestamp").alias("known"), "weight", "valid_to")
    known = first_session(known.repartition(*keys), calendar, "decision_at", "known", "at")
    # a version's second month is that of the session it is first known at; later than all sessions it never rules
    dates = calendar.select(F.col("session_index").alias("at"), months(F.col("session")).alias("seen"))
    version = F.struct("valid_from", "known", "at", "weight", "valid_to").alias("v")
    known = known.join(F.broadcast(dates), "at").select(*keys, version, F.least(months(F.col("valid_from")), "seen").alias("lo"), F.greatest(months(F.col("valid_from")), "seen").alias("hi"))

    moving = known.select(*keys, F.explode(F.sequence("lo", "hi")).alias("month"), "v")
    order = Window.partitionBy(*keys).orderBy("hi")
    settled = known.select(*keys, (F.col("hi") + 1).alias("since"), F.lead("hi").over(order).alias("next"), F.max("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("v"))
    final = days.agg(F.max(months(F.col("observed_on"))).alias("final"))
    settled = settled.join(F.broadcast(final)).withColumn("until", F.least(F.coalesce("next", "final"), "final"))
    carried = settled.where("since <= until").select(*keys, F.explode(F.sequence("since", "until")).alias("month"), "v")

    # days of one source and month ride in an array, so candidates meet them by an equality
    listed = days.groupBy("source_key", months(F.col("observed_on")).alias("month")).agg(F.collect_list(F.struct("observed_on", "lo", "hi")).alias("days"))
    met = moving.unionByName(carried).join(listed, ["source_key", "month"])
    met = met.select(*keys, "v", F.explode(F.filter("days", lambda d: d["observed_on"] >= F.col("v.valid_from"))).alias("d")).select(*keys, "d.*", "v").where("v.at <= hi")
    by_clock = Window.partitionBy(*keys, "observed_on").orderBy("v.at")
    ruling = met.select(*keys, "observed_on", "lo", "hi", F.col("v.at").alias("at"), F.lead("v.at").over(by_clock).alias("next"), F.max("v").over(by_clock.rowsBetween(Window.unboundedPreceding, 0)).alias("v"))
    runs = ruling.select(*keys, "observed_on", "v.weight", "v.valid_to", F.greatest("at", "lo").alias("first"), F.least(F.coalesce(F.col("next") - 1, "hi"), "hi").alias("last"), "hi")
    return runs.where("first <= last and weight <> 0 and (valid_to is null or observed_on <= valid_to)").drop("valid_to")


def live_days(events: DataFrame) -> DataFrame:
    """Per source and observed day the sessions in which any of its events counts."""
    return events.groupBy("source_key", "observed_on").agg(F.min("first").alias("lo"), F.max("last").alias("hi"))


def event_sum(sources: DataFrame, exposures: DataFrame, calendar: DataFrame, max_age_days: int, half_life_days: float | None = None) -> DataFrame:
    """Sum over active events of value x exposure on the observed day x decay, per session and asset: value, n_events."""
    events = event_runs(sources, calendar, max_age_days)
    edge = lambda at, sign: F.struct(at.alias("at"), (sign * F.col("value")).alias("dv"), F.lit(sign).alias("dn"))
    steps = events.select("source_key", "observed_on", F.explode(F.array(edge(F.col("first"), 1), edge(F.col("last") + 1, -1))).alias("e"))
    steps = steps.groupBy("source_key", "observed_on", "e.at").agg(F.sum("e.dv").alias("dv"), F.sum("e.dn").alias("dn"))
    weights = weight_runs(exposures, live_days(events), calendar)

    day = lambda c: F.unix_date(F.col(c)).cast("double")
    bucket = F.lit(0).cast("long") if half_life_days is None else F.floor(day("observed_on") / (SPAN * half_life_days))
    scale = F.lit(1.0) if half_life_days is None else F.pow(F.lit(2.0), day("observed_on") / half_life_days - bucket * SPAN)
    steps = steps.withColumn("bucket", bucket).withColumn("dv", F.col("dv") * scale)
    # a weight begins and ends as a difference too (not where it rules to the end of its day's events, which sum to nothing
    # there); a pair of differences counts from the later of the two
    turn = lambda at, sign: F.struct(at.alias("at"), (sign * F.col("weight")).alias("dw"), F.lit(sign).alias("sign"))
    begun, ended = turn(F.col("first"), 1), turn(F.col("last") + 1, -1)
    turns = weights.select("source_key", "observed_on", "asset", F.explode(F.when(F.col("last") == F.col("hi"), F.array(begun)).otherwise(F.array(begun, ended))).alias("w"))
    both = turns.join(steps.withColumnRenamed("at", "step"), ["source_key", "observed_on"])
    diffs = both.select("asset", "bucket", F.greatest("w.at", "step").alias("at"), (F.col("w.dw") * F.col("dv")).alias("c"), (F.col("w.sign") * F.col("dn")).alias("n"))
    diffs = diffs.groupBy("asset", "bucket", "at").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))

    order = Window.partitionBy("asset", "bucket").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = diffs.select("asset", "bucket", "at", F.lead("at").over(order).alias("next"), F.sum("c").over(upto).alias("c"), F.sum("n").over(upto).alias("n")).where("n > 0")
    sessions = calendar.select("session", "session_index")
    sums = sums.join(F.broadcast(sessions.agg(F.max("session_index").alias("end")))).withColumn("until", F.least(F.coalesce(F.col("next") - 1, "end"), "end"))
    live = sums.where("at <= until").withColumn("session_index", F.explode(F.sequence("at", "until"))).join(F.broadcast(sessions), "session_index")
    back = F.lit(1.0) if half_life_days is None else F.pow(F.lit(2.0), F.col("bucket") * SPAN - day("session") / half_life_days)
    return live.groupBy("session", "asset").agg(F.sum(F.col("c") * back).alias("value"), F.sum("n").alias("n_events"))


def contributions(sources: DataFrame, exposures: DataFrame, calendar: DataFrame, max_age_days: int) -> DataFrame:
    """What event_sum adds up: session, asset, source_key, observed_on, weight and the ids of the events there, in order.

    Events that count in the same sessions ride in one array, and runs are spread over sessions last.
    """
    events = event_runs(sources, calendar, max_age_days)
    groups = events.groupBy("source_key", "observed_on", F.col("first").alias("since"), F.col("last").alias("until")).agg(F.sort_array(F.collect_list("observation_id")).alias("observation_ids"))
    weights = weight_runs(exposures, live_days(events), calendar).drop("hi")
    runs = weights.join(groups, ["source_key", "observed_on"]).withColumn("first", F.greatest("first", "since")).withColumn("last", F.least("last", "until")).where("first <= last")
    spread = runs.withColumn("session_index", F.explode(F.sequence("first", "last")))
    return spread.join(F.broadcast(calendar.select("session", "session_index")), "session_index").select("session", "asset", "source_key", "observed_on", "weight", "observation_ids")


def lineages(sources: DataFrame, exposures: DataFrame, calendar: DataFrame, max_age_days: int) -> DataFrame:
    """The ids ``source_key:observation_id`` that event_sum adds up, per session and asset: session, asset, lineage (ids in order, joined by commas).

    What counts of a source's day in a session is the same for every asset, so its ids are joined once and have a
    number there, in the order of ids; an asset's rows are numbers, which are sorted and spelt out last. Days of a session whose
    ids lie among each other have a number for every id.
    """
    events = event_runs(sources, calendar, max_age_days)
    weights = weight_runs(exposures, live_days(events), calendar)
    day = ["session_index", "source_key", "observed_on"]
    spread = events.withColumn("session_index", F.explode(F.sequence("first", "last")))
    ids = spread.groupBy(*day).agg(F.sort_array(F.collect_list(F.concat_ws(":", "source_key", "observation_id"))).alias("ids")).withColumn("text", F.array_join("ids", ","))
    order = Window.partitionBy("session_index").orderBy("text", "source_key", "observed_on")
    ids = ids.withColumn("follows", F.coalesce(F.lag(F.element_at("ids", -1)).over(order) <= F.element_at("ids", 1), F.lit(True)))
    apart = F.min("follows").over(Window.partitionBy("session_index"))
    parts = ids.withColumn("apart", apart).select(*day, F.explode(F.when(F.col("apart"), F.array("text")).otherwise(F.col("ids"))).alias("part"))
    parts = stored(parts.withColumn("number", F.row_number().over(Window.partitionBy("session_index").orderBy("part", "source_key", "observed_on"))))
    numbered = parts.groupBy(*day).agg(F.collect_list("number").alias("numbers"))
    listed = numbered.groupBy("source_key", "observed_on").agg(F.collect_list(F.struct("session_index", "numbers")).alias("live"))
    ruled = F.filter("live", lambda x: x["session_index"].between(F.col("first"), F.col("last")))
    rows = weights.join(listed, ["source_key", "observed_on"]).select("asset", F.explode(ruled).alias("x")).select("asset", "x.*")
    held = rows.groupBy("session_index", "asset").agg(F.array_sort(F.flatten(F.collect_list("numbers"))).alias("numbers"))
    # numbers run from 1 without gaps, so a session's parts in their order are found by place
    spelt = parts.groupBy("session_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "part"))), lambda x: x["part"]).alias("parts"))
    spelt = spelt.join(F.broadcast(calendar.select("session", "session_index")), "session_index")
    out = held.join(spelt, "session_index")
    return out.select("session", "asset", F.array_join(F.transform("numbers", lambda n: F.element_at("parts", n)), ",").alias("lineage"))
