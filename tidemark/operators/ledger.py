"""Append-only ledgers: verification, status and budget queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import stored

# Which status may follow which.
TRANSITIONS = {"proposed": ["screened", "rejected"], "screened": ["validated", "rejected"], "validated": ["accepted", "rejected"], "accepted": ["retired"], "rejected": [], "retired": []}
VALIDATOR, GUARDED = "numerical-validator", ["validated", "accepted"]


def entry_hash(*parts: Column | str) -> Column:
    """SHA-256 over an entry's parts joined by newlines."""
    return F.sha2(F.concat_ws("\n", *parts), 256)


def chain_breaks(entries: DataFrame) -> DataFrame:
    """Entries that break their run's chain, with the first reason.

    ``entries`` has run_id, sequence (from 0), previous_hash, payload, entry_hash. All runs are
    checked at once; an entry needs only its predecessor.
    """
    order = Window.partitionBy("run_id").orderBy("sequence")
    checked = entries.withColumn("__n", F.row_number().over(order) - 1).withColumn("__before", F.lag("entry_hash", 1, "GENESIS").over(order))
    expected = entry_hash(F.col("sequence").cast("string"), "payload", "previous_hash")
    reason = F.when(F.col("sequence") != F.col("__n"), "sequence").when(~F.col("previous_hash").eqNullSafe(F.col("__before")), "previous").when(~F.col("entry_hash").eqNullSafe(expected), "hash")
    return checked.withColumn("reason", reason).where("reason is not null").select("run_id", "sequence", "reason")


def bad_transitions(events: DataFrame, allowed: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Events (candidate_id, sequence, to_status, actor) that do not follow the allowed life cycle or actor rule."""
    before = F.lag("to_status").over(Window.partitionBy("candidate_id").orderBy("sequence"))
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs])
    first = F.col("from_status").isNull() & (F.col("to_status") == "proposed")
    step = F.array_contains(pairs, F.concat_ws(">", "from_status", "to_status")) & F.col("from_status").isNotNull()
    actor = ~F.col("to_status").isin(GUARDED) | (F.col("actor") == VALIDATOR)
    return events.withColumn("from_status", before).where(~((first | step) & actor)).select("candidate_id", "sequence", "from_status", "to_status", "actor")


def current_status(events: DataFrame, key: str = "candidate_id", status: str = "to_status") -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, "sequence").alias("status"), F.count("*").alias("n_events"))


def open_trials(trials: DataFrame) -> DataFrame:
    """Started trials without a terminal event."""
    done = trials.where(F.col("status").isin("completed", "failed", "abandoned"))
    return trials.where("status = 'started'").join(done.select("trial_id").distinct(), "trial_id", "left_anti")


def reserve_trials(requests: DataFrame, max_trials: int) -> DataFrame:
    """First request of each (run, candidate hash), numbered per run, within the run's budget."""
    first = F.row_number().over(Window.partitionBy("run_id", "candidate_hash").orderBy("requested"))
    unique = requests.withColumn("__k", first).where("__k = 1").drop("__k")
    index = F.row_number().over(Window.partitionBy("run_id").orderBy("requested"))
    return unique.withColumn("reservation_index", index).where(F.col("reservation_index") <= max_trials)


def development_feedback(records: DataFrame, newest: int) -> DataFrame:
    """Newest completed development trials with their candidate's expression.

    ``records`` has sequence and payload (JSON) with kind, trial_id, candidate_hash, expression, scope, status, rank_ic.
    """
    schema = "kind string, trial_id string, candidate_hash string, expression string, scope string, status string, rank_ic double"
    rows = records.select("sequence", F.from_json("payload", schema).alias("e")).select("sequence", "e.*")
    registered = rows.where("kind = 'candidate_registered'").select("candidate_hash", "expression")
    reserved = rows.where("kind = 'trial_reserved'").select("trial_id", "candidate_hash")
    completed = rows.where("kind = 'trial_completed' and scope = 'development'").select("sequence", "trial_id", "status", "rank_ic")
    joined = completed.join(reserved, "trial_id").join(registered, "candidate_hash")
    return joined.orderBy(F.desc("sequence")).limit(newest).select("sequence", "trial_id", "expression", "status", "rank_ic")


def page(records: DataFrame, after: int, limit: int) -> DataFrame:
    """The next ``limit`` records after a sequence number."""
    return records.where(F.col("sequence") > after).orderBy("sequence").limit(limit)


def index_counts(records: DataFrame, kind: str = "kind") -> DataFrame:
    return records.groupBy(kind).agg(F.count("*").alias("n"))


def replay_differences(stored: DataFrame, recomputed: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose stored value is missing, extra, or off by more than the tolerance."""
    a, b = stored.select(*keys, F.col(value).alias("stored")), recomputed.select(*keys, F.col(value).alias("recomputed"))
    fine = F.abs(F.col("stored") - F.col("recomputed")) <= tolerance
    return a.join(b, keys, "full").where(~F.coalesce(fine, F.lit(False)))


def reused_ids(events: DataFrame) -> DataFrame:
    """Event ids that arrived with more than one payload."""
    return events.groupBy("book_id", "event_id").agg(F.countDistinct(F.sha2("payload", 256)).alias("n_payloads")).where("n_payloads > 1")


def usage(events: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """Attempts and bytes (or other amounts) used per key against its budget, and whether it is exceeded."""
    used = events.groupBy(key).agg(F.count("*").alias("attempts"), F.sum("amount").alias("used"))
    out = budgets.join(used, key, "left").na.fill(0, ["attempts", "used"])
    return out.withColumn("exceeded", (F.col("attempts") > F.col("max_attempts")) | (F.col("used") > F.col("max_amount")))


# Fixed values of the default reward policy are parameters here, in the order of the components.
def reward(evidence: DataFrame, *, information: float, incremental: float, stability: float, regime: float, similarity: float, turnover: float, cost: float, cost_scale: float, complexity: float, min_ic: float, min_incremental: float, min_stability: float, max_p: float, max_similarity: float, max_turnover: float, min_capacity: float) -> DataFrame:
    """Reward of each evidence row and whether all its gates hold; a failed gate gives no reward.

    Sealed rows are refused before scoring; rows without fold metrics give none.
    """
    folds = F.col("fold_metrics")
    n = F.size(folds)
    share = F.try_divide(F.size(F.filter(folds, lambda x: x > 0)).cast("double"), n)
    p = F.least(F.lit(1.0), F.col("raw_p_value") * F.col("trial_count"))
    states = F.col("regime_rank_ics")
    mean_state = F.try_divide(F.aggregate(states, F.lit(0.0), lambda a, b: a + b), F.size(states))
    semantic = ~F.col("agent_kind").isin("alternative_data", "alternative_dataset_creator") | F.coalesce("semantic_chain_verified", F.lit(False))
    gates = {
        "point_in_time": F.col("point_in_time_verified"),
        "lineage": F.col("lineage_verified"),
        "persistent": (n >= 2) & (share >= 0.6),
        "rank_ic": F.col("rank_ic") >= min_ic,
        "incremental": F.coalesce(F.col("incremental_rank_ic") >= min_incremental, F.lit(False)),
        "states": F.size(states) >= 2,
        "stability": share >= min_stability,
        "multiple_testing": p <= max_p,
        "similarity": F.col("similarity") <= max_similarity,
        "turnover": F.col("turnover") <= max_turnover,
        "capacity": F.col("capacity_proxy_usd") >= min_capacity,
        "semantic": semantic,
    }
    total = (
        F.col("rank_ic") * information
        + F.coalesce(F.col("incremental_rank_ic") * incremental, F.lit(0.0))
        + share * stability
        + F.when(F.size(states) > 0, F.greatest(F.lit(0.0), mean_state) * regime).otherwise(0.0)
        - F.col("similarity") * similarity
        - F.col("turnover") * turnover
        - F.col("data_cost_usd") / cost_scale * cost
        - F.col("complexity") * complexity
        - F.sqrt("trial_count") / 100
    )
    out = evidence.where(~F.col("sealed") & (n > 0)).withColumn("gates", F.struct(*[F.coalesce(g, F.lit(False)).alias(k) for k, g in gates.items()]))
    eligible = F.forall(F.array(*[F.col(f"gates.{k}") for k in gates]), lambda g: g)
    return out.withColumn("eligible", eligible).withColumn("diagnostic", total).withColumn("reward", F.when(F.col("eligible"), total).otherwise(0.0)).withColumn("adjusted_p", p).withColumn("stability", share)


def leaderboard(scored: DataFrame, runs: int | None = None) -> DataFrame:
    """Eligible first, then by reward, with places (ties by candidate).

    Rows are cut into ``runs`` of neighbouring places and written; a place is the rank within
    the run plus the rows of the runs before it, so no task sees all candidates.
    """
    order = [F.desc("eligible"), F.desc("reward"), F.asc("candidate_id")]
    runs = runs or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(scored.repartitionByRange(runs, *order).withColumn("__run", F.spark_partition_id()))
    sizes = cut.groupBy("__run").agg(F.count("*").alias("__n"))  # one row a run
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__run")) - F.col("__n")
    within = F.row_number().over(Window.partitionBy("__run").orderBy(*order))
    placed = cut.withColumn("place", within).join(F.broadcast(sizes.select("__run", before.alias("__before"))), "__run")
    return placed.withColumn("place", (F.col("place") + F.col("__before")).cast("int")).drop("__run", "__before")


def semantic_score(evidence: DataFrame, cost_scale: float = 1000.0, similarity: float = 1.0, complexity: float = 0.05, instability: float = 1.0) -> DataFrame:
    score = (
        F.col("abnormal_return_information")
        + 0.5 * F.col("earnings_surprise_information")
        + 0.25 * F.col("fundamental_information")
        - similarity * F.col("library_similarity")
        - F.col("monthly_data_cost_usd") / cost_scale
        - complexity * F.col("complexity")
        - instability * F.col("instability")
    )
    return evidence.withColumn("score", score)


def recent_memory(records: DataFrame, newest: int) -> DataFrame:
    """The newest records that are not sealed."""
    return records.where("not sealed").orderBy(F.desc("file_name")).limit(newest)


def dispatch_ready(proposals: DataFrame, books: DataFrame, now: Column, day: Column, most: int = 200) -> DataFrame:
    """Approved (or approval-free) unexpired proposals of the current book revision within the daily cap, oldest first."""
    policy = "approval_required boolean, max_daily_notional double"
    b = books.select("book", "revision", F.from_json("policy", policy).alias("p")).select("book", "revision", "p.*")
    reserved = proposals.where(F.col("reserved_day") == day).groupBy("book").agg(F.sum("notional").alias("reserved"))
    ok = (F.col("state") == "approved") | ((F.col("state") == "pending") & ~F.col("approval_required"))
    joined = proposals.join(b, ["book", "revision"]).join(reserved, "book", "left")
    ready = joined.where((F.col("expires") > now) & ok & (F.col("notional") + F.coalesce("reserved", F.lit(0.0)) <= F.col("max_daily_notional")))
    return ready.orderBy("created", "id").limit(most)


def risky_proposals(proposals: DataFrame, books: DataFrame, now: Column) -> DataFrame:
    """Proposals outside their book's policy: notional, symbol list, 2 % price collar, 60 s quote."""
    policy = "symbols array<string>, max_order_notional double"
    b = books.select("book", F.from_json("policy", policy).alias("p")).select("book", "p.*")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("quote_at").cast("timestamp"))
    fine = (
        (F.col("quantity") * F.col("limit_price") <= F.col("max_order_notional"))
        & F.array_contains("symbols", F.col("symbol"))
        & (F.abs(F.try_divide(F.col("limit_price"), F.col("reference_price")) - 1) <= 0.02)
        & age.between(0, 60_000_000)
    )
    return proposals.join(b, "book", "left").where(~F.coalesce(fine, F.lit(False))).select(*proposals.columns)
