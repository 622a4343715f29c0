"""Data-quality checks. Each returns the violating rows; an empty result passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONED = r"(Z|[+-]\d\d:?\d\d)$"


def missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where any named column is NULL."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def naive_clocks(df: DataFrame, clock: str) -> DataFrame:
    """Rows whose clock text is missing, unparsable or without a zone."""
    text = F.col(clock)
    return df.where(~F.coalesce(text.rlike(ZONED) & F.try_to_timestamp(text).isNotNull(), F.lit(False)))


def non_finite(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value does not read as a finite number."""
    x = F.col(column).try_cast("double")
    return df.where(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def inverted(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.col(end) < F.col(start))


def unknown(df: DataFrame, allowed: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not in the allowed table."""
    return df.join(allowed.select(*keys).distinct(), list(keys), "left_anti")


def calendar_breaks(calendar: DataFrame) -> DataFrame:
    """Sessions whose decision precedes the open, or does not precede the next open and decision."""
    order = Window.partitionBy(F.lit(0)).orderBy("session")
    later = calendar.withColumn("next_open", F.lead("open_at").over(order)).withColumn("next_decision", F.lead("decision_at").over(order))
    return later.where("open_at > decision_at or decision_at >= next_open or open_at >= next_open or decision_at >= next_decision").drop("next_open", "next_decision")


def bad_bars(bars: DataFrame) -> DataFrame:
    """Bars with non-positive prices, prices outside [low, high], or negative volume."""
    prices = ("open", "high", "low", "close")
    positive = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in prices])
    inside = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return bars.where(~F.coalesce(positive & inside & (F.col("dollar_volume") >= 0), F.lit(False)))


def overlapping(df: DataFrame, key: list[str], start: str, end: str, touch: bool = False) -> DataFrame:
    """Rows that begin before the previous row of the key has ended (or as it ends, with ``touch``)."""
    before = F.lag(end).over(Window.partitionBy(*key).orderBy(start, end))
    clash = before >= F.col(start) if touch else before > F.col(start)
    return df.withColumn("__clash", clash).where("__clash").drop("__clash")


def holes(bars: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """Bars inside a held interval (entry_at, exit_at) whose end is not the next bar's open."""
    inside = bars.join(held, key).where("open_at >= entry_at and open_at < exit_at")
    following = F.lead("open_at").over(Window.partitionBy(*key).orderBy("open_at"))
    return inside.withColumn("next_open_at", following).where("next_open_at is not null and next_open_at <> end_at")


def misaligned_days(returns: DataFrame) -> DataFrame:
    """Days on which not every sleeve has a return: day, n_sleeves, n_total."""
    total = returns.agg(F.countDistinct("sleeve").alias("n_total"))
    days = returns.groupBy("day").agg(F.countDistinct("sleeve").alias("n_sleeves"))
    return days.join(F.broadcast(total)).where("n_sleeves <> n_total")


def late_training(returns: DataFrame, cutoff: Column) -> DataFrame:
    """Training returns published before their day or not before the test cutoff."""
    return returns.where((F.to_date("available_at") < F.col("day")) | (F.col("available_at") >= cutoff))


def conflicting(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys with more than one value of a column, and how many (n_values)."""
    return df.groupBy(*keys).agg(F.countDistinct(column).alias("n_values")).where("n_values > 1")


def unordered_clocks(sources: DataFrame) -> DataFrame:
    """Sources that break observed <= published <= retrieved <= extracted."""
    return sources.where("published_at > retrieved_at or retrieved_at > extracted_at or observed_on > to_date(published_at)")


def false_quotes(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans (source_hash, start, end, quote) that do not equal the archived text, or whose text is absent."""
    text = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return spans.join(documents, "source_hash", "left").where(~F.coalesce(text == F.col("quote"), F.lit(False))).select(*spans.columns)


def early_features(rows: DataFrame, sources: DataFrame, exposures: DataFrame, sessions: DataFrame) -> DataFrame:
    """Feature rows that depend on something not yet known at their session's decision.

    ``rows`` has session and contributions array<struct<source_id, exposure_id>>. Sources and exposures grow with the rows
    and are never broadcast.
    """
    parts = rows.select("feature_id", "session", F.explode("contributions").alias("c")).select("feature_id", "session", "c.*")
    known = parts.join(sources.select("source_id", F.col("usable_at").alias("source_at")).hint("merge"), "source_id", "left")
    known = known.join(exposures.select("exposure_id", F.col("available_at").alias("exposure_at")).hint("merge"), "exposure_id", "left")
    known = known.join(F.broadcast(sessions.select("session", "decision_at")), "session", "left")
    fine = (F.col("source_at") <= F.col("decision_at")) & (F.col("exposure_at") <= F.col("decision_at"))
    return known.where(~F.coalesce(fine, F.lit(False))).select("feature_id", "source_id", "exposure_id")


def before_calendar(sources: DataFrame, calendar: DataFrame, clock: str) -> DataFrame:
    """Sources whose clock precedes the first decision, so a session lag cannot be counted."""
    first = calendar.agg(F.min("decision_at").alias("first_decision"))
    return sources.join(F.broadcast(first)).where(F.col(clock) < F.col("first_decision")).drop("first_decision")


def unpriced(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Held (day, asset) without a bar."""
    return positions.join(bars.select("day", "asset"), ["day", "asset"], "left_anti")


def signalless(sleeves: DataFrame, signals: DataFrame, days: DataFrame, horizon_days: int) -> DataFrame:
    """Sleeves without any usable signal before any rebalance day."""
    age = F.datediff("decision_day", "day")
    wanted = F.broadcast(days.select(F.col("day").alias("decision_day")))
    usable = signals.select("strategy", "day").distinct().join(wanted, (F.col("day") < F.col("decision_day")) & (age <= horizon_days))
    return sleeves.join(usable.select("strategy").distinct(), "strategy", "left_anti")


# Fixed values of the URL policy.
LOCAL_HOST = r"^(localhost|metadata\.google\.internal|.*\.(localhost|local|internal))$"
SECRET_KEY = r"(?i)token|secret|password|api.?key|authorization|signature|credential"


def refused_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """URLs outside the public policy.

    Kept are plain ASCII https URLs of at most 4096 characters on the usual port of a public
    DNS host, without credentials, fragment, encoded control characters or a query key
    (decoded) that names a secret.
    """
    u = F.col(column)
    # characters that the parser refuses but the policy does not mind
    readable = F.regexp_replace(F.regexp_replace(u, r"%(?![0-9A-Fa-f]{2})", "_"), r'[|{}^`<>"]', "_")
    part = lambda name: F.try_parse_url(readable, F.lit(name))
    host, port = F.lower(part("HOST")), F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1)
    plain = host.rlike(r"^[a-z0-9]([a-z0-9.-]*[a-z0-9])?$") & ~host.contains("..") & ~host.rlike(LOCAL_HOST)
    ascii_ = ~u.rlike(r"[^\x21-\x7E]|\\") & ~u.rlike("%[01][0-9A-Fa-f]|%7[Ff]")
    key = lambda pair: F.try_url_decode(F.split(pair, "=")[0])
    secret = F.exists(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda pair: F.coalesce(key(pair).rlike(SECRET_KEY), F.lit(False)))
    open_ = part("USERINFO").isNull() & (F.coalesce(part("REF"), F.lit("")) == "")
    fine = (F.lower(part("PROTOCOL")) == "https") & plain & port.isin("", "443") & open_ & ascii_ & ~secret
    return urls.where(~F.coalesce(fine & (F.length(u) <= 4096), F.lit(False)))


def rule_pattern(rule: Column) -> Column:
    """A crawl rule as a regular expression: ``*`` is any run, a final ``$`` the end, the rest literal."""
    literal = F.regexp_replace(rule, r"([.\\+?^(){}|\[\]])", r"\\$1")
    ended = literal.endswith("$")
    body = F.regexp_replace(F.regexp_replace(literal, r"\$$", ""), r"\$", r"\\\$")
    return F.concat(F.lit("^"), F.regexp_replace(body, r"\*", ".*"), F.when(ended, "$").otherwise(""))


def crawl_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, allowed): the longest matching rule of the host decides, allow wins ties, none allows.

    ``urls`` has url, host, path; ``rules`` has host, rule, allow.
    """
    matched = urls.join(rules, "host").withColumn("pattern", rule_pattern(F.col("rule"))).where(F.expr("path rlike pattern"))
    best = matched.groupBy("url").agg(F.max(F.struct(F.length(F.regexp_replace("rule", r"\*|\$+$", "")).alias("n"), "allow"))["allow"].alias("allowed"))
    return urls.select("url").distinct().join(best, "url", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def refused_responses(responses: DataFrame, types: list[str], most_bytes: int) -> DataFrame:
    """Responses without status 200, of another media type, or over the byte cap."""
    kind = F.lower(F.trim(F.split("content_type", ";")[0]))
    return responses.where(~F.coalesce((F.col("status") == 200) & kind.isin(types) & (F.col("n_bytes") <= most_bytes), F.lit(False)))


def research_eligible() -> Column:
    """Whether a catalog row may be used: point in time, licence verified, both rights, no personal data."""
    rights = F.col("point_in_time") & F.col("allows_research") & F.col("allows_derived_features")
    return F.coalesce(rights & ~F.col("contains_personal_data") & F.col("license_verified_at").isNotNull(), F.lit(False))


def stale_signals(signals: DataFrame, most_age_seconds: int) -> DataFrame:
    """Signals from the future, too old at ingestion, or older than one ingested before; with the reason."""
    order = Window.partitionBy("book_id").orderBy("ingested_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max("available_at").over(order)
    age = F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("available_at").cast("timestamp"))
    reason = F.when(age < 0, "future").when(age > most_age_seconds * 1_000_000, "stale").when(F.col("available_at") < newest, "backdated")
    return signals.withColumn("reason", reason).where("reason is not null")


def bad_bar_batches(bars: DataFrame) -> DataFrame:
    """Bar events that are not one complete UTC day of distinct assets after the book's previous day."""
    events = bars.groupBy("book_id", "event_id").agg(F.min("day").alias("day"), F.countDistinct("day").alias("n_days"), F.count("*").alias("n"), F.countDistinct("asset").alias("n_assets"))
    before = F.lag("day").over(Window.partitionBy("book_id").orderBy("event_id"))
    return events.withColumn("previous", before).where("n_days > 1 or n <> n_assets or day <= previous").drop("previous")


def bad_probabilities(df: DataFrame, column: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose probability array has an entry outside [0, 1] or does not sum to one."""
    p = F.col(column)
    total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    fine = F.forall(p, lambda x: x.between(0, 1)) & (F.abs(total - 1) <= tolerance)
    return df.where(~F.coalesce(fine, F.lit(False)))


def bad_metrics(evidence: DataFrame) -> DataFrame:
    """Evidence rows outside their metric ranges."""
    fine = F.col("rank_ic").between(-1, 1) & F.col("similarity").between(0, 1)
    for c in ("turnover", "data_cost_usd", "complexity", "capacity_proxy_usd"):
        fine = fine & (F.col(c) >= 0)
    fine = fine & F.col("raw_p_value").between(0, 1) & (F.col("trial_count") >= 1) & F.forall("fold_metrics", lambda x: x.between(-1, 1))
    return evidence.where(~F.coalesce(fine, F.lit(False)))


def thin_sessions(panel: DataFrame, least: int) -> DataFrame:
    """Rows of sessions with at least ``least`` rows (the filter, not the violation)."""
    n = F.count("*").over(Window.partitionBy("session_index"))
    return panel.withColumn("__n", n).where(F.col("__n") >= least).drop("__n")
