"""Activity analytics over the event logs, in one pass per log where possible."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordlists import (
    ACTION_GROUPS,
    EVENT_GROUPS,
    FEATURE_LABELS,
    OVERVIEW_GROUPS,
    SECURITY_ACTIONS,
)


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def resolve_range(
    today: dt.date, start: dt.date | None = None, end: dt.date | None = None, preset: str = "",
    max_days: int = 366, clamp_to_today: bool = False,
) -> tuple[dt.date, dt.date]:
    """Report range: presets, default of the last seven days, swapped and cut to ``max_days``."""
    spans = {"today": 0, "7d": 6, "30d": 29}
    if preset in spans:
        start, end = today - dt.timedelta(days=spans[preset]), today
    start = start or today - dt.timedelta(days=6)
    end = end or today
    if end < start:
        start, end = end, start
    if clamp_to_today and end > today:
        end, start = today, min(start, today)
    if (end - start).days > max_days - 1:
        start = end - dt.timedelta(days=max_days - 1)
    return start, end


def in_range(start, end, day: str = "day") -> Column:
    return F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def search_counters(events: DataFrame) -> DataFrame:
    """Search-log counters per user."""
    kind, results = F.col("event_type"), F.coalesce("result_count", F.lit(0))
    search = kind == "SEARCH"
    return events.groupBy("user_id").agg(
        F.count_if(search).alias("searches"),
        F.count_if(kind == "FILTER").alias("filters"),
        F.count_if(kind == "CLIENT_MATCH").alias("client_matches"),
        F.count_if(search & (results == 0)).alias("zero_results"),
        F.count_if(search & (results > 0)).alias("successful"),
    )


def activity_counters(activity: DataFrame) -> DataFrame:
    action = F.col("action")
    return activity.groupBy("user_id").agg(
        F.count_if(action == "SERVICE_VIEW").alias("views"),
        F.count_if(action == "SERVICE_SAVE").alias("saves"),
        F.count_if(action == "SERVICE_UNSAVE").alias("unsaves"),
        F.count_if(action == "LOGIN").alias("logins"),
    )


def period_counters(events: DataFrame, activity: DataFrame) -> DataFrame:
    """Both logs per user; users in only one log have zeros for the other."""
    both = search_counters(events).join(activity_counters(activity), "user_id", "full")
    return both.fillna(0)


def unique_queries(events: DataFrame) -> DataFrame:
    kept = events.where("event_type = 'SEARCH' AND query <> ''")
    return kept.groupBy("user_id").agg(F.countDistinct("query").alias("unique_queries"))


def day_spine(spark, start, end) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )


def daily_counts(events: DataFrame, start, end, types: list[str]) -> DataFrame:
    """Events per day and type with zeros for empty days."""
    counts = (
        events.where(in_range(start, end) & F.col("event_type").isin(*types))
        .groupBy("day").pivot("event_type", types).agg(F.count(F.lit(1)))
    )
    return day_spine(events.sparkSession, start, end).join(counts, "day", "left").fillna(0)


def month_grid(events: DataFrame, month: dt.date) -> DataFrame:
    """Search counts on the padded, Monday-first calendar weeks of a month."""
    first = month.replace(day=1)
    last = (first + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)
    start = first - dt.timedelta(days=first.weekday())
    end = last + dt.timedelta(days=6 - last.weekday())
    grid = daily_counts(events, start, end, ["SEARCH"])
    return grid.select(
        "day", F.floor(F.datediff("day", F.lit(start)) / 7).cast("bigint").alias("week"),
        F.col("day").between(F.lit(first), F.lit(last)).alias("in_month"), F.col("SEARCH").alias("searches"),
    )


def top_queries(events: DataFrame, k: int, zero_only: bool = False) -> DataFrame:
    kept = events.where("event_type = 'SEARCH' AND query <> ''")
    if zero_only:
        kept = kept.where(F.coalesce("result_count", F.lit(0)) == 0)
    return kept.groupBy("query").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "query").limit(k)


def top_queries_per_user(events: DataFrame, k: int) -> DataFrame:
    kept = events.where("event_type = 'SEARCH' AND query <> ''")
    counts = kept.groupBy("user_id", "query").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("user_id").orderBy(F.desc("total"), "query")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_viewed(activity: DataFrame, services: DataFrame, k: int = 8) -> DataFrame:
    """Most viewed targets; targets that are no known service drop out after the cut."""
    views = activity.where("action = 'SERVICE_VIEW' AND target_id <> ''")
    top = views.groupBy("target_id").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "target_id").limit(k)
    named = services.select(F.col("id").cast("string").alias("target_id"), "title")
    return top.join(named, "target_id")


def activity_groups(events: DataFrame, activity: DataFrame, by: list[str]) -> DataFrame:
    """Counts per activity group. Searches, filters and matches count from the search log only."""
    left = events.where(F.col("event_type").isin(*EVENT_GROUPS)).select(
        *by, _lookup(EVENT_GROUPS, F.col("event_type")).alias("grp")
    )
    right = activity.where(~F.col("action").isin(*EVENT_GROUPS)).select(
        *by, F.coalesce(_lookup(ACTION_GROUPS, F.col("action")), F.lit("other")).alias("grp")
    )
    counts = [x.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("n")) for x in (left, right)]
    return counts[0].unionByName(counts[1]).groupBy(*by, "grp").agg(F.sum("n").alias("n"))


def with_shares(groups: DataFrame) -> DataFrame:
    """Percent of the total and width relative to the largest group (half-even rounding)."""
    every = Window.partitionBy(F.lit(1))  # at most nine group rows
    return groups.select(
        "*",
        F.bround(F.col("n") / F.sum("n").over(every) * 100).cast("bigint").alias("percentage"),
        F.when(F.col("n") == 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(4.0), F.bround(F.col("n") / F.max("n").over(every) * 100, 2))
        ).alias("relative_width"),
    )


def overview(groups: DataFrame) -> DataFrame:
    rolled = groups.withColumn("area", _lookup(OVERVIEW_GROUPS, F.col("grp")))
    return rolled.groupBy("area").agg(F.sum("n").alias("n"))


def donut(areas: DataFrame) -> DataFrame:
    """Share and running start offset of each overview area, in display order."""
    order = {name: i for i, name in enumerate(dict.fromkeys(OVERVIEW_GROUPS.values()))}
    ranked = areas.withColumn("ord", _lookup(order, F.col("area")))
    every = Window.partitionBy(F.lit(1))  # five area rows
    before = every.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("n") / F.sum("n").over(every) * 100
    out = ranked.select("area", "ord", "n", share.alias("share"))
    return out.select("area", "n", "share", F.coalesce(F.sum("share").over(before), F.lit(0.0)).alias("offset"))


def hour_profile(events: DataFrame) -> DataFrame:
    """Per user: peak hour (later hour on ties), its label and the most used feature."""
    hours = events.groupBy("user_id", F.hour("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    peak = hours.groupBy("user_id").agg(F.max(F.struct("n", "hour")).alias("p"))
    kinds = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    used = kinds.groupBy("user_id").agg(F.max(F.struct("n", "event_type")).alias("u"))
    hour = F.col("p.hour")
    return peak.join(used, "user_id").select(
        "user_id",
        hour.cast("bigint").alias("peak_hour"),
        F.format_string("%02d:00–%02d:00", hour, (hour + 1) % 24).alias("peak_period"),
        F.coalesce(_lookup(FEATURE_LABELS, F.col("u.event_type")), F.col("u.event_type")).alias("feature"),
    )


def day_detail(events: DataFrame) -> DataFrame:
    kind, results = F.col("event_type"), F.coalesce("result_count", F.lit(0))
    return events.groupBy("user_id", "day").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(kind == "SEARCH").alias("searches"),
        F.count_if(kind == "FILTER").alias("filters"),
        F.count_if(kind == "CLIENT_MATCH").alias("matches"),
        F.count_if(kind == "SUGGESTION_CLICK").alias("suggestions"),
        F.count_if((kind == "SEARCH") & (results > 0)).alias("successful"),
        F.count_if((kind == "SEARCH") & (results == 0)).alias("zero_results"),
        F.sum(results).alias("total_results"),
    )


def clock_columns(ts: str = "created_at") -> list[Column]:
    """12-hour time and position in the day as a percentage."""
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return [
        F.date_format(ts, "hh:mm a").alias("console_time"),
        F.bround(minutes / 1440 * 100, 2).alias("timeline_pct"),
    ]


def recent_feed(events: DataFrame, activity: DataFrame, k: int = 12) -> DataFrame:
    """Newest entries of both logs with their group and wording."""
    described = (
        F.when(F.col("event_type") == "CLIENT_MATCH", "Checked suitable services for a client")
        .when(F.col("event_type") == "FILTER", "Applied Service Library filters")
        .when(F.col("query") != "", F.concat(F.lit('Searched for "'), "query", F.lit('"')))
        .otherwise("Completed a Toolkit search")
    )
    n = F.coalesce("result_count", F.lit(0))
    a = events.where(F.col("event_type").isin(*EVENT_GROUPS)).select(
        "created_at", "id", _lookup(EVENT_GROUPS, F.col("event_type")).alias("grp"), described.alias("description"),
        F.concat(n.cast("string"), F.when(n == 1, " result").otherwise(" results")).alias("detail"),
    )
    b = activity.where(~F.col("action").isin(*EVENT_GROUPS)).select(
        "created_at", "id", F.coalesce(_lookup(ACTION_GROUPS, F.col("action")), F.lit("other")).alias("grp"),
        "description", F.initcap(F.regexp_replace(F.lower("action"), "_", " ")).alias("detail"),
    )
    order = [F.desc("created_at"), F.desc("id")]
    return a.orderBy(*order).limit(k).unionByName(b.orderBy(*order).limit(k)).orderBy(*order).limit(k)


def activity_log_search(activity: DataFrame, users: DataFrame, action: str = "", query: str = "") -> DataFrame:
    from .catalogue import text_filter

    rows = activity.join(users.select(F.col("id").alias("user_id"), "username", "employee_id"), "user_id", "left")
    if action:
        rows = rows.where(F.col("action") == action)
    if query:
        rows = rows.where(text_filter(query, ["description", "username", "employee_id", "ip_address"]))
    return rows


def retention_split(now: dt.datetime, days: int, security_days: int, ts: str, action: str | None = None) -> Column:
    """True for rows past their window. Security actions keep the longer window."""
    if days < 1 or security_days < 1:
        raise ValueError("retention windows must be at least one day")
    if security_days < days:
        raise ValueError("security window is shorter than the routine window")
    old = F.col(ts) < F.lit(now - dt.timedelta(days=days))
    if action is None:
        return old
    very_old = F.col(ts) < F.lit(now - dt.timedelta(days=security_days))
    return F.when(F.col(action).isin(*SECURITY_ACTIONS), very_old).otherwise(old)


def retention_counts(activity: DataFrame, sessions: DataFrame, events: DataFrame, now, days=365, security_days=730):
    """Dry run: rows each table would lose."""
    expired = retention_split(now, days, security_days, "created_at", "action")
    secure = F.col("action").isin(*SECURITY_ACTIONS)
    a = activity.agg(
        F.count_if(expired & ~secure).alias("activity_routine"), F.count_if(expired & secure).alias("activity_security")
    ).unpivot([], ["activity_routine", "activity_security"], "source", "removed")
    old = retention_split(now, days, security_days, "created_at")
    b = sessions.agg(F.count_if(old).alias("login_session")).unpivot([], ["login_session"], "source", "removed")
    c = events.agg(F.count_if(old).alias("search_event")).unpivot([], ["search_event"], "source", "removed")
    return a.unionByName(b).unionByName(c)


def saved_state(activity: DataFrame) -> DataFrame:
    """Saved services per user: the last SAVE or UNSAVE of a pair wins."""
    toggles = activity.where(F.col("action").isin("SERVICE_SAVE", "SERVICE_UNSAVE"))
    last = toggles.groupBy("user_id", "target_id").agg(F.max_by("action", F.struct("created_at", "id")).alias("action"))
    return last.where("action = 'SERVICE_SAVE'").select("user_id", "target_id")


def table_profile(name: str, df: DataFrame, key: str) -> DataFrame:
    """Row count, key distinctness and NULL total of one table."""
    nulls = None
    for c in df.columns:
        n = F.count_if(F.col(c).isNull())
        nulls = n if nulls is None else nulls + n
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct(key).alias("distinct_keys"), nulls.alias("null_cells")
    ).select(F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), "distinct_keys", "null_cells")


def orphan_count(name: str, child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference has no parent. Pre-aggregated per key before the join."""
    refs = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n"))
    lost = refs.join(parent.select(F.col(key).alias(fk)), fk, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(F.lit(name).alias("relation"), "orphans")
