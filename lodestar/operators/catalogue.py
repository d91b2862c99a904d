"""Catalogue filters, lists, facets and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pitch, text
from ..functions.wordlists import SECTOR_WILDCARDS, SOURCE_LABELS, SOURCE_PRIORITY

#: own text columns that the plain text filter searches
CORE_COLUMNS = [
    "sales_pitch", "subsidy_details", "funding_type", "service_kind", "application_deadline_raw",
    "funding_organisation", "applicable_for_raw", "eligibility_summary", "benefits", "overview", "bde_summary",
    "title", "service_id",
]

SUGGESTION_COLUMNS = [
    "id", "service_id", "title", "slug", "domain_name", "category_name", "service_kind", "industries", "bde_summary",
    "overview", "benefits", "eligibility_summary", "applicable_for_raw", "funding_organisation", "funding_type",
    "subsidy_details", "sales_pitch", "application_deadline_raw",
]


def enrich(services: DataFrame, domains: DataFrame, categories: DataFrame) -> DataFrame:
    """Add domain and category names and the domain's display order."""
    d = domains.select(
        F.col("id").alias("domain_id"), F.col("name").alias("domain_name"),
        F.col("slug").alias("domain_slug"), F.col("display_order").alias("domain_order"),
    )
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return services.join(d, "domain_id").join(c, "category_id")


def short_term(query: Column, haystack: Column) -> Column:
    """Case-insensitive substring test; ``ai`` and ``iot`` must be whole words."""
    needle = F.lower(F.trim(query))
    word = F.regexp_like(
        F.lower(haystack), F.concat(F.lit("(^|[^a-z0-9])"), needle, F.lit("([^a-z0-9]|$)"))
    )
    return F.when(needle.isin("ai", "iot"), word).otherwise(F.contains(F.lower(haystack), F.lower(query)))


def text_filter(query: str, columns: list[str]) -> Column:
    """Any of the columns contains the query; ``ai`` and ``iot`` only as whole words."""
    needle = query.strip().lower()
    if needle in ("ai", "iot"):
        pattern = F.lit(f"(?i)(^|[^A-Za-z0-9]){needle}([^A-Za-z0-9]|$)")
        tests = [F.regexp_like(text.blank(c), pattern) for c in columns]
    else:
        tests = [F.contains(F.lower(text.blank(c)), F.lit(query.lower())) for c in columns]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def search_text_filter(
    services: DataFrame, query: str, classifications: DataFrame, categories: DataFrame
) -> DataFrame:
    """Services with the query in own text, category, domain or a classification's name."""
    named = categories.where(text_filter(query, ["name"])).select(F.col("id").alias("category_id"))
    via_class = classifications.join(named, "category_id", "left_semi").select(
        F.col("service_id").alias("id")
    )
    own = services.where(text_filter(query, [*CORE_COLUMNS, "category_name", "domain_name"])).select("id")
    return services.join(own.union(via_class), "id", "left_semi")


def filter_catalogue(
    services: DataFrame,
    today,
    sector: str = "",
    domain_slug: str = "",
    category_id: int | None = None,
    kind: str = "",
    deadline: str = "",
    classifications: DataFrame | None = None,
) -> DataFrame:
    """Sidebar filters; blank arguments do not filter."""
    out = services.where(pitch.searchable())
    if sector:
        out = out.where(text.sector_matches("industries", F.lit(sector)))
    if domain_slug:
        out = out.where(F.col("domain_slug") == domain_slug)
    if category_id is not None:
        own = F.col("category_id") == category_id
        if classifications is None:
            out = out.where(own)
        else:
            tagged = classifications.where(F.col("category_id") == category_id).select(
                F.col("service_id").alias("id"), F.lit(True).alias("__tagged")
            ).distinct()
            out = out.join(tagged, "id", "left").where(own | F.col("__tagged")).drop("__tagged")
    if kind:
        out = out.where(F.col("service_kind") == kind)
    if deadline == "closing":
        out = out.where(pitch.closing_soon(today, 30))
    elif deadline == "urgent":
        out = out.where(pitch.closing_soon(today, 7))
    elif deadline == "no_deadline":
        out = out.where(F.col("application_deadline").isNull())
    return out


def list_table(df: DataFrame, query: str = "", search: list[str] | None = None, **facets) -> DataFrame:
    """Generic list: text in any of the search columns, facet columns equal or in a list."""
    if query:
        df = df.where(text_filter(query, search or []))
    for column, value in facets.items():
        df = df.where(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return df


def with_pitch_state(services: DataFrame, today) -> DataFrame:
    s = services.withColumn("__state", pitch.pitch_state(today))
    return s.select(
        *services.columns,
        F.col("__state.code").alias("pitch_code"),
        F.col("__state.days_remaining").alias("pitch_days"),
        F.col("__state.end_date").alias("pitch_end"),
        F.col("__state.end_label").alias("pitch_end_label"),
        F.col("__state.pitchable").alias("is_pitchable"),
    )


def pitch_window_list(services: DataFrame, today, now, state: str = "active", attention: str = "", query: str = ""):
    """Pitch-window operations list with its state or attention filter."""
    rows = with_pitch_state(services.where(pitch.searchable()), today)
    if query:
        rows = rows.where(text_filter(query, ["title", "service_id", "domain_name", "category_name"]))
    if attention == "missing":
        return rows.where(F.col("pitch_until").isNull() & F.col("application_deadline").isNull())
    if attention == "changed":
        return rows.where(F.col("updated_at") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 24 HOURS"))
    codes = {"urgent": ["URGENT"], "closing": ["URGENT", "CLOSING"], "upcoming": ["UPCOMING"], "closed": ["CLOSED"]}
    if state in codes:
        return rows.where(F.col("pitch_code").isin(*codes[state]))
    return rows if state == "all" else rows.where("is_pitchable")


def pitch_window_counts(services: DataFrame, today, now) -> DataFrame:
    rows = with_pitch_state(services.where(pitch.searchable()), today)
    recent = F.col("updated_at") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    code = F.col("pitch_code")
    return rows.agg(
        F.count_if("is_pitchable").alias("active"),
        F.count_if(code.isin("CLOSING", "URGENT")).alias("closing"),
        F.count_if(code == "URGENT").alias("urgent"),
        F.count_if(code == "UPCOMING").alias("upcoming"),
        F.count_if(code == "CLOSED").alias("closed"),
        F.count_if(F.col("pitch_until").isNull() & F.col("application_deadline").isNull()).alias("missing"),
        F.count_if(recent).alias("changed"),
    )


def pitch_timeline(services: DataFrame, today, horizon: int = 60, k: int = 12) -> DataFrame:
    """Bars of the next ``k`` open windows inside the horizon, as percentages."""
    now, last = pitch.day(today), F.date_add(pitch.day(today), horizon)
    rows = with_pitch_state(services.where(pitch.searchable()), today).where("pitch_code <> 'CLOSED'")
    rows = (
        rows.withColumn("bar_end", F.coalesce("pitch_until", "application_deadline", last))
        .withColumn("bar_start", F.coalesce("effective_from", now))
        .orderBy("bar_end", F.lower("title"), "id")
        .limit(k)
        .where((F.col("bar_end") >= now) & (F.col("bar_start") <= last))
    )
    left = F.datediff(F.greatest("bar_start", now), now)
    shown = F.greatest(F.lit(1), F.datediff(F.least("bar_end", last), F.greatest("bar_start", now)))
    return rows.select(
        "id", "title",
        F.round(left / horizon * 100, 2).alias("left_pct"),
        F.round(F.greatest(F.lit(2.5), shown / horizon * 100), 2).alias("width_pct"),
    )


def sector_facet(services: DataFrame) -> DataFrame:
    """Services per industry name; each service counts a name once, wildcards are left out.

    Per service the first written form of a normalised name counts.
    """
    firsts = F.filter(text.clean_list("industries"), lambda x: ~text.normalize_ws(x).isin(*SECTOR_WILDCARDS))
    return (
        services.select(F.explode(text.unique_strings(firsts)).alias("name"))
        .groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    )


def category_facet(services: DataFrame, classifications: DataFrame) -> DataFrame:
    """Distinct visible services per category, over the main and the extra categories."""
    visible = services.where(pitch.searchable())
    pairs = visible.select("category_id", F.col("id").alias("service_id")).union(
        classifications.join(visible.select(F.col("id").alias("service_id")), "service_id", "left_semi")
        .select("category_id", "service_id")
    )
    return pairs.distinct().groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))


def domain_coverage(domains: DataFrame, services: DataFrame, role: str = "BDE") -> DataFrame:
    """Active domains with their count of visible services, zeros kept."""
    counts = services.where(pitch.visible_for_role(role)).groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        domains.where("is_active")
        .join(counts, F.col("id") == F.col("domain_id"), "left")
        .select("id", "name", "display_order", F.coalesce("n", F.lit(0)).alias("visible_services"))
    )


def attach_children(services: DataFrame, children: DataFrame, order: list[str]) -> DataFrame:
    """1:N attach as tall rows ``(service, child columns)``; services without children stay."""
    kids = children.select(
        F.col("service_id").alias("__sid"),
        *[F.col(c).alias(f"child_{c}") for c in children.columns if c != "service_id"],
    )
    return services.join(kids, services["id"] == kids["__sid"], "left").drop("__sid").orderBy(
        "id", *[f"child_{c}" for c in order]
    )


def source_order() -> list[Column]:
    ranks = F.create_map(*[F.lit(x) for pair in SOURCE_PRIORITY.items() for x in pair])
    return [
        F.coalesce(F.try_element_at(ranks, F.col("source_kind")), F.lit(99)),
        F.when(F.col("is_official"), 0).otherwise(1),
        F.col("id"),
    ]


def primary_source(sources: DataFrame) -> DataFrame:
    """One source per service by kind, official flag and id."""
    kept = sources.where("source_url <> ''")
    return kept.groupBy("service_id").agg(F.min_by(F.struct("id", "source_url", "source_kind"), F.struct(*source_order())).alias("s")).select(
        "service_id", F.col("s.id").alias("source_id"), F.col("s.source_url").alias("source_url"), F.col("s.source_kind").alias("source_kind")
    )


def source_label() -> Column:
    labels = F.create_map(*[F.lit(x) for pair in SOURCE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, F.col("source_kind")), F.lit("External Link"))


def detail_summary() -> Column:
    """First non-empty of summary, overview and benefits, trimmed."""
    nonempty = [F.when(F.col(c) != "", F.col(c)) for c in ("bde_summary", "overview", "benefits")]
    return F.trim(F.coalesce(*nonempty, F.lit("")))


def recents(events: DataFrame, k: int = 12) -> DataFrame:
    """Last ``k`` distinct services each user opened, newest first."""
    last = events.groupBy("user_id", "service_id").agg(F.max("created_at").alias("last_at"))
    w = Window.partitionBy("user_id").orderBy(F.desc("last_at"), F.desc("service_id"))
    return last.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def resort(rows: DataFrame, mode: str) -> DataFrame:
    """Order of a shown result: by kind, newest verification first, or as ranked."""
    orders = {
        "kind": ["service_kind", "rank"],
        "verified": [F.desc_nulls_last("verified_at"), "rank"],
        "original": ["rank"],
    }
    return rows.orderBy(*orders[mode])
