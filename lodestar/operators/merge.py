"""Reviewed merge of an import batch into a new catalogue version, its ledger and its rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.wordlists import KIND_LABELS
from ..session import materialize
from ..sources.snapshots import Change, SnapshotStore
from . import delta, review
from .windows import best_per_group, group_row_number

# --- fixed values: where an imported field goes ------------------------------------------------
CORE_TARGETS = {
    "benefits": "benefits",
    "eligibility": "eligibility_summary",
    "applicable_for": "applicable_for_raw",
    "funding_organisation": "funding_organisation",
    "funding_type": "funding_type",
    "scheme_type": "funding_type",
    "deadline": "application_deadline_raw",
    "additional_info": "important_notes",
}
SECTION_TARGETS = {
    "benefits": "BENEFITS",
    "eligibility": "ELIGIBILITY",
    "applicable_for": "ELIGIBILITY",
    "focus_sectors": "SCOPE",
    "funding_organisation": "FUNDING",
    "funding_type": "FUNDING",
    "scheme_type": "FUNDING",
    "deadline": "TIMELINE",
    "additional_info": "NOTES",
    "commercial_remark": "COMMERCIAL",
}
COMMERCIAL_TARGETS = {
    "minimum_charge": "minimum_charge_raw",
    "government_charge": "government_fee_raw",
    "government_fee": "government_fee_raw",
    "vendor_cost": "vendor_cost_raw",
    "bdm_deduction": "bdm_deduction_raw",
    "commercial_remark": "remarks",
}
LINK_KINDS = {
    "portal_link": "OFFICIAL_PORTAL",
    "official_link": "OFFICIAL_PORTAL",
    "application_link": "APPLICATION",
    "flyer": "FLYER",
    "reference_link": "REFERENCE",
}
SECTION_TYPES = (
    "OVERVIEW", "BENEFITS", "ELIGIBILITY", "FUNDING", "SCOPE", "PROCESS", "DOCUMENTS", "TIMELINE", "NOTES",
    "GLOSSARY", "COMMERCIAL", "OTHER",
)

CONTENT_SCHEMA = "child_key string, service_id bigint, section_type string, heading string, content string, visibility string, provenance string"
SOURCE_SCHEMA = "child_key string, service_id bigint, source_kind string, source_url string, provenance string"
COMMERCIAL_SCHEMA = (
    "child_key string, service_id bigint, minimum_charge_raw string, government_fee_raw string, vendor_cost_raw string, "
    "bdm_deduction_raw string, remarks string, visibility string, provenance string"
)
KEYS = {"service": "id", "content": "child_key", "source": "child_key", "commercial": "child_key"}


class MergeRefused(ValueError):
    """The batch may not be applied; nothing was written."""


def _lookup(table: dict, key) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)


# --- gates -----------------------------------------------------------------------------------
def dispatch(rows: DataFrame) -> DataFrame:
    """What happens to each candidate row: process, skip, create, update or abort."""
    d, status = review.decision(), F.col("delta_status")
    step = (
        F.when(status == "NO_CHANGE", "PROCESSED")
        .when(d == "SKIPPED", "SKIPPED")
        .when(d != "APPROVED", "ABORT")
        .when(status.isin("CONFLICT", "CHANGED_INFORMATION"), "ABORT")
        .when(status == "NEW_SERVICE", "CREATE")
        .otherwise("UPDATE")
    )
    return rows.where("candidate_action <> 'UNDECIDED'").withColumn("step", step)


def check_gate(batch: dict, batches: DataFrame, rows: DataFrame, reconcile: bool = False) -> dict:
    """Raise unless the batch may be applied; returns its preview counts."""
    if batch["status"] not in review.REVIEWABLE:
        raise MergeRefused(f"batch has status {batch['status']}")
    twin = batches.where((F.col("status") == "IMPORTED") & (F.col("file_sha256") == batch["file_sha256"]) & (F.col("id") != batch["id"]))
    if not reconcile and not twin.limit(1).isEmpty():
        raise MergeRefused("the same file was imported before")
    counts = review.batch_preview(rows).first()
    counts = counts.asDict() if counts else {}
    if counts.get("pending_changes", 0):
        raise MergeRefused(f"{counts['pending_changes']} change candidates still need a decision")
    bad = sum(counts.get(k, 0) for k in ("changed_information", "conflict", "new_service"))
    if reconcile and bad:
        raise MergeRefused("reconciliation allows only unchanged rows and safe additions")
    illegal = dispatch(rows).where("step = 'ABORT'").count()
    if illegal:
        raise MergeRefused(f"{illegal} rows may not be applied")
    return counts


def order_conflicts(diffs: DataFrame) -> DataFrame:
    """Later rows of a batch that meet a different text an earlier row put into the same place.

    ``diffs`` is ``(cand_id, ord, service_id, field, incoming)`` of matched services; rows are
    applied in ``ord`` order and each is compared with the catalogue as changed so far.
    """
    place = F.coalesce(_lookup(CORE_TARGETS, F.col("field")), F.col("field"))
    d = diffs.select("cand_id", "ord", "service_id", place.alias("place"), text.normalize_text("incoming").alias("norm"))
    first = best_per_group(d, ["service_id", "place"], ["ord", "norm", "cand_id"]).select(
        "service_id", "place", F.col("cand_id").alias("first_cand"), F.col("norm").alias("first_norm"))
    return d.join(first, ["service_id", "place"]).where(
        (F.col("cand_id") != F.col("first_cand")) & ~delta.text_exists(F.col("norm"), F.col("first_norm"))
    ).select("cand_id", "service_id", "place")


# --- writes -------------------------------------------------------------------------------------
def route(diffs: DataFrame) -> DataFrame:
    """Target table of each safe difference."""
    f = F.col("field")
    target = (
        F.when(f.startswith("section:"), "content")
        .when(f.startswith("link:") | f.isin(*LINK_KINDS), "source")
        .when(f.isin(*COMMERCIAL_TARGETS), "commercial")
        .when(_lookup(CORE_TARGETS, f).isNotNull(), "core")
        .otherwise("content")
    )
    return diffs.withColumn("target", target)


def fill_core(services: DataFrame, diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill blank core columns, first difference in order wins; the rest overflows to content."""
    d = diffs.withColumn("column", _lookup(CORE_TARGETS, F.col("field")))
    columns = sorted(set(CORE_TARGETS.values()))
    now = services.select(
        F.col("id").alias("service_id"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (text.normalize_text(c) == "").alias("free")) for c in columns])).alias("x"),
    ).select("service_id", "x.column", "x.free")
    d = d.join(now, ["service_id", "column"])
    first = best_per_group(d.where("free"), ["service_id", "column"], ["ord", "field", "cand_id"]).select("cand_id", "service_id", "field", "column", "incoming")
    # at most one value per core column
    filled = first.groupBy("service_id").pivot("column", columns).agg(F.first("incoming"))
    named = filled.select(F.col("service_id").alias("id"), *[F.col(c).alias(f"__{c}") for c in columns])
    updated = services.join(named, "id", "left").select(
        *[F.coalesce(F.trim(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in services.columns]
    )
    overflow = d.join(first.select("cand_id", "field"), ["cand_id", "field"], "left_anti").drop("free", "column")
    return updated, overflow


def new_content(diffs: DataFrame, existing: DataFrame) -> DataFrame:
    """Content rows to add: typed by section or field, skipped when the same text is there."""
    by_section = F.upper(F.regexp_extract("field", "^section:(.*)$", 1))
    kind = F.when(F.col("field").startswith("section:"), by_section).otherwise(_lookup(SECTION_TARGETS, F.col("field")))
    kind = F.when(kind.isin(*SECTION_TYPES), kind).otherwise("OTHER")
    heading = F.when(F.col("field").startswith("section:"), F.initcap(F.lower(kind))).otherwise(F.initcap(F.regexp_replace("field", "_", " ")))
    rows = diffs.select(
        "service_id", kind.alias("section_type"), heading.alias("heading"), text.strip(F.col("incoming")).alias("content"),
        F.lit("BDE").alias("visibility"), F.col("provenance"), "ord", text.normalize_text("incoming").alias("norm"),
    ).where("norm <> ''")
    have = existing.select("service_id", text.normalize_text("content").alias("norm")).distinct()
    first = best_per_group(rows.join(have, ["service_id", "norm"], "left_anti"), ["service_id", "norm"], ["ord", "section_type", "heading"])
    return first.select(F.sha2(F.concat_ws("|", "service_id", "norm"), 256).alias("child_key"), "service_id", "section_type", "heading", "content", "visibility", "provenance")


def new_sources(diffs: DataFrame, existing: DataFrame) -> DataFrame:
    kind = F.coalesce(_lookup(LINK_KINDS, F.col("field")), F.lit("REFERENCE"))
    rows = diffs.select("service_id", kind.alias("source_kind"), text.strip(F.col("incoming")).alias("source_url"), "provenance", "ord", urls.normalize_url("incoming").alias("norm")).where("norm <> ''")
    have = existing.select("service_id", urls.normalize_url("source_url").alias("norm")).distinct()
    first = best_per_group(rows.join(have, ["service_id", "norm"], "left_anti"), ["service_id", "norm"], ["ord", "source_kind", "source_url"])
    return first.select(F.sha2(F.concat_ws("|", "service_id", "norm"), 256).alias("child_key"), "service_id", "source_kind", "source_url", "provenance")


def new_commercial(diffs: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per commercial value, skipped when a row with that value in that column exists."""
    columns = list(dict.fromkeys(COMMERCIAL_TARGETS.values()))
    rows = diffs.select("service_id", _lookup(COMMERCIAL_TARGETS, F.col("field")).alias("column"), text.strip(F.col("incoming")).alias("value"), "provenance", "ord", text.normalize_text("incoming").alias("norm")).where("norm <> ''")
    have = existing.select("service_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text.normalize_text(c).alias("norm")) for c in columns])).alias("x")).select("service_id", "x.column", "x.norm").distinct()
    first = best_per_group(rows.join(have, ["service_id", "column", "norm"], "left_anti"), ["service_id", "column", "norm"], ["ord", "value"])
    return first.select(
        F.sha2(F.concat_ws("|", "service_id", "column", "norm"), 256).alias("child_key"), "service_id",
        *[F.when(F.col("column") == c, F.col("value")).otherwise("").alias(c) for c in columns],
        F.lit("BDE_ALLOWED").alias("visibility"), "provenance",
    )


def new_services(rows: DataFrame, services: DataFrame, categories: DataFrame, batch_id: int, prefix: str = "IMP") -> DataFrame:
    """Catalogue rows for approved CREATE candidates ``(cand_id, ord, title, category_id, service_kind)``."""
    known = categories.select(F.col("id").alias("category_id"), "domain_id")
    joined = rows.join(known, "category_id", "left")
    wrong = joined.where(F.col("domain_id").isNull() | ~F.col("service_kind").isin(*KIND_LABELS) | (F.trim("title") == ""))
    if not wrong.limit(1).isEmpty():
        raise MergeRefused("a new service lacks an approved category, a valid kind or a title")
    top = services.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    based = joined.withColumns({"base": text.slug_base("title"), "every": F.lit(0)})
    ranked = group_row_number(based, ["every"], F.floor(F.col("ord") / 100_000), ["ord"], "n")
    bases = based.select("base").distinct()
    taken = services.withColumn("base", F.regexp_replace("slug", r"-\d+$", "")).join(bases, "base", "left_semi").select("base", F.coalesce(F.regexp_extract("slug", r"-(\d+)$", 1).try_cast("bigint"), F.lit(1)).alias("k")).groupBy("base").agg(F.max("k").alias("taken"))
    numbered = group_row_number(ranked, ["base"], F.floor(F.col("ord") / 100_000), ["ord"], "k").join(taken, "base", "left")
    slug = text.numbered(F.col("base"), F.col("k") + F.coalesce("taken", F.lit(0)), 240)
    return numbered.select(
        "cand_id", "ord", (F.lit(top) + F.col("n")).alias("id"),
        _short_key(F.concat(F.lit(f"{prefix}-{batch_id}-"), F.col("cand_id").cast("string"))).alias("service_id"),
        text.strip(F.col("title")).alias("title"), slug.alias("slug"), "category_id", "domain_id", "service_kind", F.lit("PUBLISHED").alias("status"),
    )


def _short_key(key: Column, size: int = 40) -> Column:
    """The key, or where it is longer than ``size`` its start and a hash of all of it, so that no two keys become one."""
    return F.when(F.length(key) <= size, key).otherwise(F.concat(F.substring(key, 1, size - 17), F.lit("-"), F.substring(F.sha2(key, 256), 1, 16)))


#: images keep the full precision of timestamps
IMAGE = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def ledger(old: DataFrame, new: DataFrame, table: str, batch_id: int, actions: tuple[str, str]) -> DataFrame:
    """Before and after image of every row the merge added or changed. Give both sides only the rows that may differ."""
    key = KEYS[table]
    a = old.select(F.col(key).cast("string").alias("object_key"), F.to_json(F.struct(*old.columns), IMAGE).alias("before_json"))
    owner = F.col("id" if table == "service" else "service_id").cast("bigint").alias("service_id")
    b = new.select(F.col(key).cast("string").alias("object_key"), owner, F.to_json(F.struct(*old.columns), IMAGE).alias("after_json"))
    both = a.join(b, "object_key", "full").where(~F.col("before_json").eqNullSafe(F.col("after_json")))
    action = F.when(F.col("before_json").isNull(), actions[0]).otherwise(actions[1])
    return both.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(table).alias("object_table"), "object_key", "service_id", action.alias("action"),
        F.coalesce("before_json", F.lit("")).alias("before_json"), F.coalesce("after_json", F.lit("")).alias("after_json"), F.lit(False).alias("is_reversed"),
    )


LEDGER_SCHEMA = "batch_id bigint, object_table string, object_key string, service_id bigint, action string, before_json string, after_json string, is_reversed boolean, version bigint"
ACTIONS = {"service": ("SERVICE_CREATE", "SERVICE_UPDATE"), "content": ("CONTENT_CREATE", "CONTENT_UPDATE"),
           "source": ("SOURCE_ADD", "SOURCE_UPDATE"), "commercial": ("COMMERCIAL_CREATE", "COMMERCIAL_UPDATE")}
#: columns of a service that its own texts are compared with
TEXT_COLUMNS = sorted({c for cs in delta.CORE_BUCKETS.values() for c in cs})


def _of_services(change: Change, table: str, ids: DataFrame) -> DataFrame:
    """Rows of a table that belong to the services in ``ids`` (service_id), read from their buckets only."""
    owner = "id" if table == "service" else "service_id"
    ids = ids.select("service_id").distinct()
    rows = change.read(table, change.buckets(table, ids))
    return rows.join(ids.withColumnRenamed("service_id", owner), owner, "left_semi").select(rows.columns)


def recheck(
    store: SnapshotStore, change: Change, rows: DataFrame, diffs: DataFrame, staged_version: int,
    fields: DataFrame | None = None, links: DataFrame | None = None, sections: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``diffs`` as they stand against the version that ``change`` builds on.

    A candidate's status follows from its own fields and the texts of the service it matches, so only candidates whose
    service was written to after ``staged_version`` are classified again: from ``fields`` ``(cand_id, field, value)``,
    ``links`` ``(cand_id, field, url)`` and ``sections`` ``(cand_id, source_row, source_column, section_type, content, is_heading,
    url)``. Their staged differences are replaced by the new safe ones. A service that is gone is a conflict.
    """
    spark = rows.sparkSession
    moved = store.touched_since(staged_version).withColumnRenamed("service_id", "matched_service_id")
    stale = rows.where("candidate_action <> 'UNDECIDED' AND matched_service_id IS NOT NULL").join(moved, "matched_service_id", "left_semi")
    again = materialize(stale.select("cand_id", F.col("candidate_action").alias("action"), "matched_service_id"))
    if again.limit(1).isEmpty():
        return rows, diffs
    if fields is None and sections is None:
        raise MergeRefused("services changed after the batch was staged; give its fields to check it again")
    where = again.select("cand_id", F.col("matched_service_id").alias("service_id"))
    service = materialize(_of_services(change, "service", where))
    commercial = list(dict.fromkeys(COMMERCIAL_TARGETS.values()))
    children = {
        "content": _of_services(change, "content", where).select("service_id", F.col("content").alias("text")),
        "commercial": _of_services(change, "commercial", where).select("service_id", F.explode(F.array(*commercial)).alias("text")),
    }
    texts = materialize(delta.snapshot_texts(service, [c for c in TEXT_COLUMNS if c in service.columns], children))
    known = materialize(delta.snapshot_urls(_of_services(change, "source", where)))
    no_links = spark.createDataFrame([], "cand_id bigint, field string, url string") if links is None else links
    parts = []
    if fields is not None:
        parts.append(delta.structured_differences(fields.join(where, "cand_id"), no_links.join(where, "cand_id"), texts, known))
    if sections is not None:
        parts.append(delta.narrative_differences(sections.join(where, "cand_id"), texts, known).drop("source_row"))
    fresh = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fresh = materialize(fresh.select("cand_id", "field", "incoming", "change_type"))
    status = delta.candidate_status(again, fresh, service).select("cand_id", F.col("delta_status").alias("__now"))
    now = rows.join(materialize(status), "cand_id", "left").withColumn("delta_status", F.coalesce("__now", "delta_status")).select(rows.columns)
    kept = diffs.join(again.select("cand_id"), "cand_id", "left_anti").select("cand_id", "field", "incoming")
    return now, kept.unionByName(fresh.where("change_type = 'SAFE_ADDITION'").select("cand_id", "field", "incoming"))


def apply_batch(
    store: SnapshotStore, batch: dict, batches: DataFrame, rows: DataFrame, diffs: DataFrame, categories: DataFrame,
    reconcile: bool = False, dry_run: bool = False, fields: DataFrame | None = None, links: DataFrame | None = None, sections: DataFrame | None = None,
) -> dict:
    """Apply an approved batch as the next catalogue version, all or nothing.

    ``rows`` are staged rows ``(cand_id, ord, candidate_action, decision, delta_status,
    matched_service_id, title, category_id, service_kind, provenance)``; ``diffs`` are their safe
    differences ``(cand_id, field, incoming)``, for new services every field. ``batch["staged_version"]`` is the version they
    were compared with (0, the oldest, where it is missing); see ``recheck`` for what changed since.

    Only buckets of matched services are read and, where a service changes, written; new rows are appended. Another
    change that is committed in the meantime makes this one fail with ``CommitConflict``; nothing of it is visible then.
    """
    with store.begin() as change:
        rows, diffs = recheck(store, change, rows, diffs, batch.get("staged_version", 0), fields, links, sections)
        counts = check_gate(batch, batches, rows, reconcile)
        if dry_run:
            return counts
        if store.status(batch["id"]) == "IMPORTED":
            raise MergeRefused("the batch is imported already")
        steps = materialize(dispatch(rows))
        made = materialize(new_services(steps.where("step = 'CREATE'"), change.read("service"), categories, batch["id"]))
        target = materialize(steps.where("step IN ('CREATE', 'UPDATE')").join(made.select("cand_id", F.col("id").alias("made_id")), "cand_id", "left").select(
            "cand_id", "ord", "provenance", "step", F.coalesce("made_id", "matched_service_id").alias("service_id")))
        d = materialize(route(diffs.join(target, "cand_id")))
        if not order_conflicts(d.where("step = 'UPDATE' AND target <> 'source'")).limit(1).isEmpty():
            raise MergeRefused("two rows of the batch give different texts for one place")
        matched = target.where("step = 'UPDATE'").select("service_id").distinct()
        old = {t: materialize(_of_services(change, t, matched)) for t in KEYS}
        if not matched.join(old["service"].select(F.col("id").alias("service_id")), "service_id", "left_anti").limit(1).isEmpty():
            raise MergeRefused("a row matches a service that does not exist")
        base = old["service"].unionByName(made.drop("cand_id", "ord"), allowMissingColumns=True)
        service, overflow = fill_core(base, d.where("target = 'core'"))
        content = d.where("target = 'content'").select(overflow.columns).unionByName(overflow)
        fresh = {
            "content": new_content(content, old["content"]),
            "source": new_sources(d.where("target = 'source'"), old["source"]),
            "commercial": new_commercial(d.where("target = 'commercial'"), old["commercial"]),
        }
        fresh = {t: materialize(old[t].limit(0).unionByName(x, allowMissingColumns=True)) for t, x in fresh.items()}
        service = materialize(service)
        changes = ledger(old["service"], service, "service", batch["id"], ACTIONS["service"])
        for t, x in fresh.items():
            changes = changes.unionByName(ledger(old[t].limit(0), x, t, batch["id"], ACTIONS[t]))
        changes = materialize(changes)
        updated = changes.where("action = 'SERVICE_UPDATE'").select(F.col("service_id").alias("id"))
        change.rewrite("service", "id", change.buckets("service", updated), service.join(updated, "id", "left_semi").select(service.columns), updated)
        change.insert("service", service.join(made.select("id"), "id", "left_semi").select(service.columns))
        for t, x in fresh.items():
            change.insert(t, x)
        change.note("ledger", changes)
        change.note("touched", changes.select("service_id").distinct())
        outcome = steps.where("step <> 'ABORT'").join(target.select("cand_id", "service_id"), "cand_id", "left").select(
            F.col("cand_id").cast("string").alias("cand_id"), F.when(F.col("step") == "SKIPPED", "SKIPPED").otherwise("PROCESSED").alias("status"),
            F.when(F.col("step") == "PROCESSED", F.col("matched_service_id")).otherwise(F.col("service_id")).alias("service_id"))
        change.note("outcome", outcome)
        return {**counts, "version": change.commit(batch["id"], "APPLY")}


def undo_plan(changes: DataFrame) -> DataFrame:
    """Per object the oldest image among its unreversed changes; blank means delete."""
    return changes.where(~F.col("is_reversed")).groupBy("object_table", "object_key").agg(
        F.min_by("before_json", "version").alias("before_json"))


def rollback_batch(store: SnapshotStore, batch_id: int) -> int:
    """Restore what the batch changed, as far as it still exists, and delete what it added. Its ledger rows count as
    reversed from then on. Only an imported batch can be rolled back. Reads the batch's part of the ledger and rewrites the
    buckets of the services in it."""
    with store.begin() as change:
        if store.status(batch_id) != "IMPORTED":
            raise MergeRefused("only an imported batch can be rolled back")
        last = store.commits().where((F.col("batch_id") == batch_id) & (F.col("kind") == "APPLY")).agg(F.max_by("write", "version").alias("w")).first()["w"]
        mine = store.history("ledger", [last])
        if mine.limit(1).isEmpty():
            raise MergeRefused("the batch has no active changes")
        owner = mine.groupBy("object_table", "object_key").agg(F.min("service_id").alias("service_id"))
        plan = materialize(undo_plan(mine).join(owner, ["object_table", "object_key"]))
        for t, key in KEYS.items():
            part = plan.where(F.col("object_table") == t)
            buckets = change.buckets(t, part.select("service_id"))
            if not buckets:
                continue
            now = change.read(t, buckets)
            kind = now.schema[key].dataType.simpleString()
            there = part.where("before_json <> ''").join(now.select(F.col(key).cast("string").alias("object_key")), "object_key", "left_semi")
            back = there.select(F.from_json("before_json", now.schema, IMAGE).alias("x")).select("x.*")
            change.rewrite(t, key, buckets, back, part.where("before_json = ''").select(F.col("object_key").cast(kind).alias(key)))
        change.note("touched", plan.select("service_id").distinct())
        return change.commit(batch_id, "ROLLBACK")


def candidate_links(candidates: DataFrame) -> DataFrame:
    """Hyperlinks of candidates as differences: ``(cand_id, service_id, ord, provenance, links)`` exploded."""
    x = candidates.select("cand_id", "service_id", "ord", "provenance", F.explode("links").alias("l"))
    return x.select("cand_id", "service_id", "ord", "provenance", F.coalesce("l.field", F.lit("reference_link")).alias("field"), F.col("l.url").alias("incoming"))


def gate_reasons(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Why each batch may not be applied, NULL when it may: the gate of ``check_gate`` for many batches."""
    twins = review.duplicate_batches(batches).select("id", F.lit(True).alias("twin"))
    pending = review.batch_preview(rows).select(F.col("batch_id").alias("id"), "pending_changes")
    illegal = dispatch(rows).groupBy(F.col("batch_id").alias("id")).agg(F.count_if(F.col("step") == "ABORT").alias("illegal"))
    reason = (
        F.when(~F.col("status").isin(*review.REVIEWABLE), "status")
        .when(F.col("twin"), "duplicate")
        .when(F.coalesce("pending_changes", F.lit(0)) > 0, "pending")
        .when(F.coalesce("illegal", F.lit(0)) > 0, "illegal rows")
    )
    out = batches.join(twins, "id", "left").join(pending, "id", "left").join(illegal, "id", "left")
    return out.select("id", reason.alias("reason"))
