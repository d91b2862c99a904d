"""Import batches: history, review statistics, decisions and approval gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import text_filter
from .windows import previous_in_group, top_per_group

REVIEWABLE = ("PREVIEWED", "VALIDATED")


def duplicate_detected(metadata: str = "metadata") -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.duplicate_detected") == "true", F.lit(False))


def decision() -> Column:
    """SKIP action means SKIPPED, else the recorded decision, else PENDING."""
    recorded = F.upper(F.coalesce(F.when(F.col("decision") != "", F.col("decision")), F.lit("PENDING")))
    return F.when(F.col("candidate_action") == "SKIP", F.lit("SKIPPED")).otherwise(recorded)


def with_change_flag(batches: DataFrame, changes: DataFrame) -> DataFrame:
    active = changes.where(~F.col("is_reversed")).select(F.col("batch_id").alias("id")).distinct()
    return batches.join(active.withColumn("__on", F.lit(True)), "id", "left").withColumn(
        "has_changes", F.col("__on").isNotNull()
    ).drop("__on")


def history(batches: DataFrame, source_type: str = "", status: str = "", query: str = "") -> DataFrame:
    if source_type:
        batches = batches.where(F.col("source_type") == source_type)
    if status:
        batches = batches.where(F.col("status") == status)
    return batches.where(text_filter(query, ["source_name", "file_sha256"])) if query else batches


def history_totals(batches: DataFrame) -> DataFrame:
    return batches.agg(
        F.count(F.lit(1)).alias("batches"),
        F.countDistinct(F.when(F.col("file_sha256") != "", F.col("file_sha256"))).alias("unique_sources"),
        F.count_if(duplicate_detected()).alias("duplicates"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_processed"),
    )


def latest_reviewable(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Newest batch that is open, has rows and is no known duplicate."""
    kept = batches.where(F.col("status").isin(*REVIEWABLE) & ~duplicate_detected())
    filled = kept.join(rows.select(F.col("batch_id").alias("id")), "id", "left_semi")
    return filled.agg(F.max_by("id", F.struct("created_at", "id")).alias("id")).where("id IS NOT NULL")


def duplicate_batches(batches: DataFrame) -> DataFrame:
    """Batches whose file was imported before by another batch (first such batch)."""
    done = top_per_group(batches.where("status = 'IMPORTED'").select("id", "file_sha256"), ["file_sha256"], ["id"], 2)
    two = done.groupBy("file_sha256").agg(F.min("id").alias("first_id"), F.max("id").alias("second_id"))
    other = F.when(F.col("first_id") != F.col("id"), F.col("first_id")).when(
        F.col("second_id") != F.col("id"), F.col("second_id")
    )
    return batches.join(two, "file_sha256").select("id", other.alias("duplicate_of")).where("duplicate_of IS NOT NULL")


def previous_batch(batches: DataFrame, key: str) -> DataFrame:
    """The batch before each batch with the same name or hash, by creation time."""
    return previous_in_group(
        batches.select("id", key, "created_at"), [key], F.year("created_at"), ["created_at", "id"], "id", "previous_id"
    )


def derive_flags(rows: DataFrame) -> DataFrame:
    """needs_attention, can_approve, clear_suggestion and changed-information marks."""
    action, delta = F.col("candidate_action"), F.col("delta_status")
    attention = (
        F.when(action == "SKIP", False)
        .when(action == "CREATE", delta != "NEW_SERVICE")
        .when(action == "UPDATE", ~delta.isin("NO_CHANGE", "SAFE_ADDITION"))
        .otherwise(True)
    )
    return (
        rows.withColumn("needs_attention", attention)
        .withColumn("can_approve", (action != "SKIP") & ~F.col("needs_attention"))
        .withColumn("is_changed", (action != "SKIP") & (delta == "CHANGED_INFORMATION"))
        .withColumn("clear_suggestion", F.coalesce(F.col("confidence"), F.lit(0)) >= 0.8)
    )


def review_stats(rows: DataFrame) -> DataFrame:
    """Counters per batch. Undecided rows are knowledge rows, not candidates."""
    action = F.col("candidate_action")
    cand = action != "UNDECIDED"
    return derive_flags(rows).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(cand).alias("candidates"),
        F.count_if(action == "CREATE").alias("create_rows"),
        F.count_if(action == "UPDATE").alias("update_rows"),
        F.count_if((action == "UPDATE") & ~F.col("needs_attention")).alias("safe_update"),
        F.count_if(action == "MERGE_REVIEW").alias("merge_review"),
        F.count_if(cand & F.col("needs_attention")).alias("needs_attention"),
        F.count_if(cand & F.col("is_changed")).alias("blocked"),
        F.count_if(cand & (F.col("decision") == "APPROVED") & ~F.col("needs_attention")).alias("approved"),
        F.count_if(action == "SKIP").alias("skipped"),
        F.count_if(~cand).alias("knowledge_rows"),
    )


def batch_preview(rows: DataFrame) -> DataFrame:
    """Counts per delta status and per decision for every batch."""
    d, status = decision(), F.col("delta_status")
    names = ["NEW_SERVICE", "NO_CHANGE", "SAFE_ADDITION", "CHANGED_INFORMATION", "CONFLICT"]
    return rows.where("candidate_action <> 'UNDECIDED'").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("candidate_rows"),
        *[F.count_if(status == n).alias(n.lower()) for n in names],
        F.count_if(d == "APPROVED").alias("approved"),
        F.count_if(d == "SKIPPED").alias("skipped"),
        F.count_if(~d.isin("APPROVED", "SKIPPED") & (status != "NO_CHANGE")).alias("pending_changes"),
    )


def approve_ready(rows: DataFrame) -> DataFrame:
    """Bulk approval of valid creates and of valid updates with a match."""
    d = F.upper(F.coalesce("decision", F.lit("")))
    ready = (
        F.col("candidate_action").isin("CREATE", "UPDATE")
        & (F.col("validation_status") == "VALID")
        & ~d.isin("SKIPPED", "APPROVED")
        & ((F.col("candidate_action") == "CREATE") | F.col("matched_service_id").isNotNull())
    )
    return rows.withColumn("new_decision", F.when(ready, F.lit("APPROVED")).otherwise(F.col("decision")))


def blockers(rows: DataFrame) -> DataFrame:
    """Rows that stop a one-click import, with the reason."""
    action = F.upper("candidate_action")
    d = F.upper(F.coalesce("decision", F.lit("")))
    open_row = (action != "UNDECIDED") & (action != "SKIP") & (d != "SKIPPED")
    pending = open_row & ~(action.isin("CREATE", "UPDATE") & (d == "APPROVED"))
    reason = (
        F.when(action == "MERGE_REVIEW", "possible duplicate needs a decision")
        .when(action == "INVALID", "invalid item needs review or skip")
        .when(~action.isin("CREATE", "UPDATE"), F.concat(F.lit("unsupported action "), action))
        .when(F.upper("validation_status") != "VALID", "validation is not clean")
        .when((action == "UPDATE") & F.col("matched_service_id").isNull(), "update without a matched service")
    )
    return rows.where(pending).withColumn("reason", reason).where("reason IS NOT NULL")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Last recorded decision per row."""
    return decisions.groupBy("row_id").agg(F.max_by("decision", F.struct("decided_at", "seq")).alias("decision"))


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Fold decisions into the staged rows: SKIPPED also sets the SKIP action, RESTORE reopens."""
    last = latest_decisions(decisions).select(F.col("row_id").alias("id"), F.col("decision").alias("__d"))
    out = rows.join(last, "id", "left")
    action = (
        F.when(F.col("__d") == "SKIPPED", F.lit("SKIP"))
        .when((F.col("__d") == "RESTORE") & (F.col("candidate_action") == "SKIP"),
              F.when(F.col("matched_service_id").isNotNull(), F.lit("UPDATE")).otherwise(F.lit("CREATE")))
        .otherwise(F.col("candidate_action"))
    )
    value = F.when(F.col("__d") == "RESTORE", F.lit("PENDING")).otherwise(F.coalesce("__d", "decision"))
    return out.withColumn("new_action", action).withColumn("new_decision", value).drop("__d")


def reconciliation_rows(rows: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """NO_CHANGE rows skip, SAFE_ADDITION rows wait for approval; anything else is unsafe.

    ``expected`` are the counts per status the caller insists on; a difference raises.
    """
    cand = rows.where("candidate_action <> 'UNDECIDED'")
    if expected:
        found = {r["delta_status"]: r["n"] for r in cand.groupBy("delta_status").agg(F.count(F.lit(1)).alias("n")).collect()}
        wrong = {k: (v, found.get(k, 0)) for k, v in expected.items() if found.get(k, 0) != v}
        if wrong:
            raise ValueError(f"unexpected delta counts: {wrong}")
    status = F.col("delta_status")
    return cand.select(
        "*",
        F.when(status == "NO_CHANGE", "SKIP").when(status == "SAFE_ADDITION", "UPDATE").alias("rec_action"),
        F.when(status == "NO_CHANGE", "SKIPPED").when(status == "SAFE_ADDITION", "PENDING").alias("rec_decision"),
        (~status.isin("NO_CHANGE", "SAFE_ADDITION")).alias("unsafe"),
    )


def deletable(batches: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested source deletions that are allowed: an imported source stays."""
    return wanted.join(batches.where("status = 'IMPORTED'").select("id"), "id", "left_anti").join(
        batches.select("id"), "id", "left_semi"
    )


def rows_of_service(rows: DataFrame) -> DataFrame:
    """(service, row) pairs through the imported or the matched reference, once each."""
    a = rows.where("imported_service_id IS NOT NULL").select(F.col("imported_service_id").alias("service_id"), F.col("id").alias("row_id"))
    b = rows.where(
        "matched_service_id IS NOT NULL AND (imported_service_id IS NULL OR imported_service_id <> matched_service_id)"
    ).select(F.col("matched_service_id").alias("service_id"), F.col("id").alias("row_id"))
    return a.union(b)


def active_changes(changes: DataFrame) -> DataFrame:
    return changes.where(~F.col("is_reversed")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("active_changes"))
