"""Remaining operators: sinks, snapshots, unions of matches, gates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import pitch, urls
from ..operators import catalogue as cat
from ..operators import match as ma
from ..operators import merge as mg
from ..operators import review as rv
from ..operators import search as se
from ..session import materialize, scratch_dir
from ..sources.snapshots import SnapshotStore
from . import match_queries as mq
from . import search_queries as sq
from .registry import Registry
from .views import TODAY


def register(reg: Registry) -> None:
    @reg.add("S10_report_sink", "v_row", "SELECT batch_id, count(*) AS source_rows, count(*) FILTER (candidate_action <> 'UNDECIDED') AS candidates FROM v_row GROUP BY 1")
    def _(v):
        path = f"{scratch_dir(v.spark)}/report-{uuid.uuid4().hex}"
        rv.review_stats(v.row).select("batch_id", "source_rows", "candidates").write.json(path)
        return v.spark.read.schema("batch_id bigint, source_rows bigint, candidates bigint").json(path)

    @reg.add("S14_snapshot_versions", "v_service", "SELECT id, CASE WHEN status = 'DRAFT' THEN title || ' (draft)' ELSE title END AS title, CAST(2 AS BIGINT) AS version, title AS before_title FROM v_service")
    def _(v):
        store = SnapshotStore(v.spark, f"{scratch_dir(v.spark)}/store-{uuid.uuid4().hex}")
        store.commit({"service": v.service.select("id", "title", "status")}, 1, "LOAD")
        old = store.read("service")
        marked = F.when(F.col("status") == "DRAFT", F.concat("title", F.lit(" (draft)"))).otherwise(F.col("title"))
        version = store.commit({"service": old.withColumn("title", marked)}, 2, "APPLY")
        before = store.read("service", 1).select("id", F.col("title").alias("before_title"))
        return store.read("service").select("id", "title", F.lit(version).cast("bigint").alias("version")).join(before, "id")

    @reg.add("J11_candidate_rows", "v_row", "SELECT r.id, c.delta_status AS candidate_status FROM v_row r LEFT JOIN (SELECT batch_id, sheet_name, row_no, delta_status FROM v_row WHERE candidate_action <> 'UNDECIDED') c ON c.batch_id = r.batch_id AND c.sheet_name = r.sheet_name AND c.row_no = r.row_no")
    def _(v):
        place = ["batch_id", "sheet_name", "row_no"]
        c = v.row.where("candidate_action <> 'UNDECIDED'").select(*place, F.col("delta_status").alias("candidate_status"))
        return v.row.select("id", *place).join(c, place, "left").select("id", "candidate_status")

    base = reg.sql["T4_bucket_order"]
    reg.queries["W10_bucket_top"] = lambda spark, sf_dir: _buckets(spark, sf_dir)
    reg.sql["W10_bucket_top"] = base.replace("WHERE rank <= 5", "WHERE rank <= 50")

    def _buckets(spark, sf_dir):
        from .registry import Views

        rows = ma.evaluate(mq.bought_pairs(Views(spark, sf_dir)), TODAY).withColumn("relevance", F.lit(0))
        return ma.rank_buckets(rows, ["client_id"], 50).select("client_id", "classification", "service_id", F.col("rank").cast("bigint").alias("rank"), "bucket_count")

    for key, same in (("U2_group_intersection", "Q4_intersection_or_threshold"), ("U3_guard_intersection", "F7_short_term_guard")):
        reg.queries[key], reg.sql[key] = reg.queries[same], reg.sql[same]

    @reg.add("T5_resort", "v_service", "SELECT id, service_kind, title FROM v_service WHERE status IN ('APPROVED','PUBLISHED','EXPIRING') ORDER BY service_kind, id LIMIT 250")
    def _(v):
        shown = v.service.where(pitch.searchable()).withColumn("rank", F.col("id"))
        return cat.resort(shown, "kind").limit(250).select("id", "service_kind", "title")

    @reg.add("T1_library_order")
    def _(v):
        return se.search(v.query, sq.catalogue(v), sq.texts(v), 300)

    reg.sql["T1_library_order"] = reg.sql["Q7_search"].replace("WHERE rank <= 250", "WHERE rank <= 300")

    @reg.add("U1_candidate_union", sq.VIEWS, f"WITH {sq.GROUPS}, {sq.TEXTS}, {sq.NATURAL}, {sq.FOUND} SELECT query, service_id FROM fd")
    def _(v):
        return se.search_candidates(v.query, sq.catalogue(v), sq.texts(v)).select("query", "service_id")

    def natural(v):
        g = materialize(se.query_groups(v.query))
        visible = sq.catalogue(v).select(F.col("id").alias("service_id"))
        return g, se.group_hits(sq.texts(v), g).join(visible, "service_id", "left_semi")

    @reg.add("Q3_single_group", sq.VIEWS, f"WITH {sq.GROUPS}, {sq.TEXTS}, {sq.NATURAL} SELECT query, service_id FROM nm WHERE n = 1")
    def _(v):
        return se.natural_matches(*natural(v)).where("n_groups = 1").select("query", "service_id")

    @reg.add("Q9_amount_recall", sq.VIEWS, f"WITH {sq.GROUPS}, {sq.TEXTS} SELECT grp, service_id FROM hits WHERE grp LIKE 'amount:%'")
    def _(v):
        _g, hits = natural(v)
        return hits.where("grp LIKE 'amount:%'").select("grp", "service_id")

    @reg.add("M7a_apply_gate", "v_batch v_row", """, f AS (SELECT *, CASE WHEN candidate_action = 'SKIP' THEN 'SKIPPED' ELSE upper(coalesce(nullif(decision, ''), 'PENDING')) END AS d FROM v_row WHERE candidate_action <> 'UNDECIDED'),
      g AS (SELECT batch_id, count(*) FILTER (d NOT IN ('APPROVED','SKIPPED') AND delta_status <> 'NO_CHANGE') AS pend, count(*) FILTER (delta_status <> 'NO_CHANGE' AND d <> 'SKIPPED' AND (d <> 'APPROVED' OR delta_status IN ('CONFLICT','CHANGED_INFORMATION'))) AS bad FROM f GROUP BY 1)
      SELECT b.id, CASE WHEN status NOT IN ('PREVIEWED','VALIDATED') THEN 'status' WHEN EXISTS (SELECT 1 FROM v_batch o WHERE o.file_sha256 = b.file_sha256 AND o.id <> b.id AND o.status = 'IMPORTED') THEN 'duplicate'
       WHEN coalesce(pend, 0) > 0 THEN 'pending' WHEN coalesce(bad, 0) > 0 THEN 'illegal rows' END AS reason FROM v_batch b LEFT JOIN g ON g.batch_id = b.id""")
    def _(v):
        return mg.gate_reasons(v.batch, v.row)

    @reg.add("M7i_candidate_links", "v_sheet v_source", """, l AS (SELECT row_no % 500 AS service_id, unnest(links) AS url FROM v_sheet)
      SELECT DISTINCT service_id, lower(regexp_extract(url, '^(https?://[^/]*)', 1)) || regexp_extract(url, '^https?://[^/#]*([^#]*)', 1) AS url FROM l WHERE url <> ''""")
    def _(v):
        links = F.transform(F.filter("links", lambda u: u != ""), lambda u: F.struct(F.lit("reference_link").alias("field"), u.alias("url")))
        c = v.sheet.select(F.concat_ws("/", "sheet", F.col("row_no").cast("string")).alias("cand_id"), (F.col("row_no") % 500).cast("bigint").alias("service_id"), F.col("row_no").alias("ord"), F.col("sheet").alias("provenance"), links.alias("links"))
        return mg.new_sources(mg.candidate_links(c), v.source).select("service_id", urls.normalize_url("source_url").alias("url"))
