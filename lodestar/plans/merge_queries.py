"""Delta, merge, ledger and knowledge operators bound to the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import delta as dl
from ..operators import knowledge as kn
from ..operators import merge as mg
from ..session import materialize
from .registry import Registry

NT = "trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({}), chr(160), ' '), '[₹,]', '', 'g'), '[^a-z0-9%./:+\\- ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
WS = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
EXISTS = "(n.norm = '' OR EXISTS (SELECT 1 FROM ex WHERE {keys} AND (ex.norm = n.norm OR (length(n.norm) >= 12 AND contains(ex.norm, n.norm)) OR (length(ex.norm) >= 12 AND contains(n.norm, ex.norm) AND length(ex.norm) / length(n.norm) >= 0.8))))"

#: every line of every document, each offered to the service of its own or of the next document
LINES_SQL = f"""ln AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\n'), 1) AS pos FROM documents),
  n AS (SELECT doc_id * 100000 + pos AS needle_id, doc_id + pos % 2 AS service_id, line, {NT.format('line')} AS norm FROM ln),
  ex AS (SELECT DISTINCT doc_id AS service_id, {NT.format('text')} AS norm FROM documents)"""


def lines(v):
    from .views import table

    docs = table(v.spark, v.sf_dir, "documents")
    ln = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("pos", F.col("p") + 1)
    n = ln.select((F.col("doc_id") * 100000 + F.col("pos")).alias("needle_id"), (F.col("doc_id") + F.col("pos") % 2).alias("service_id"), "line", text.normalize_text("line").alias("norm"))
    ex = docs.select(F.col("doc_id").alias("service_id"), text.normalize_text("text").alias("norm"))
    return n, ex


CORE = ["title", "benefits", "eligibility_summary", "applicable_for_raw", "funding_organisation", "funding_type", "application_deadline_raw", "important_notes", "overview", "bde_summary"]


def snapshot(v):
    kids = {"content": v.section.select("service_id", F.col("content").alias("text")), "rules": v.rule.select("service_id", F.col("rule_text").alias("text"))}
    return dl.snapshot_texts(v.service, CORE, kids)


SNAP = f"""sn AS (SELECT DISTINCT service_id, bucket, norm FROM (SELECT id AS service_id, unnest([{', '.join(repr(c) for c in CORE)}]) AS bucket, {NT.format('unnest([' + ', '.join(CORE) + '])')} AS norm FROM v_service
   UNION ALL SELECT service_id, 'content', {NT.format('content')} FROM v_section UNION ALL SELECT service_id, 'rules', {NT.format('rule_text')} FROM v_rule) WHERE norm <> '')"""
CAND = """cf AS (SELECT s.id AS cand_id, s.id AS service_id, f.field, CASE f.field WHEN 'benefits' THEN CASE WHEN s.id % 2 = 0 THEN t.benefits ELSE s.benefits END WHEN 'eligibility' THEN t.eligibility_summary
   WHEN 'deadline' THEN t.application_deadline_raw WHEN 'minimum_charge' THEN 'Rs ' || (s.id % 50) WHEN 'portal_link' THEN 'https://portal.example.com/' || (s.id % 9) || '/' WHEN 'additional_info' THEN CASE WHEN s.id % 3 = 0 THEN 'www.info.example/' || s.id ELSE t.overview END
   ELSE t.bde_summary END AS value FROM v_service s JOIN v_service t ON t.id = (s.id * 3 + 1) % (SELECT count(*) FROM v_service), (VALUES ('benefits'), ('eligibility'), ('deadline'), ('minimum_charge'), ('portal_link'), ('additional_info'), ('unlisted')) f(field))"""
SRC = "su AS (SELECT id AS service_id, 'https://PORTAL.example.com/' || (id % 7) AS source_url, CASE id % 3 WHEN 0 THEN 'APPLICATION' WHEN 1 THEN 'REFERENCE' ELSE 'FLYER' END AS source_kind FROM v_service WHERE id % 4 <> 3)"


def candidate_fields(v):
    s = v.service.select(F.col("id"), "benefits")
    n = v.service.count()
    t = v.service.select(F.col("id").alias("tid"), F.col("benefits").alias("tb"), "eligibility_summary", "application_deadline_raw", "overview", "bde_summary")
    j = s.withColumn("tid", (F.col("id") * 3 + 1) % n).join(t, "tid")
    i = F.col("id")
    vals = {
        "benefits": F.when(i % 2 == 0, F.col("tb")).otherwise(F.col("benefits")),
        "eligibility": F.col("eligibility_summary"),
        "deadline": F.col("application_deadline_raw"),
        "minimum_charge": F.concat(F.lit("Rs "), (i % 50).cast("string")),
        "portal_link": F.concat(F.lit("https://portal.example.com/"), (i % 9).cast("string"), F.lit("/")),
        "additional_info": F.when(i % 3 == 0, F.concat(F.lit("www.info.example/"), i.cast("string"))).otherwise(F.col("overview")),
        "unlisted": F.col("bde_summary"),
    }
    x = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in vals.items()]))
    return j.select(i.alias("cand_id"), i.alias("service_id"), x.alias("x")).select("cand_id", "service_id", "x.field", "x.value")


def source_urls(v):
    i = F.col("id")
    kind = F.when(i % 3 == 0, "APPLICATION").when(i % 3 == 1, "REFERENCE").otherwise("FLYER")
    rows = v.service.where("id % 4 <> 3").select(i.alias("service_id"), F.concat(F.lit("https://PORTAL.example.com/"), (i % 7).cast("string")).alias("source_url"), kind.alias("source_kind"))
    return dl.snapshot_urls(rows)


def no_links(v):
    return v.spark.createDataFrame([], "cand_id bigint, service_id bigint, field string, url string")


OWN = {"benefits": ("benefits", "content"), "eligibility": ("eligibility_summary", "applicable_for_raw", "rules", "content"), "deadline": ("application_deadline_raw", "content"), "additional_info": ("important_notes",)}
_BUCKET = "CASE " + " ".join(f"WHEN n.field = '{f}' THEN ex.bucket IN ({', '.join(repr(b) for b in bs)})" for f, bs in OWN.items()) + " WHEN n.field = 'minimum_charge' THEN false ELSE true END"
DIFFS = f"""{SNAP}, {CAND}, {SRC}, uu AS (SELECT service_id, lower(source_url) AS url, source_kind FROM su),
  fx AS (SELECT *, CASE WHEN field = 'portal_link' THEN regexp_replace(value, '/+$', '') WHEN starts_with(value, 'www.') THEN 'https://' || value ELSE '' END AS url, {NT.format('value')} AS norm FROM cf WHERE trim(value) <> ''),
  n AS (SELECT * FROM fx WHERE url = ''), ex AS (SELECT * FROM sn),
  df AS (SELECT cand_id, field, url AS incoming, CASE WHEN EXISTS (SELECT 1 FROM uu WHERE uu.service_id = fx.service_id AND uu.source_kind IN ('APPLICATION','OFFICIAL_PORTAL')) THEN 'CHANGED_INFORMATION' ELSE 'SAFE_ADDITION' END AS change_type FROM fx
     WHERE field = 'portal_link' AND NOT EXISTS (SELECT 1 FROM uu WHERE uu.service_id = fx.service_id AND uu.url = fx.url)
   UNION ALL SELECT cand_id, field, url, 'SAFE_ADDITION' FROM fx WHERE url <> '' AND field <> 'portal_link' AND NOT EXISTS (SELECT 1 FROM uu WHERE uu.service_id = fx.service_id AND uu.url = fx.url)
   UNION ALL SELECT cand_id, field, value, CASE WHEN EXISTS (SELECT 1 FROM ex WHERE ex.service_id = n.service_id AND {_BUCKET}) THEN 'CHANGED_INFORMATION' ELSE 'SAFE_ADDITION' END FROM n WHERE NOT {EXISTS.format(keys='ex.service_id = n.service_id AND ' + _BUCKET)})"""


def register(reg: Registry) -> None:
    for key in ("M2_text_exists", "J9_delta_join", "U6_text_differences"):
        negate = key.startswith("U6")
        cond = EXISTS.format(keys="ex.service_id = n.service_id")

        def exists_fn(v, negate=negate):
            n, ex = lines(v)
            hit = dl.existing_needles(n, ex, ["service_id"])
            return n.select("needle_id").join(hit, "needle_id", "left_anti") if negate else hit

        reg.add(key, "", f"WITH {LINES_SQL} SELECT needle_id FROM n WHERE {'NOT ' if negate else ''}{cond}")(exists_fn)

    @reg.add("M1_service_snapshot", "v_service v_section v_rule", f"WITH {SNAP} SELECT service_id, bucket, norm FROM sn")
    def _(v):
        return snapshot(v)

    @reg.add("M3_structured_differences", "v_service v_section v_rule", f"WITH {DIFFS} SELECT cand_id, field, incoming, change_type FROM df")
    def _(v):
        d = dl.structured_differences(candidate_fields(v), no_links(v), materialize(snapshot(v)), source_urls(v))
        return d.select("cand_id", "field", "incoming", "change_type")

    @reg.add("J17_same_kind_urls", "v_service", f"WITH {SRC} SELECT f.field, s.service_id, lower(s.source_url) AS url FROM su s JOIN (VALUES ('portal_link','APPLICATION'),('portal_link','OFFICIAL_PORTAL'),('application_link','APPLICATION'),('official_link','OFFICIAL_PORTAL'),('flyer','FLYER'),('reference_link','REFERENCE'),('additional_info','REFERENCE')) f(field, kind) ON f.kind = s.source_kind")
    def _(v):
        kinds = v.spark.createDataFrame([(k, s) for k, ss in dl.SOURCE_KINDS.items() for s in ss], "field string, source_kind string")
        return source_urls(v).join(F.broadcast(kinds), "source_kind").select("field", "service_id", "url")

    @reg.add("M5_candidate_status", "v_service v_section v_rule", f"""WITH {DIFFS}, ca AS (SELECT id AS cand_id, CASE id % 11 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'MERGE_REVIEW' WHEN 2 THEN 'INVALID' ELSE 'UPDATE' END AS action, CASE WHEN id % 13 = 0 THEN id + 100000000 WHEN id % 17 = 0 THEN NULL ELSE id END AS sid FROM v_service),
      dc AS (SELECT cand_id, count(*) AS n, count(*) FILTER (change_type = 'CHANGED_INFORMATION') AS ch FROM df GROUP BY 1)
      SELECT ca.cand_id, CASE WHEN action IN ('INVALID','MERGE_REVIEW') THEN 'CONFLICT' WHEN action = 'CREATE' OR sid IS NULL THEN 'NEW_SERVICE' WHEN sid > 100000000 THEN 'CONFLICT' WHEN n IS NULL THEN 'NO_CHANGE' WHEN ch > 0 THEN 'CHANGED_INFORMATION' ELSE 'SAFE_ADDITION' END AS delta_status
      FROM ca LEFT JOIN dc ON dc.cand_id = ca.cand_id""")
    def _(v):
        i = F.col("id")
        action = F.when(i % 11 == 0, "CREATE").when(i % 11 == 1, "MERGE_REVIEW").when(i % 11 == 2, "INVALID").otherwise("UPDATE")
        sid = F.when(i % 13 == 0, i + 100000000).when(i % 17 == 0, F.lit(None)).otherwise(i)
        c = v.service.select(i.alias("cand_id"), action.alias("action"), sid.alias("matched_service_id"))
        d = dl.structured_differences(candidate_fields(v), no_links(v), materialize(snapshot(v)), source_urls(v))
        return dl.candidate_status(c, d, v.service).select("cand_id", "delta_status")

    own = "ex.service_id = n.service_id AND (ex.bucket = 'content' OR (n.section_type = 'ELIGIBILITY' AND ex.bucket = 'rules'))"
    # every section offers a link of its own, so it is compared though its text is shown
    narrative = f"""WITH {SNAP}, {SRC}, ex AS (SELECT * FROM sn),
      n AS (SELECT id AS cand_id, service_id + id % 2 AS service_id, section_type, {NT.format('content')} AS norm FROM v_section WHERE trim(content) <> ''),
      fl AS (SELECT cand_id, section_type, {EXISTS.format(keys='ex.service_id = n.service_id')} AS shown, {EXISTS.format(keys=own)} AS in_own, EXISTS (SELECT 1 FROM ex WHERE {own}) AS own_filled,
        EXISTS (SELECT 1 FROM ex WHERE ex.service_id = n.service_id) AS any_filled, EXISTS (SELECT 1 FROM su WHERE su.service_id = n.service_id) AS any_url FROM n),
      op AS (SELECT * FROM fl WHERE NOT CASE WHEN own_filled THEN in_own ELSE shown END)
      SELECT cand_id, 'section:' || section_type AS field, CASE WHEN any_filled THEN 'CHANGED_INFORMATION' ELSE 'SAFE_ADDITION' END AS change_type FROM op
      UNION ALL SELECT cand_id, 'link:' || section_type, CASE WHEN any_url THEN 'CHANGED_INFORMATION' ELSE 'SAFE_ADDITION' END FROM op"""

    @reg.add("M4_narrative_differences", "v_service v_section v_rule", narrative)
    def _(v):
        s = v.section.select(F.col("id").alias("cand_id"), ((F.col("service_id") + F.col("id") % 2)).alias("service_id"), F.col("id").alias("source_row"), F.lit(1).alias("source_column"),
                             "section_type", "content", F.lit(False).alias("is_heading"), F.concat(F.lit("https://x.example/"), F.col("id").cast("string")).alias("url"))
        return dl.narrative_differences(s, materialize(snapshot(v)), materialize(source_urls(v))).select("cand_id", "field", "change_type")

    @reg.add("M6_not_imported", "v_batch", "SELECT id FROM v_batch b WHERE NOT EXISTS (SELECT 1 FROM v_batch o WHERE o.status = 'IMPORTED' AND o.file_sha256 = b.file_sha256)")
    def _(v):
        return dl.not_imported(v.batch.select("id", F.col("file_sha256").alias("sha256")), v.batch).select("id")

    @reg.add("M7b_row_dispatch", "v_row", """SELECT id, CASE WHEN delta_status = 'NO_CHANGE' THEN 'PROCESSED' WHEN d = 'SKIPPED' THEN 'SKIPPED' WHEN d <> 'APPROVED' THEN 'ABORT' WHEN delta_status IN ('CONFLICT','CHANGED_INFORMATION') THEN 'ABORT' WHEN delta_status = 'NEW_SERVICE' THEN 'CREATE' ELSE 'UPDATE' END AS step
      FROM (SELECT *, CASE WHEN candidate_action = 'SKIP' THEN 'SKIPPED' ELSE upper(coalesce(nullif(decision, ''), 'PENDING')) END AS d FROM v_row WHERE candidate_action <> 'UNDECIDED')""")
    def _(v):
        return mg.dispatch(v.row).select("id", "step")

    def diffs(v):
        return candidate_fields(v).where("trim(value) <> ''").select("cand_id", (F.col("cand_id") % 5).alias("ord"), (F.col("service_id") - F.col("service_id") % 4).alias("service_id"), "field", F.col("value").alias("incoming"), F.lit("p").alias("provenance"))

    dd = f"{CAND}, dd AS (SELECT cand_id, cand_id % 5 AS ord, service_id - service_id % 4 AS service_id, field, value AS incoming, {NT.format('value')} AS norm FROM cf WHERE trim(value) <> '')"

    @reg.add("M7h_route", "v_service", f"WITH {dd} SELECT cand_id, field, CASE field WHEN 'benefits' THEN 'core' WHEN 'eligibility' THEN 'core' WHEN 'deadline' THEN 'core' WHEN 'additional_info' THEN 'core' WHEN 'minimum_charge' THEN 'commercial' WHEN 'portal_link' THEN 'source' ELSE 'content' END AS target FROM dd")
    def _(v):
        return mg.route(diffs(v)).select("cand_id", "field", "target")

    @reg.add("M7d_fill_core", "v_service", f"""WITH {dd}, fr AS (SELECT dd.*, CASE field WHEN 'eligibility' THEN 'eligibility_summary' WHEN 'deadline' THEN 'application_deadline_raw' WHEN 'additional_info' THEN 'important_notes' ELSE 'benefits' END AS col FROM dd WHERE field IN ('benefits','eligibility','deadline','additional_info')),
      wi AS (SELECT fr.*, row_number() OVER (PARTITION BY fr.service_id, col ORDER BY ord, field, cand_id) AS k FROM fr JOIN v_service s ON s.id = fr.service_id WHERE {NT.format("CASE col WHEN 'benefits' THEN s.benefits WHEN 'eligibility_summary' THEN s.eligibility_summary WHEN 'application_deadline_raw' THEN s.application_deadline_raw ELSE s.important_notes END")} = '')
      SELECT s.id, coalesce(max(trim(incoming)) FILTER (col = 'benefits'), s.benefits) AS benefits, coalesce(max(trim(incoming)) FILTER (col = 'important_notes'), s.important_notes) AS important_notes, count(k) AS filled FROM v_service s LEFT JOIN wi ON wi.service_id = s.id AND wi.k = 1 GROUP BY s.id, s.benefits, s.important_notes""")
    def _(v):
        d = mg.route(diffs(v)).where("target = 'core'").withColumn("cand_id", F.col("cand_id"))
        updated, _rest = mg.fill_core(v.service, d)
        old = v.service.select("id", *[F.col(c).alias(f"o_{c}") for c in ("benefits", "eligibility_summary", "application_deadline_raw", "important_notes")])
        j = updated.join(old, "id")
        n = sum([F.when(F.col(c) != F.col(f"o_{c}"), 1).otherwise(0) for c in ("benefits", "eligibility_summary", "application_deadline_raw", "important_notes")], F.lit(0))
        return j.select("id", "benefits", "important_notes", n.cast("bigint").alias("filled"))

    @reg.add("J10_existence_anti_join", "v_section", f"SELECT a.id FROM v_section a WHERE NOT EXISTS (SELECT 1 FROM v_section b WHERE b.service_id = a.service_id AND b.id % 2 = 0 AND {NT.format('b.content')} = {NT.format('a.content')})")
    def _(v):
        new = v.section.select("id", F.col("service_id").alias("k"), "content")
        have = v.section.where("id % 2 = 0").select(F.col("service_id").alias("k"), "content")
        return kn.missing_rows(new, have, ["k"], "content").select("id")

    @reg.add("M7e_content_overflow", "v_service v_section", f"WITH {dd}, ok AS (SELECT DISTINCT service_id, norm FROM dd WHERE field = 'unlisted' AND NOT EXISTS (SELECT 1 FROM v_section x WHERE x.service_id = dd.service_id AND {NT.format('x.content')} = dd.norm)) SELECT service_id, count(*) AS n FROM ok GROUP BY 1")
    def _(v):
        return mg.new_content(mg.route(diffs(v)).where("target = 'content'"), v.section).groupBy("service_id").agg(F.count(F.lit(1)).alias("n"))

    @reg.add("M7f_source_additions", "v_service v_source", f"WITH {dd} SELECT DISTINCT service_id, 'OFFICIAL_PORTAL' AS source_kind, regexp_replace(incoming, '/+$', '') AS url FROM dd WHERE field = 'portal_link'")
    def _(v):
        got = mg.new_sources(mg.route(diffs(v)).where("target = 'source'"), v.source)
        return got.select("service_id", "source_kind", urls.normalize_url("source_url").alias("url"))

    @reg.add("M7g_commercial_additions", "v_service", f"WITH {dd} SELECT DISTINCT service_id, incoming AS minimum_charge FROM dd WHERE field = 'minimum_charge' AND service_id % 3 <> 0")
    def _(v):
        d = mg.route(diffs(v)).where("target = 'commercial'")
        cols = ["minimum_charge_raw", "government_fee_raw", "vendor_cost_raw", "bdm_deduction_raw", "remarks"]
        have = d.where("service_id % 3 = 0").select("service_id", F.col("incoming").alias("minimum_charge_raw"), *[F.lit("").alias(c) for c in cols[1:]])
        return mg.new_commercial(d, have).select("service_id", F.col("minimum_charge_raw").alias("minimum_charge"))

    @reg.add("M7c_new_services", "v_service v_category v_row", """, r AS (SELECT id AS cand_id, id AS ord, 'New ' || sheet_name || ' ' || (row_no % 9) AS title, id % 25 AS category_id FROM v_row WHERE candidate_action = 'CREATE'),
       b AS (SELECT *, lower(replace(title, ' ', '-')) AS base FROM r), n AS (SELECT *, row_number() OVER (ORDER BY ord) AS pos, row_number() OVER (PARTITION BY base ORDER BY ord) AS k FROM b)
       SELECT cand_id, (SELECT max(id) FROM v_service) + pos AS id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug, c.domain_id FROM n JOIN v_category c ON c.id = n.category_id""")
    def _(v):
        r = v.row.where("candidate_action = 'CREATE'").select(F.col("id").alias("cand_id"), F.col("id").alias("ord"), F.concat(F.lit("New "), "sheet_name", F.lit(" "), (F.col("row_no") % 9).cast("string")).alias("title"),
                                                              (F.col("id") % 25).alias("category_id"), F.lit("GRANT").alias("service_kind"))
        return mg.new_services(r, v.service, v.category, 1).select("cand_id", "id", "slug", "domain_id")

    @reg.add("M7j_change_ledger", "v_service", """SELECT CAST(id AS VARCHAR) AS object_key, CASE WHEN id % 10 = 4 THEN 'SERVICE_CREATE' ELSE 'SERVICE_UPDATE' END AS action,
      CASE WHEN id % 10 = 4 THEN NULL ELSE title END AS title_before, CASE WHEN id % 10 = 3 THEN title || ' new' ELSE title END AS title_after,
      CASE WHEN id % 10 = 4 THEN NULL ELSE id * 1000 + 123456 END AS micros_before, id * 1000 + CASE WHEN id % 10 IN (3, 5) THEN 123457 ELSE 123456 END AS micros_after
      FROM v_service WHERE id % 10 IN (3, 4, 5)""")
    def _(v):
        s = v.service.select("id", "title", "status", F.timestamp_micros(F.col("id") * 1000 + 123456).alias("updated_at"))
        old = s.where("id % 10 <> 4")
        later = F.when(F.col("id") % 10 == 3, F.concat("title", F.lit(" new"))).otherwise(F.col("title"))
        moved = F.timestamp_micros(F.col("id") * 1000 + F.when((F.col("id") % 10).isin(3, 5), 123457).otherwise(123456))
        new = s.withColumns({"title": later, "updated_at": moved})
        log = mg.ledger(old, new, "service", 1, ("SERVICE_CREATE", "SERVICE_UPDATE"))
        image = lambda c: F.from_json(c, s.schema, mg.IMAGE)
        log = log.withColumns({"b": image("before_json"), "a": image("after_json")})
        return log.select("object_key", "action", F.col("b.title").alias("title_before"), F.col("a.title").alias("title_after"),
                          F.unix_micros("b.updated_at").alias("micros_before"), F.unix_micros("a.updated_at").alias("micros_after"))

    @reg.add("M7l_order_conflicts", "v_service", f"""WITH {dd}, fr AS (SELECT *, CASE field WHEN 'eligibility' THEN 'eligibility_summary' WHEN 'deadline' THEN 'application_deadline_raw' WHEN 'additional_info' THEN 'important_notes' ELSE field END AS place FROM dd),
      f1 AS (SELECT *, first_value(cand_id) OVER w AS fc, first_value(norm) OVER w AS fnorm FROM fr WINDOW w AS (PARTITION BY service_id, place ORDER BY ord, norm, cand_id)),
      cf1 AS (SELECT cand_id, service_id, place FROM f1 WHERE norm <> fnorm AND NOT (length(norm) >= 12 AND contains(fnorm, norm)) AND NOT (length(fnorm) >= 12 AND contains(norm, fnorm) AND length(fnorm) / length(norm) >= 0.8))
      SELECT * FROM cf1""")
    def _(v):
        return mg.order_conflicts(diffs(v))

    @reg.add("M9_rollback_plan", "v_change", "SELECT object_pk, arg_min(before_text, id) AS restored, arg_min(before_text, id) = '' AS deleted FROM v_change WHERE NOT is_reversed GROUP BY 1")
    def _(v):
        c = v.change.select("is_reversed", F.lit("service").alias("object_table"), F.col("object_pk").alias("object_key"), F.col("before_text").alias("before_json"), F.col("id").alias("version"))
        p = mg.undo_plan(c)
        return p.select(F.col("object_key").alias("object_pk"), F.col("before_json").alias("restored"), (F.col("before_json") == "").alias("deleted"))

    # --- knowledge -------------------------------------------------------------------------------
    @reg.add("J13_section_service", "v_section v_row", """, sec AS (SELECT id, CASE WHEN id % 3 = 0 THEN service_id END AS service_id, id * 1000 + 1 AS import_row_id, id - id % 5 AS document_id FROM v_section),
      doc AS (SELECT DISTINCT id - id % 5 AS id, CASE WHEN id % 10 < 5 THEN id - id % 5 END AS service_id, (id - id % 5) * 1000 + 2 AS import_row_id FROM v_section)
      SELECT sec.id, coalesce(sec.service_id, r.imported_service_id, r.matched_service_id, doc.service_id, q.imported_service_id, q.matched_service_id) AS resolved_id,
        CASE WHEN sec.service_id IS NOT NULL THEN 'DIRECT_SERVICE' WHEN coalesce(r.imported_service_id, r.matched_service_id) IS NOT NULL THEN 'SOURCE_IMPORT_ROW' WHEN doc.service_id IS NOT NULL THEN 'DOCUMENT_SERVICE'
         WHEN coalesce(q.imported_service_id, q.matched_service_id) IS NOT NULL THEN 'DOCUMENT_IMPORT_ROW' ELSE 'UNRESOLVED' END AS method
      FROM sec LEFT JOIN v_row r ON r.id = sec.import_row_id LEFT JOIN doc ON doc.id = sec.document_id LEFT JOIN v_row q ON q.id = doc.import_row_id""")
    def _(v):
        i = F.col("id")
        sec = v.section.select(i, F.when(i % 3 == 0, F.col("service_id")).alias("service_id"), (i * 1000 + 1).alias("import_row_id"), (i - i % 5).alias("document_id"))
        d = v.section.select((i - i % 5).alias("id")).distinct()
        doc = d.select("id", F.when(i % 10 < 5, i).alias("service_id"), (i * 1000 + 2).alias("import_row_id"))
        return kn.resolve_section_service(sec, v.row, doc).select("id", "resolved_id", "method")

    @reg.add("W2_heading_carry", "v_section", "SELECT id, last_value(CASE WHEN id % 4 = 0 THEN title END IGNORE NULLS) OVER (PARTITION BY id - id % 40, id % 2 ORDER BY id ROWS UNBOUNDED PRECEDING) AS carried FROM v_section")
    def _(v):
        s = v.section.select("id", (F.col("id") - F.col("id") % 40).alias("service_id"), (F.col("id") % 2).cast("string").alias("section_type"), F.when(F.col("id") % 4 == 0, F.col("title")).alias("heading"))
        return kn.carried_heading(s, 100).select("id", "carried")

    @reg.add("W13_step_numbers", "v_section", """, i AS (SELECT id, id - id % 40 AS service_id, section_type, unnest(string_split(content, '|')) AS item, generate_subscripts(string_split(content, '|'), 1) AS pos FROM (SELECT id, section_type, 'Step one ' || id || '|Step two|' || title AS content FROM v_section) x)
      SELECT id, service_id, section_type, item, row_number() OVER (PARTITION BY service_id, section_type ORDER BY id, pos) AS item_no FROM i""")
    def _(v):
        s = v.section.select("id", (F.col("id") - F.col("id") % 40).alias("service_id"), "section_type", F.concat(F.lit("Step one "), F.col("id").cast("string"), F.lit("|Step two|"), "title").alias("content"))
        return kn.section_items(s).select("id", "service_id", "section_type", "item", "item_no")

    comp = """fl AS (SELECT service_id, bool_or(section_type = 'ELIGIBILITY') AS el, bool_or(section_type = 'DOCUMENTS') AS doc, bool_or(section_type = 'PROCESS') AS pr, bool_or(section_type = 'FUNDING') AS fu FROM v_section GROUP BY 1),
      ck AS (SELECT s.id AS service_id, list_filter([CASE WHEN trim(overview) = '' THEN 'overview' END, CASE WHEN trim(benefits) = '' THEN 'benefits' END, CASE WHEN trim(eligibility_summary) = '' AND NOT coalesce(el, false) THEN 'eligibility' END,
        CASE WHEN NOT coalesce(doc, false) THEN 'documents' END, CASE WHEN NOT coalesce(pr, false) THEN 'process' END, CASE WHEN trim(funding_type) = '' AND trim(funding_organisation) = '' AND NOT coalesce(fu, false) THEN 'funding' END,
        CASE WHEN application_deadline IS NULL AND trim(application_deadline_raw) = '' THEN 'deadline' END, CASE WHEN s.id NOT IN (SELECT service_id FROM v_source WHERE source_url <> '') THEN 'source_link' END,
        CASE WHEN s.id NOT IN (SELECT service_id FROM v_classification) THEN 'classification' END], lambda x: x IS NOT NULL) AS missing FROM v_service s LEFT JOIN fl ON fl.service_id = s.id)"""
    VW = "v_service v_section v_source v_classification"

    @reg.add("A19_completeness", VW, f"WITH {comp} SELECT service_id, round((9 - len(missing)) / 9 * 100, 1) AS score, array_to_string(missing, ',') AS missing FROM ck")
    def _(v):
        c = kn.completeness(v.service, v.section, v.source, v.classification)
        return c.select("service_id", "score", F.array_join("missing", ",").alias("missing"))

    @reg.add("A19_missing_counts", VW, f"WITH {comp} SELECT m AS \"check\", count(*) AS n FROM (SELECT unnest(missing) AS m FROM ck) GROUP BY 1")
    def _(v):
        return kn.missing_counts(kn.completeness(v.service, v.section, v.source, v.classification))

    @reg.add("I17_intelligence_plan")
    def _(v):
        p = kn.intelligence_plan(v.service, v.section, v.source, v.classification)
        return p.select("service_id", "score", "n_sections", "eligibility_items", "document_items", "process_items")

    @reg.add("I16_section_items", "v_section", f"""SELECT service_id, section_type, count(*) AS n FROM (SELECT service_id, section_type, row_number() OVER (PARTITION BY service_id, section_type, {WS.format('content')} ORDER BY id) AS k FROM v_section) WHERE k = 1 GROUP BY 1, 2""")
    def _(v):
        return kn.dedupe_sections(v.section, ["id"]).groupBy("service_id", "section_type").agg(F.count(F.lit(1)).alias("n"))

    @reg.add("M14_apply_knowledge")
    def _(v):
        s = v.section.select("id", "service_id", "section_type", F.when(F.col("id") % 4 == 0, F.col("title")).alias("heading"), "content")
        empty = v.spark.createDataFrame([], "service_id bigint, text string, seq bigint")
        have = v.rule.select("service_id", F.col("rule_text").alias("text"), F.col("display_order").alias("seq"))
        new = kn.apply_knowledge(s, empty, have, empty, empty)
        out = None
        for name, frame in new.items():
            part = frame.groupBy("service_id").agg(F.count(F.lit(1)).alias("added"), F.max("seq").alias("last_seq")).withColumn("target", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out

    #: raw texts of import rows: three typed keys, one that is blocked, one of no type
    raw_cells = {"Eligibility criteria": "'Kind ' || (row_no % 4) || '|Open in ' || delta_status", "Benefits": "'Benefit  ' || (quantity % 3)",
                 "How to apply": "'Form ' || row_no", "Vendor note": "'secret'", "Colour": "'red'"}
    typed = {"Eligibility criteria": "ELIGIBILITY", "Benefits": "BENEFITS", "How to apply": "PROCESS"}
    cells = ", ".join(f"({i}, '{k}', {v}, {repr(typed[k]) if k in typed else 'NULL'})" for i, (k, v) in enumerate(raw_cells.items()))
    own = ", ".join(f"({i}, '{k}', '{t}', s.{c})" for i, (k, t, c) in enumerate(kn.OWN_SECTIONS))
    order = "is_row, sheet_name, row_no, row_id, pos"
    source_sql = f"""pub AS (SELECT * FROM v_service WHERE status = 'PUBLISHED'),
      ln AS (SELECT DISTINCT r.id AS row_id, r.sheet_name, r.row_no, r.delta_status, CAST(r.quantity AS BIGINT) AS quantity, x.s AS service_id FROM v_row r, unnest([r.imported_service_id, r.matched_service_id]) x(s) WHERE x.s IN (SELECT id FROM pub)),
      ev AS (SELECT ln.*, c.* FROM ln, LATERAL (VALUES {cells}) c(pos, key, value, section_type)),
      cd AS (SELECT s.id AS service_id, 0 AS is_row, '' AS sheet_name, 0 AS row_no, NULL AS row_id, o.pos, o.kind AS section_type, o.title, trim(o.content) AS content FROM pub s, LATERAL (VALUES {own}) o(pos, kind, title, content) WHERE trim(o.content) <> ''
        UNION ALL SELECT service_id, 1, sheet_name, row_no, row_id, pos, section_type, CASE key WHEN 'Eligibility criteria' THEN 'Eligibility Criteria' WHEN 'How to apply' THEN 'How To Apply' ELSE key END, value FROM ev WHERE section_type IS NOT NULL),
      sc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_id, section_type, lower(regexp_replace(content, '\\s+', ' ', 'g')) ORDER BY {order}) AS k FROM cd) WHERE k = 1),
      it AS (SELECT service_id, section_type, {order}, unnest(string_split(content, '|')) AS item, generate_subscripts(string_split(content, '|'), 1) AS item_pos FROM sc WHERE section_type IN ('ELIGIBILITY', 'DOCUMENTS', 'PROCESS'))"""
    SV = "v_service v_row v_section v_rule"

    def source(v):
        cells = [F.expr(e).alias(k) for k, e in raw_cells.items()]
        typed_rows = v.row.withColumn("quantity", F.col("quantity").cast("bigint"))
        raw = typed_rows.select("id", F.to_json(F.struct(*cells)).alias("raw"))
        return kn.flatten_json(raw, "id", "raw")

    def source_tables(v):
        return kn.apply_source(materialize(kn.source_sections(v.service, v.row, source(v))), v.section, v.rule.select("service_id", F.col("rule_text").alias("text")))

    @reg.add("M14_source_content", SV, f"""WITH {source_sql}, p AS (SELECT *, row_number() OVER (PARTITION BY service_id, section_type ORDER BY {order}) AS display_order FROM sc)
      SELECT service_id, section_type, title, content, display_order, row_id AS import_row_id FROM p WHERE NOT EXISTS (SELECT 1 FROM v_section x WHERE x.service_id = p.service_id AND x.section_type = p.section_type AND trim(x.content) = p.content)""")
    def _(v):
        return source_tables(v)["content"].select("service_id", "section_type", "title", "content", "display_order", "import_row_id")

    @reg.add("M14_source_rules", SV, f"""WITH {source_sql}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_id, item ORDER BY {order}, item_pos) AS k FROM it WHERE section_type = 'ELIGIBILITY') WHERE k = 1)
      SELECT f.service_id, f.item AS text, (SELECT count(*) FROM v_rule r WHERE r.service_id = f.service_id) + row_number() OVER (PARTITION BY f.service_id ORDER BY {order}, item_pos) AS display_order
      FROM f WHERE NOT EXISTS (SELECT 1 FROM v_rule r WHERE r.service_id = f.service_id AND trim(r.rule_text) = f.item)""")
    def _(v):
        return source_tables(v)["rules"].select("service_id", "text", "display_order")

    @reg.add("I17_plan_report", SV, f"""WITH {source_sql}, c AS (SELECT 'sections' AS part, service_id FROM sc UNION ALL SELECT 'linked_import_rows', service_id FROM ln UNION ALL SELECT 'evidence', service_id FROM ev WHERE key <> 'Vendor note'
        UNION ALL SELECT CASE section_type WHEN 'ELIGIBILITY' THEN 'eligibility_candidates' WHEN 'DOCUMENTS' THEN 'document_candidates' ELSE 'process_candidates' END, service_id FROM it
        UNION ALL SELECT 'existing_content_sections', service_id FROM v_section WHERE service_id IN (SELECT id FROM pub) UNION ALL SELECT 'existing_eligibility_rules', service_id FROM v_rule WHERE service_id IN (SELECT id FROM pub))
      SELECT part, service_id, count(*) AS n FROM c GROUP BY GROUPING SETS ((part, service_id), (part))""")
    def _(v):
        return kn.plan_report(v.service, v.row, source(v), {"content_sections": v.section.select("service_id"), "eligibility_rules": v.rule.select("service_id")})

    @reg.add("X15_flatten_json", "v_row", "SELECT id AS row_id, k AS key, CASE k WHEN 'source.row' THEN CAST(row_no AS VARCHAR) WHEN 'source.cells[0]' THEN sheet_name WHEN 'source.cells[1]' THEN candidate_action ELSE delta_status END AS value FROM v_row, (VALUES ('source.row'), ('source.cells[0]'), ('source.cells[1]'), ('delta')) t(k)")
    def _(v):
        raw = F.to_json(F.struct(
            F.struct(F.col("row_no").alias("row"), F.array("sheet_name", "candidate_action").alias("cells")).alias("source"),
            F.struct(F.lit(1).alias("x")).alias("_meta"), F.struct(F.col("delta_status").alias("value")).alias("delta")))
        return kn.flatten_json(v.row.select("id", raw.alias("raw")), "id", "raw").select("row_id", "key", "value")

    @reg.add("X26_verbatim", "v_service v_section", """, p AS (SELECT service_id, 'benefits' AS part, id AS ord, content FROM v_section WHERE section_type = 'BENEFITS' UNION ALL SELECT service_id, 'eligibility', id, content FROM v_section WHERE section_type = 'ELIGIBILITY'),
      f AS (SELECT service_id, part, min(ord) AS ord FROM p WHERE trim(content) <> '' GROUP BY service_id, part, content),
      o AS (SELECT id AS service_id, 'benefits' AS part, benefits AS c FROM v_service UNION ALL SELECT id, 'eligibility', CASE WHEN trim(eligibility_summary) <> '' THEN eligibility_summary ELSE applicable_for_raw END FROM v_service
        UNION ALL SELECT id, 'focus_sectors', coalesce(array_to_string(list_filter(list_transform(industries, lambda x: trim(x)), lambda x: x <> ''), chr(10)), '') FROM v_service)
      SELECT service_id, part, ord FROM f UNION ALL SELECT service_id, part, -1 FROM o WHERE trim(c) <> '' AND NOT EXISTS (SELECT 1 FROM f WHERE f.service_id = o.service_id AND f.part = o.part)""")
    def _(v):
        return kn.verbatim(v.service, v.section).select("service_id", "part", "ord")
