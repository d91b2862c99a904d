"""Filters, joins, facets and orderings over the catalogue views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pitch, text
from ..operators import catalogue as cat
from ..operators import windows as win
from .registry import Registry
from .views import TODAY

NOW = f"{TODAY} 12:00:00"

PITCHABLE = """s.status IN ('APPROVED','PUBLISHED','EXPIRING')
 AND (s.effective_from IS NULL OR s.effective_from <= DATE '@TODAY')
 AND (s.pitch_until IS NULL OR s.pitch_until >= DATE '@TODAY')
 AND (s.application_deadline IS NULL OR s.application_deadline >= DATE '@TODAY')"""
CLOSING = PITCHABLE + """ AND ((s.pitch_until BETWEEN DATE '@TODAY' AND DATE '@TODAY' + %d)
 OR (s.pitch_until IS NULL AND s.application_deadline BETWEEN DATE '@TODAY' AND DATE '@TODAY' + %d))"""
VISIBLE = "s.status IN ('APPROVED','PUBLISHED','EXPIRING')"
END = "least(s.pitch_until, s.application_deadline)"
CODE = f"""CASE WHEN s.effective_from > DATE '@TODAY' THEN 'UPCOMING' WHEN {END} IS NULL THEN 'ACTIVE'
 WHEN {END} < DATE '@TODAY' THEN 'CLOSED' WHEN {END} - DATE '@TODAY' <= 7 THEN 'URGENT'
 WHEN {END} - DATE '@TODAY' <= 30 THEN 'CLOSING' ELSE 'ACTIVE' END"""
STATE_CTE = f"st AS (SELECT s.*, {CODE} AS code FROM v_service s WHERE {VISIBLE})"
ENRICHED = """e AS (SELECT s.*, d.name AS domain_name, d.slug AS domain_slug, d.display_order AS domain_order, c.name AS category_name
 FROM v_service s JOIN v_domain d ON s.domain_id = d.id JOIN v_category c ON s.category_id = c.id)"""
DIMS = "v_service v_domain v_category"


def _has(q: str, cols) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{q.lower()}')" for c in cols) + ")"


def _word(q: str, cols) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower({c}), '(^|[^a-z0-9]){q}([^a-z0-9]|$)')" for c in cols) + ")"


def _sector_sql(q: str) -> str:
    """SQL for the sector test with the query's terms already taken apart."""
    arr = "lower(trim(regexp_replace(array_to_string(list_transform(list_filter(s.industries, lambda x: x <> ''), lambda x: trim(x)), ' '), '\\s+', ' ', 'g')))"
    return "(s.industries IS NOT NULL AND " + " AND ".join(f"contains({arr}, '{t}')" for t in q.split()) + ")"


def register(reg: Registry) -> None:
    @reg.add("S1_catalogue_scan", DIMS, f"WITH {ENRICHED} SELECT id, service_id, title, domain_name, category_name, status FROM e WHERE status IN ('APPROVED','PUBLISHED','EXPIRING')")
    def _(v):
        return cat.enrich(v.service, v.domain, v.category).where(pitch.searchable()).select(
            "id", "service_id", "title", "domain_name", "category_name", "status")

    @reg.add("F1_role_visibility", "v_service", """SELECT 'ADMIN' AS role, count(*) AS n FROM v_service WHERE status <> 'ARCHIVED'
      UNION ALL SELECT 'BDE', count(*) FROM v_service WHERE status IN ('APPROVED','PUBLISHED')""")
    def _(v):
        s = v.service
        return s.agg(
            F.count_if(pitch.visible_for_role("ADMIN")).alias("ADMIN"), F.count_if(pitch.visible_for_role("BDE")).alias("BDE")
        ).unpivot([], ["ADMIN", "BDE"], "role", "n")

    @reg.add("F2_pitchable", "v_service", f"SELECT s.id, s.title FROM v_service s WHERE {PITCHABLE}")
    def _(v):
        return v.service.where(pitch.pitchable(TODAY)).select("id", "title")

    @reg.add("F3_closing_soon", "v_service", f"SELECT s.id, s.title, {CODE} AS pitch_code, CAST({END} - DATE '@TODAY' AS BIGINT) AS days FROM v_service s WHERE {CLOSING % (30, 30)}")
    def _(v):
        s = cat.with_pitch_state(v.service.where(pitch.closing_soon(TODAY, 30)), TODAY)
        return s.select("id", "title", "pitch_code", F.col("pitch_days").cast("bigint").alias("days"))

    f4 = [
        ("F4_filter_sector_domain", {"sector": "machinery", "domain_slug": "asia"}, f"{VISIBLE} AND {_sector_sql('machinery')} AND s.domain_slug = 'asia'"),
        ("F4_filter_category", {"category_id": 7}, f"{VISIBLE} AND (s.category_id = 7 OR s.id IN (SELECT service_id FROM v_classification WHERE category_id = 7))"),
        ("F4_filter_kind_urgent", {"kind": "GRANT", "deadline": "urgent"}, f"s.service_kind = 'GRANT' AND {CLOSING % (7, 7)}"),
        ("F4_filter_no_deadline", {"deadline": "no_deadline"}, f"{VISIBLE} AND s.application_deadline IS NULL"),
    ]
    for key, args, cond in f4:
        def f4_fn(v, args=args):
            rows = cat.enrich(v.service, v.domain, v.category)
            return cat.filter_catalogue(rows, TODAY, classifications=v.classification, **args).select("id", "title", "service_kind")

        reg.add(key, DIMS + " v_classification", f"WITH {ENRICHED} SELECT s.id, s.title, s.service_kind FROM e s WHERE {cond}")(f4_fn)

    core = cat.CORE_COLUMNS + ["category_name", "domain_name"]
    f5 = [("F5_text_filter", "Subsidy", _has("Subsidy", core), _has("Subsidy", ["c.name"])),
          ("F5_text_filter_category", "nation_1", _has("nation_1", core), _has("nation_1", ["c.name"])),
          ("F6_short_token", "ai", _word("ai", core), _word("ai", ["c.name"]))]
    for key, q, own, cls in f5:
        def f5_fn(v, q=q):
            rows = cat.enrich(v.service, v.domain, v.category).where(pitch.searchable())
            return cat.search_text_filter(rows, q, v.classification, v.category).select("id", "title")

        reg.add(key, DIMS + " v_classification", f"""WITH {ENRICHED} SELECT s.id, s.title FROM e s WHERE {VISIBLE} AND ({own}
           OR s.id IN (SELECT k.service_id FROM v_classification k JOIN v_category c ON k.category_id = c.id WHERE {cls}))""")(f5_fn)

    @reg.add("F9_sector_match", "v_service", f"SELECT s.id FROM v_service s WHERE {_sector_sql('food processing')}")
    def _(v):
        return v.service.where(text.sector_matches("industries", F.lit("Food Processing sector related"))).select("id")

    @reg.add("F10_keyword_match", DIMS, f"""WITH {ENRICHED} SELECT s.id FROM e s WHERE contains(concat_ws(' ', lower(s.title), lower(s.overview), lower(s.benefits)), 'dairy and livestock')
       OR (contains(concat_ws(' ', lower(s.title), lower(s.overview), lower(s.benefits)), 'dairy') AND contains(concat_ws(' ', lower(s.title), lower(s.overview), lower(s.benefits)), 'livestock'))""")
    def _(v):
        s = cat.enrich(v.service, v.domain, v.category)
        hay = text.join_nonblank(*[text.normalize_ws(c) for c in ("title", "overview", "benefits")])
        return s.where(text.keyword_matches(hay, F.lit("Dairy and  livestock"))).select("id")

    @reg.add("F11_kinds_pitchable", "v_service", f"SELECT s.id, s.service_kind FROM v_service s WHERE {PITCHABLE} AND s.service_kind IN ('GRANT','LOAN')")
    def _(v):
        return v.service.where(pitch.pitchable(TODAY) & F.col("service_kind").isin("GRANT", "LOAN")).select("id", "service_kind")

    @reg.add("F12_admin_list", DIMS, f"WITH {ENRICHED} SELECT s.id, s.title, s.status FROM e s WHERE {_has('ring', ['s.title', 's.service_id', 's.category_name', 's.domain_name'])} AND s.status = 'DRAFT' AND s.domain_slug = 'europe'")
    def _(v):
        s = cat.enrich(v.service, v.domain, v.category)
        return cat.list_table(s, "Ring", ["title", "service_id", "category_name", "domain_name"], status="DRAFT", domain_slug="europe").select("id", "title", "status")

    f13 = [("F13_window_closing", {"state": "closing", "query": "gear"}, "s.code IN ('URGENT','CLOSING') AND contains(lower(s.title || '|' || s.service_id || '|' || s.domain_name || '|' || s.category_name), 'gear')"),
           ("F13_window_upcoming", {"state": "upcoming"}, "s.code = 'UPCOMING'"),
           ("F13_window_missing", {"attention": "missing"}, "s.pitch_until IS NULL AND s.application_deadline IS NULL"),
           ("F13_window_changed", {"attention": "changed"}, "s.updated_at >= TIMESTAMP '@TODAY 12:00:00' - INTERVAL 24 HOUR")]
    for key, args, cond in f13:
        def f13_fn(v, args=args):
            return cat.pitch_window_list(cat.enrich(v.service, v.domain, v.category), TODAY, NOW, **args).select("id", "pitch_code")

        reg.add(key, DIMS, f"WITH {ENRICHED}, st AS (SELECT s.*, {CODE} AS code FROM e s WHERE {VISIBLE}) SELECT s.id, s.code AS pitch_code FROM st s WHERE {cond}")(f13_fn)

    @reg.add("F17_child_visibility", "v_section v_service", "SELECT x.id, x.service_id, x.section_type FROM v_section x JOIN v_service s ON x.service_id = s.id WHERE x.visibility = 'BDE' AND s.status IN ('APPROVED','PUBLISHED')")
    def _(v):
        shown = v.service.where(pitch.visible_for_role("BDE")).select(F.col("id").alias("service_id"))
        return v.section.where("visibility = 'BDE'").join(shown, "service_id", "left_semi").select("id", "service_id", "section_type")

    # keys made of the supplied words, some with a blocked part in their middle
    part = "CASE id % 9 WHEN 0 THEN 'Vendor' WHEN 3 THEN 'bdm-deduction' WHEN 5 THEN 'INTERNAL' WHEN 7 THEN 'margin' ELSE 'Benefit' END"
    keys = f"k AS (SELECT id, 'source.' || title || '_' || {part} || '/' || section_type AS key FROM v_section)"

    @reg.add("F18_blocked_keys", "v_section", f"WITH {keys} SELECT id, key FROM k WHERE NOT regexp_matches(lower(regexp_replace(key, '[_/-]+', ' ', 'g')), 'vendor|bdm|deduction|internal|escalation|commercial|commission|margin|employee|password')")
    def _(v):
        from ..operators.knowledge import blocked_key

        named = v.section.select("id", F.expr(f"'source.' || title || '_' || {part} || '/' || section_type").alias("key"))
        return named.where(~blocked_key("key"))

    @reg.add("F20_detail_projection", "v_service v_source", """SELECT s.id, CASE WHEN s.bde_summary <> '' THEN trim(s.bde_summary) WHEN s.overview <> '' THEN trim(s.overview) ELSE trim(s.benefits) END AS summary,
      x.source_kind, CASE x.source_kind WHEN 'APPLICATION' THEN 'Apply / Open Portal' WHEN 'OFFICIAL_PORTAL' THEN 'Official Scheme Page' WHEN 'REFERENCE' THEN 'Reference' WHEN 'FLYER' THEN 'Guidelines / Flyer' ELSE 'External Link' END AS label,
      CASE WHEN x.source_name <> '' THEN x.source_name ELSE CASE x.source_kind WHEN 'APPLICATION' THEN 'Apply / Open Portal' WHEN 'OFFICIAL_PORTAL' THEN 'Official Scheme Page' WHEN 'REFERENCE' THEN 'Reference' WHEN 'FLYER' THEN 'Guidelines / Flyer' ELSE 'External Link' END END AS name
      FROM v_service s JOIN v_source x ON x.service_id = s.id""")
    def _(v):
        s = v.service.select(F.col("id"), cat.detail_summary().alias("summary"))
        src = v.source.select(F.col("service_id").alias("id"), "source_kind", cat.source_label().alias("label"),
                              F.when(F.col("source_name") != "", F.col("source_name")).otherwise(cat.source_label()).alias("name"))
        return s.join(src, "id")

    @reg.add("F21_suggestion_projection", DIMS, f"WITH {ENRICHED} SELECT id, title, slug, domain_name, category_name, service_kind FROM e WHERE status IN ('APPROVED','PUBLISHED','EXPIRING')")
    def _(v):
        s = cat.enrich(v.service, v.domain, v.category).where(pitch.searchable()).select(*cat.SUGGESTION_COLUMNS)
        return s.select("id", "title", "slug", "domain_name", "category_name", "service_kind")

    @reg.add("F23_flyer_manager", "v_service v_flyer", """, cur AS (SELECT service_id, max(version) AS version FROM v_flyer GROUP BY 1)
      SELECT s.id, s.title, c.version FROM v_service s LEFT JOIN cur c ON s.id = c.service_id WHERE contains(lower(s.title), 'bolt') OR contains(lower(s.service_id), 'bolt') ORDER BY s.title, s.id LIMIT 30 OFFSET 30""")
    def _(v):
        current = v.flyer.groupBy("service_id").agg(F.max("version").cast("bigint").alias("version"))
        s = v.service.where(cat.text_filter("bolt", ["title", "service_id"])).select("id", "title")
        return s.join(current, F.col("id") == F.col("service_id"), "left").select("id", "title", "version").orderBy("title", "id").offset(30).limit(30)

    @reg.add("F25_facet_lists", "v_category v_domain", "SELECT c.id, c.name, d.name AS domain, row_number() OVER (ORDER BY d.display_order, c.display_order, c.name) AS pos FROM v_category c JOIN v_domain d ON c.domain_id = d.id WHERE c.is_active")
    def _(v):
        d = v.domain.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"), F.col("display_order").alias("dord"))
        rows = v.category.where("is_active").join(d, "domain_id")
        from pyspark.sql import Window
        w = Window.orderBy("dord", "display_order", "name")  # a facet list is one short menu
        return rows.select("id", "name", "domain", F.row_number().over(w).cast("bigint").alias("pos"))

    @reg.add("F26_user_list", "v_user", "SELECT id, username, role FROM v_user WHERE (contains(lower(username), '1') OR contains(lower(employee_id), '1')) AND role IN ('BDE','ADMIN') AND is_account_active")
    def _(v):
        return cat.list_table(v.user, "1", ["username", "employee_id"], role=["BDE", "ADMIN"], is_account_active=True).select("id", "username", "role")

    # ---- joins -----------------------------------------------------------------------
    @reg.add("J1_enrich", DIMS, f"WITH {ENRICHED} SELECT id, domain_name, category_name, domain_order FROM e")
    def _(v):
        return cat.enrich(v.service, v.domain, v.category).select("id", "domain_name", "category_name", "domain_order")

    @reg.add("J2_attach_children", "v_service v_rule", "SELECT s.id, r.display_order AS child_display_order, r.id AS child_id, r.rule_type AS child_rule_type FROM v_service s LEFT JOIN v_rule r ON r.service_id = s.id AND r.is_active")
    def _(v):
        kids = v.rule.where("is_active").select("service_id", "display_order", "id", "rule_type")
        return cat.attach_children(v.service.select("id"), kids, ["display_order", "id"])

    @reg.add("J3_many_to_many_distinct", "v_service v_classification", "SELECT s.id, s.title FROM v_service s WHERE s.id IN (SELECT service_id FROM v_classification WHERE category_id IN (3, 7, 11))")
    def _(v):
        tagged = v.classification.where(F.col("category_id").isin(3, 7, 11)).select(F.col("service_id").alias("id"))
        return v.service.join(tagged, "id", "left_semi").select("id", "title")

    @reg.add("J4_semi_join_ids", "v_service v_source v_rule", "SELECT id FROM v_service WHERE id IN (SELECT service_id FROM v_source WHERE is_official) OR id IN (SELECT service_id FROM v_rule WHERE rule_type = 'REQUIRED')")
    def _(v):
        ids = v.source.where("is_official").select(F.col("service_id").alias("id")).union(v.rule.where("rule_type = 'REQUIRED'").select("service_id"))
        return v.service.select("id").join(ids, "id", "left_semi")

    @reg.add("J6_unsorted_saved", "v_saved v_collection_item", "SELECT s.user_id, s.service_id FROM v_saved s WHERE NOT EXISTS (SELECT 1 FROM v_collection_item i WHERE i.user_id = s.user_id AND i.service_id = s.service_id)")
    def _(v):
        return v.saved.join(v.collection_item, ["user_id", "service_id"], "left_anti").select("user_id", "service_id")

    @reg.add("J14_target_lookup", "v_activity v_service", """SELECT a.id, s.title, s.id IS NULL AS stale FROM v_activity a LEFT JOIN v_service s ON s.id = TRY_CAST(a.target_id AS BIGINT) WHERE a.action = 'SERVICE_VIEW'""")
    def _(v):
        a = v.activity.where("action = 'SERVICE_VIEW'").select("id", F.expr("try_cast(target_id AS bigint)").alias("sid"))
        s = v.service.select(F.col("id").alias("sid"), "title", F.lit(False).alias("known"))
        return a.join(s, "sid", "left").select("id", "title", F.coalesce("known", F.lit(True)).alias("stale"))

    @reg.add("J15_ordered_lookup", "v_activity v_service", """, l AS (SELECT user_id, TRY_CAST(target_id AS BIGINT) AS sid, max(created_at) AS seen FROM v_activity WHERE action = 'SERVICE_VIEW' AND TRY_CAST(target_id AS BIGINT) IS NOT NULL GROUP BY 1, 2),
      p AS (SELECT user_id, sid, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, sid DESC) AS pos FROM l)
      SELECT p.user_id, p.pos, s.id, s.title FROM p JOIN v_service s ON s.id = p.sid WHERE p.pos <= 12""")
    def _(v):
        ev = v.activity.where("action = 'SERVICE_VIEW'").select("user_id", F.expr("try_cast(target_id AS bigint)").alias("service_id"), "created_at").where("service_id IS NOT NULL")
        rec = cat.recents(ev, 12)
        return rec.join(v.service.select(F.col("id").alias("service_id"), "title"), "service_id").select(
            "user_id", F.col("pos").cast("bigint").alias("pos"), F.col("service_id").alias("id"), "title")

    @reg.add("J18_flyer_duplicates", "v_flyer", ", m AS (SELECT sha256, count(DISTINCT service_id) AS services FROM v_flyer GROUP BY 1 HAVING count(DISTINCT service_id) > 1) SELECT f.service_id, f.version, m.services FROM v_flyer f JOIN m ON f.sha256 = m.sha256")
    def _(v):
        shared = v.flyer.select("sha256", "service_id").distinct().groupBy("sha256").agg(F.count(F.lit(1)).alias("services")).where("services > 1")
        return v.flyer.join(shared, "sha256").select("service_id", F.col("version").cast("bigint").alias("version"), "services")

    @reg.add("J19_saved_flag", "v_service v_saved", "SELECT s.id, x.service_id IS NOT NULL AS saved FROM v_service s LEFT JOIN v_saved x ON x.service_id = s.id AND x.user_id = 3")
    def _(v):
        mine = v.saved.where("user_id = 3").select(F.col("service_id").alias("id"), F.lit(True).alias("mark"))
        return v.service.select("id").join(mine, "id", "left").select("id", F.col("mark").isNotNull().alias("saved"))

    @reg.add("J20_domain_coverage", "v_service v_domain", "SELECT d.id, d.name, d.display_order, count(s.id) AS visible_services FROM v_domain d LEFT JOIN v_service s ON s.domain_id = d.id AND s.status IN ('APPROVED','PUBLISHED') WHERE d.is_active GROUP BY 1, 2, 3")
    def _(v):
        return cat.domain_coverage(v.domain, v.service)

    @reg.add("J21_collection_detail", "v_collection_item v_saved v_service v_domain v_category", f"""WITH {ENRICHED}
      SELECT i.collection_id, e.id, e.title, e.domain_name, e.category_name, {CODE.replace('s.', 'e.')} AS pitch_code, strftime(i.added_at, '%Y-%m-%d %H:%M:%S') AS added
      FROM v_collection_item i JOIN v_saved x ON x.user_id = i.user_id AND x.service_id = i.service_id JOIN e ON e.id = i.service_id""")
    def _(v):
        s = cat.with_pitch_state(cat.enrich(v.service, v.domain, v.category), TODAY)
        items = v.collection_item.join(v.saved.select("user_id", "service_id"), ["user_id", "service_id"])
        return items.join(s.withColumnRenamed("service_id", "code").withColumnRenamed("id", "service_id"), "service_id").select(
            "collection_id", F.col("service_id").alias("id"), "title", "domain_name", "category_name", "pitch_code",
            F.date_format("added_at", "yyyy-MM-dd HH:mm:ss").alias("added")).orderBy("collection_id", F.desc("added"), "id")

    # ---- aggregates / windows / orders -------------------------------------------------
    @reg.add("A12_sector_facet", "v_service", """, x AS (SELECT s.id, trim(u.v) AS v, u.pos FROM v_service s, unnest(list_zip(s.industries, range(1, len(s.industries) + 1))) AS z(p), (SELECT p[1] AS v, p[2] AS pos) u WHERE s.status IN ('APPROVED','PUBLISHED','EXPIRING')),
      y AS (SELECT id, v, row_number() OVER (PARTITION BY id, lower(regexp_replace(v, '\\s+', ' ', 'g')) ORDER BY pos) AS rn FROM x WHERE v <> '' AND lower(v) NOT IN ('all','all india','all industries','all sectors','any','any industry'))
      SELECT v AS name, count(*) AS n FROM y WHERE rn = 1 GROUP BY v""")
    def _(v):
        return cat.sector_facet(v.service.where(pitch.searchable()))

    @reg.add("A13_category_facet", "v_service v_classification", f""", vis AS (SELECT s.id, s.category_id FROM v_service s WHERE {VISIBLE})
      SELECT category_id, count(*) AS n FROM (SELECT category_id, id FROM vis UNION SELECT k.category_id, k.service_id FROM v_classification k JOIN vis ON vis.id = k.service_id) u GROUP BY 1""")
    def _(v):
        return cat.category_facet(v.service, v.classification)

    @reg.add("A14_window_counts", "v_service", f"""WITH {STATE_CTE} SELECT count(*) FILTER (code NOT IN ('UPCOMING','CLOSED')) AS active, count(*) FILTER (code IN ('CLOSING','URGENT')) AS closing,
      count(*) FILTER (code = 'URGENT') AS urgent, count(*) FILTER (code = 'UPCOMING') AS upcoming, count(*) FILTER (code = 'CLOSED') AS closed,
      count(*) FILTER (pitch_until IS NULL AND application_deadline IS NULL) AS missing, count(*) FILTER (updated_at >= TIMESTAMP '@TODAY 12:00:00' - INTERVAL 24 HOUR) AS changed FROM st""")
    def _(v):
        return cat.pitch_window_counts(v.service, TODAY, NOW)

    @reg.add("A20_max_sequence", "v_section v_flyer", "SELECT 'section' AS kind, service_id, max(display_order) AS top FROM v_section GROUP BY 2 UNION ALL SELECT 'flyer', service_id, max(version) FROM v_flyer GROUP BY 2")
    def _(v):
        a = v.section.groupBy("service_id").agg(F.max("display_order").alias("top")).select(F.lit("section").alias("kind"), "service_id", "top")
        b = v.flyer.groupBy("service_id").agg(F.max("version").cast("bigint").alias("top")).select(F.lit("flyer").alias("kind"), "service_id", "top")
        return a.unionByName(b)

    @reg.add("A21_collection_counts", "v_collection v_collection_item", "SELECT c.id, c.name, count(i.service_id) AS items, strftime(max(i.added_at), '%Y-%m-%d %H:%M:%S') AS latest FROM v_collection c LEFT JOIN v_collection_item i ON i.collection_id = c.id GROUP BY 1, 2")
    def _(v):
        n = v.collection_item.groupBy("collection_id").agg(F.count(F.lit(1)).alias("items"), F.max("added_at").alias("latest"))
        return v.collection.join(n, F.col("id") == F.col("collection_id"), "left").select(
            "id", "name", F.coalesce("items", F.lit(0)).alias("items"), F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))

    @reg.add("W4_current_flyer", "v_flyer", "SELECT service_id, max(version) AS version, arg_max(sha256, version) AS sha256 FROM v_flyer GROUP BY 1")
    def _(v):
        return v.flyer.groupBy("service_id").agg(F.max("version").cast("bigint").alias("version"), F.max_by("sha256", "version").alias("sha256"))

    @reg.add("W6_recent_services", "v_activity", """, l AS (SELECT user_id, TRY_CAST(target_id AS BIGINT) AS service_id, max(created_at) AS seen FROM v_activity WHERE action = 'SERVICE_VIEW' AND TRY_CAST(target_id AS BIGINT) IS NOT NULL GROUP BY 1, 2),
      p AS (SELECT user_id, service_id, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, service_id DESC) AS pos FROM l) SELECT * FROM p WHERE pos <= 12""")
    def _(v):
        ev = v.activity.where("action = 'SERVICE_VIEW'").select("user_id", F.expr("try_cast(target_id AS bigint)").alias("service_id"), "created_at").where("service_id IS NOT NULL")
        return cat.recents(ev).select("user_id", "service_id", F.col("pos").cast("bigint").alias("pos"))

    @reg.add("W9_primary_source", "v_source", """SELECT service_id, source_id, source_url, source_kind FROM (SELECT service_id, id AS source_id, source_url, source_kind, row_number() OVER (PARTITION BY service_id
      ORDER BY CASE source_kind WHEN 'APPLICATION' THEN 0 WHEN 'OFFICIAL_PORTAL' THEN 1 WHEN 'REFERENCE' THEN 2 WHEN 'FLYER' THEN 3 ELSE 4 END, CASE WHEN is_official THEN 0 ELSE 1 END, id) AS rn FROM v_source WHERE source_url <> '') WHERE rn = 1""")
    def _(v):
        return cat.primary_source(v.source)

    @reg.add("W14_timeline", "v_service", f"""WITH {STATE_CTE}, b AS (SELECT *, coalesce(pitch_until, application_deadline, DATE '@TODAY' + 60) AS e, coalesce(effective_from, DATE '@TODAY') AS b FROM st WHERE code <> 'CLOSED' ORDER BY e, lower(title), id LIMIT 12)
      SELECT id, title, round((greatest(b, DATE '@TODAY') - DATE '@TODAY') / 60.0 * 100, 2) AS left_pct, round(greatest(2.5, greatest(1, least(e, DATE '@TODAY' + 60) - greatest(b, DATE '@TODAY')) / 60.0 * 100), 2) AS width_pct
      FROM b WHERE e >= DATE '@TODAY' AND b <= DATE '@TODAY' + 60""")
    def _(v):
        return cat.pitch_timeline(v.service, TODAY)

    @reg.add("T2_default_order", DIMS, f"WITH {ENRICHED} SELECT id, title, domain_order FROM e WHERE status IN ('APPROVED','PUBLISHED','EXPIRING') ORDER BY domain_order, title, id LIMIT 250")
    def _(v):
        return cat.enrich(v.service, v.domain, v.category).where(pitch.searchable()).select("id", "title", "domain_order").orderBy("domain_order", "title", "id").limit(250)

    @reg.add("T7_closing_top", "v_service", f"SELECT s.id, s.title, CAST(s.pitch_until AS VARCHAR) AS pitch_until FROM v_service s WHERE {CLOSING % (30, 30)} ORDER BY s.pitch_until NULLS LAST, s.application_deadline NULLS LAST, s.title, s.id LIMIT 6")
    def _(v):
        return v.service.where(pitch.closing_soon(TODAY, 30)).orderBy(
            F.asc_nulls_last("pitch_until"), F.asc_nulls_last("application_deadline"), "title", "id"
        ).limit(6).select("id", "title", F.col("pitch_until").cast("string").alias("pitch_until"))

    @reg.add("T8_paging", "v_service", "SELECT id, title FROM v_service ORDER BY title, id LIMIT 30 OFFSET 60")
    def _(v):
        return v.service.select("id", "title").orderBy("title", "id").offset(60).limit(30)

    # ---- scalar functions --------------------------------------------------------------
    @reg.add("X1_normalize_query", "v_source", "SELECT id, trim(regexp_replace(regexp_replace(replace(lower(source_url), '&', ' and '), '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM v_source")
    def _(v):
        return v.source.select("id", text.normalize_query("source_url").alias("q"))

    @reg.add("X2_normalize_ws", "v_section", "SELECT id, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS t FROM v_section")
    def _(v):
        return v.section.select("id", text.normalize_ws("content").alias("t"))

    @reg.add("X3_norm_alnum", "v_section", "SELECT id, trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')) AS t FROM v_section")
    def _(v):
        return v.section.select("id", text.norm_alnum("content").alias("t"))

    @reg.add("X4_normalize_text", "v_section", "SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(content), chr(160), ' '), '[₹,]', '', 'g'), '[^a-z0-9%./:+\\- ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM v_section")
    def _(v):
        return v.section.select("id", text.normalize_text("content").alias("t"))

    @reg.add("X5_clean_text", "v_source", "SELECT id, trim(regexp_replace(regexp_replace(lower(regexp_replace(html, '<[^>]+>', ' ', 'g')), '[–—]', '-', 'g'), '\\s+', ' ', 'g')) AS t FROM v_source")
    def _(v):
        return v.source.select("id", text.clean_text("html").alias("t"))

    @reg.add("X6_plain_key", "v_section", "SELECT id, CASE WHEN lower(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) IN ('none','null','nan') THEN '' ELSE trim(regexp_replace(regexp_replace(lower(regexp_replace(content, '^\\s+|\\s+$', '', 'g')), '[_\\-/]+', ' ', 'g'), '\\s+', ' ', 'g')) END AS k FROM v_section")
    def _(v):
        return v.section.select("id", text.normalise_key("content").alias("k"))

    @reg.add("X11_meaningful_terms", "v_section", "SELECT id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE l END, ' ') AS terms FROM (SELECT id, l, list_filter(l, lambda t: t NOT IN ('scheme','schemes','service','services','sector','related','for','the','and','business','company','client')) AS k FROM (SELECT id, list_filter(regexp_extract_all(lower(content), '[a-z0-9]+'), lambda t: length(t) > 2) AS l FROM v_section))")
    def _(v):
        return v.section.select("id", F.array_join(text.meaningful_terms("content"), " ").alias("terms"))

    @reg.add("X20_pitch_state", "v_service", f"""SELECT s.id, {CODE} AS pitch_code, CAST(CASE WHEN coalesce(s.effective_from > DATE '@TODAY', false) THEN NULL ELSE {END} - DATE '@TODAY' END AS BIGINT) AS days,
      CASE WHEN s.effective_from > DATE '@TODAY' THEN 'Effective From' WHEN {END} IS NULL THEN 'No Deadline' WHEN s.pitch_until = {END} THEN 'Pitch Until' ELSE 'Application Deadline' END AS label FROM v_service s""")
    def _(v):
        return cat.with_pitch_state(v.service, TODAY).select("id", "pitch_code", F.col("pitch_days").cast("bigint").alias("days"), F.col("pitch_end_label").alias("label"))

    @reg.add("X21_deadline_label", "v_service", """SELECT id, CASE WHEN application_deadline IS NOT NULL THEN strftime(application_deadline, '%d %b %Y') WHEN trim(application_deadline_raw) <> '' THEN trim(application_deadline_raw)
      WHEN deadline_status NOT IN ('','UNKNOWN') THEN CASE deadline_status WHEN 'DATED' THEN 'Specific Date' WHEN 'ROLLING' THEN 'Rolling' WHEN 'ONGOING' THEN 'Ongoing' WHEN 'OPEN' THEN 'Open' WHEN 'CLOSED' THEN 'Closed' WHEN 'NO_DEADLINE' THEN 'No Deadline' ELSE 'Other' END
      ELSE 'Not recorded' END AS label FROM v_service""")
    def _(v):
        return v.service.select("id", pitch.deadline_label().alias("label"))

    @reg.add("X24_display_values", "v_service", "SELECT id, CASE WHEN industries IS NULL THEN 'Not specified' ELSE array_to_string(list_filter(list_transform(industries, lambda x: trim(x)), lambda x: x <> ''), ', ') END AS shown FROM v_service")
    def _(v):
        return v.service.select("id", text.display_values("industries").alias("shown"))
