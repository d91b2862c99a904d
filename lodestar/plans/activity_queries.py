"""Analytics over the logs, and review operators over import batches and rows."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions import money
from ..operators import analytics as an
from ..operators import review as rv
from ..operators import windows as win
from ..session import scratch_dir
from .registry import Registry
from .views import BASE_TABLES, table

START, END = dt.date(2024, 1, 8), dt.date(2024, 1, 21)
RANGE = "day BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'"
NOW = dt.datetime(2025, 6, 15, 12)

GROUP_CTE = """g AS (SELECT grp, sum(n) AS n FROM (
   SELECT CASE event_type WHEN 'SEARCH' THEN 'search' WHEN 'CLIENT_MATCH' THEN 'client' ELSE 'filters' END AS grp, count(*) AS n FROM v_search_event WHERE event_type <> 'SUGGESTION_CLICK' GROUP BY 1
   UNION ALL
   SELECT CASE WHEN action = 'SERVICE_VIEW' THEN 'views' WHEN action IN ('SERVICE_SAVE','SERVICE_UNSAVE') OR action LIKE 'COLLECTION%' THEN 'saved'
     WHEN action LIKE 'SERVICE_FLYER%' THEN 'flyer' WHEN action = 'EXTERNAL_LINK_OPEN' THEN 'external' WHEN action IN ('LOGIN','LOGOUT') THEN 'sessions' ELSE 'other' END, count(*)
   FROM v_activity WHERE action NOT IN ('SEARCH','FILTER','CLIENT_MATCH') GROUP BY 1) GROUP BY 1)"""
AREA = "CASE WHEN grp IN ('search','filters') THEN 'discover' WHEN grp IN ('views','flyer','external') THEN 'research' WHEN grp IN ('client','saved') THEN grp ELSE 'system' END"


def register(reg: Registry) -> None:
    LOGS = "v_search_event v_activity"

    @reg.add("A1_period_counters", LOGS, f"""WITH s AS (SELECT user_id, count(*) FILTER (event_type='SEARCH') AS searches, count(*) FILTER (event_type='FILTER') AS filters, count(*) FILTER (event_type='CLIENT_MATCH') AS client_matches,
       count(*) FILTER (event_type='SEARCH' AND result_count=0) AS zero_results, count(*) FILTER (event_type='SEARCH' AND result_count>0) AS successful FROM v_search_event WHERE {RANGE} GROUP BY 1),
      a AS (SELECT user_id, count(*) FILTER (action='SERVICE_VIEW') AS views, count(*) FILTER (action='SERVICE_SAVE') AS saves, count(*) FILTER (action='SERVICE_UNSAVE') AS unsaves, count(*) FILTER (action='LOGIN') AS logins FROM v_activity WHERE {RANGE} GROUP BY 1)
      SELECT coalesce(s.user_id, a.user_id) AS user_id, coalesce(searches,0) AS searches, coalesce(filters,0) AS filters, coalesce(client_matches,0) AS client_matches, coalesce(zero_results,0) AS zero_results, coalesce(successful,0) AS successful,
       coalesce(views,0) AS views, coalesce(saves,0) AS saves, coalesce(unsaves,0) AS unsaves, coalesce(logins,0) AS logins FROM s FULL JOIN a ON s.user_id = a.user_id""")
    def _(v):
        return an.period_counters(v.search_event.where(an.in_range(START, END)), v.activity.where(an.in_range(START, END)))

    @reg.add("A2_unique_queries", "v_search_event", f"SELECT user_id, count(DISTINCT query) AS unique_queries FROM v_search_event WHERE event_type='SEARCH' AND query <> '' AND {RANGE} GROUP BY 1")
    def _(v):
        return an.unique_queries(v.search_event.where(an.in_range(START, END)))

    @reg.add("A3_daily_counts", "v_search_event", """SELECT CAST(d AS DATE) AS day, count(*) FILTER (event_type='SEARCH') AS searches, count(*) FILTER (event_type='CLIENT_MATCH') AS matches
      FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) g(d) LEFT JOIN v_search_event e ON e.day = CAST(d AS DATE) GROUP BY 1""")
    def _(v):
        d = an.daily_counts(v.search_event, dt.date(2023, 12, 25), dt.date(2024, 2, 5), ["SEARCH", "CLIENT_MATCH"])
        return d.select("day", F.col("SEARCH").alias("searches"), F.col("CLIENT_MATCH").alias("matches"))

    @reg.add("A4_month_grid", "v_search_event", """SELECT CAST(d AS DATE) AS day, CAST(floor((CAST(d AS DATE) - DATE '2024-01-01') / 7.0) AS BIGINT) AS week, CAST(d AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AS in_month, count(e.id) AS searches
      FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-04', INTERVAL 1 DAY) g(d) LEFT JOIN v_search_event e ON e.day = CAST(d AS DATE) AND e.event_type = 'SEARCH' GROUP BY 1, 2, 3""")
    def _(v):
        return an.month_grid(v.search_event, dt.date(2024, 1, 15))

    for key, zero, k in (("A5_top_queries", False, 6), ("A5_zero_result_queries", True, 8)):
        reg.add(key, "v_search_event", f"SELECT query, count(*) AS total FROM v_search_event WHERE event_type='SEARCH' AND query <> '' {'AND result_count = 0' if zero else ''} GROUP BY 1 ORDER BY total DESC, query LIMIT {k}")(
            lambda v, zero=zero, k=k: an.top_queries(v.search_event, k, zero))

    @reg.add("A5_top_queries_per_user", "v_search_event", """SELECT * FROM (SELECT user_id, query, total, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, query) AS rank FROM
      (SELECT user_id, query, count(*) AS total FROM v_search_event WHERE event_type='SEARCH' AND query <> '' GROUP BY 1, 2)) WHERE rank <= 6""")
    def _(v):
        return an.top_queries_per_user(v.search_event, 6).withColumn("rank", F.col("rank").cast("bigint"))

    @reg.add("A6_top_viewed", "v_activity v_service", """, t AS (SELECT target_id, count(*) AS total FROM v_activity WHERE action='SERVICE_VIEW' AND target_id <> '' GROUP BY 1 ORDER BY total DESC, target_id LIMIT 8)
      SELECT t.target_id, t.total, s.title FROM t JOIN v_service s ON CAST(s.id AS VARCHAR) = t.target_id""")
    def _(v):
        return an.top_viewed(v.activity, v.service)

    @reg.add("A7_activity_breakdown", LOGS, f"WITH {GROUP_CTE} SELECT grp, CAST(n AS BIGINT) AS n FROM g")
    def _(v):
        return an.activity_groups(v.search_event, v.activity, [])

    @reg.add("A7_daily_breakdown", LOGS, "WITH " + GROUP_CTE.replace("SELECT grp, sum(n) AS n", "SELECT day, grp, sum(n) AS n").replace("SELECT CASE", "SELECT day, CASE").replace("GROUP BY 1)", "GROUP BY 1, 2)").replace("GROUP BY 1\n", "GROUP BY 1, 2\n") + " SELECT day, grp, CAST(n AS BIGINT) AS n FROM g")
    def _(v):
        return an.activity_groups(v.search_event, v.activity, ["day"])

    @reg.add("A8_overview", LOGS, f"WITH {GROUP_CTE} SELECT {AREA} AS area, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1")
    def _(v):
        return an.overview(an.activity_groups(v.search_event, v.activity, []))

    @reg.add("A9_shares", LOGS, f"WITH {GROUP_CTE} SELECT grp, CAST(n AS BIGINT) AS n, CAST(round_even(n / sum(n) OVER () * 100, 0) AS BIGINT) AS percentage, greatest(4.0, round_even(n / max(n) OVER () * 100, 2)) AS relative_width FROM g")
    def _(v):
        return an.with_shares(an.activity_groups(v.search_event, v.activity, []))

    @reg.add("W11_donut_offsets", LOGS, f"""WITH {GROUP_CTE}, a AS (SELECT {AREA} AS area, sum(n) AS n FROM g GROUP BY 1),
      b AS (SELECT area, n, n / sum(n) OVER () * 100 AS share, CASE area WHEN 'discover' THEN 0 WHEN 'research' THEN 1 WHEN 'client' THEN 2 WHEN 'saved' THEN 3 ELSE 4 END AS ord FROM a)
      SELECT area, CAST(n AS BIGINT) AS n, round(share, 4) AS share, round(coalesce(sum(share) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start_at FROM b""")
    def _(v):
        d = an.donut(an.overview(an.activity_groups(v.search_event, v.activity, [])))
        return d.select("area", "n", F.round("share", 4).alias("share"), F.round("offset", 4).alias("start_at"))

    @reg.add("A10_hour_profile", "v_search_event", """, h AS (SELECT user_id, hour(created_at) AS hour, count(*) AS n FROM v_search_event GROUP BY 1, 2), k AS (SELECT user_id, event_type, count(*) AS n FROM v_search_event GROUP BY 1, 2),
      p AS (SELECT user_id, arg_max(hour, n * 100 + hour) AS hour FROM h GROUP BY 1), u AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS rn FROM k)
      SELECT p.user_id, p.hour AS peak_hour, printf('%02d:00–%02d:00', p.hour, (p.hour + 1) % 24) AS peak_period,
       CASE event_type WHEN 'SEARCH' THEN 'Toolkit Search' WHEN 'FILTER' THEN 'Toolkit Filters' WHEN 'CLIENT_MATCH' THEN 'Client Matcher' ELSE 'Search Suggestions' END AS feature FROM p JOIN u ON p.user_id = u.user_id AND u.rn = 1""")
    def _(v):
        return an.hour_profile(v.search_event)

    @reg.add("A11_day_detail", "v_search_event", """SELECT user_id, day, count(*) AS events, count(*) FILTER (event_type='SEARCH') AS searches, count(*) FILTER (event_type='FILTER') AS filters, count(*) FILTER (event_type='CLIENT_MATCH') AS matches,
      count(*) FILTER (event_type='SUGGESTION_CLICK') AS suggestions, count(*) FILTER (event_type='SEARCH' AND result_count>0) AS successful, count(*) FILTER (event_type='SEARCH' AND result_count=0) AS zero_results, CAST(sum(result_count) AS BIGINT) AS total_results FROM v_search_event GROUP BY 1, 2""")
    def _(v):
        return an.day_detail(v.search_event)

    @reg.add("A22_admin_overview", "v_service v_user v_activity", """SELECT (SELECT count(*) FROM v_user) AS employees, (SELECT count(*) FROM v_user WHERE is_account_active) AS active_employees, (SELECT count(*) FROM v_service) AS services,
      (SELECT count(*) FROM v_service WHERE status IN ('APPROVED','PUBLISHED')) AS published, (SELECT count(*) FROM v_activity WHERE action = 'LOGIN') AS sessions""")
    def _(v):
        from ..functions.pitch import visible_for_role
        u = v.user.agg(F.count(F.lit(1)).alias("employees"), F.count_if("is_account_active").alias("active_employees"))
        s = v.service.agg(F.count(F.lit(1)).alias("services"), F.count_if(visible_for_role("BDE")).alias("published"))
        a = v.activity.agg(F.count_if(F.col("action") == "LOGIN").alias("sessions"))
        one = F.lit(1).alias("one")  # three one-row frames side by side
        return u.select("*", one).join(s.select("*", one), "one").join(a.select("*", one), "one").drop("one")

    @reg.add("A23_employee_counts", "v_user", "SELECT count(*) AS total, count(*) FILTER (is_account_active) AS active, count(*) FILTER (is_account_active AND role = 'BDE') AS active_bde FROM v_user")
    def _(v):
        return v.user.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_account_active").alias("active"),
                          F.count_if(F.col("is_account_active") & (F.col("role") == "BDE")).alias("active_bde"))

    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
            "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id", "embeddings": "vec_id"}
    widths = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4, "embeddings": 3}

    @reg.add("A25_dataset_profile", "", " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({widths[t]} AS BIGINT) AS column_count, count(DISTINCT {keys[t]}) AS distinct_keys, CAST(0 AS BIGINT) AS null_cells FROM {t}" for t in BASE_TABLES))
    def _(v):
        parts = [an.table_profile(t, table(v.spark, v.sf_dir, t), keys[t]) for t in BASE_TABLES]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    fks = [("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
           ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"), ("labels_documents", "labels", "doc_id", "documents", "doc_id"), ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey")]

    @reg.add("A25_orphan_references", "", " UNION ALL ".join(
        f"SELECT '{n}' AS relation, count(*) AS orphans FROM {c} c WHERE c.{fk} NOT IN (SELECT {k} FROM {p})" for n, c, fk, p, k in fks))
    def _(v):
        out = None
        for n, c, fk, p, k in fks:
            one = an.orphan_count(n, table(v.spark, v.sf_dir, c), fk, table(v.spark, v.sf_dir, p), k)
            out = one if out is None else out.unionByName(one)
        return out

    @reg.add("F14_activity_search", "v_activity v_user", """SELECT a.id, u.username, a.description FROM v_activity a LEFT JOIN v_user u ON u.id = a.user_id WHERE a.action = 'SERVICE_VIEW'
      AND (contains(lower(a.description), '10') OR contains(u.username, '10') OR contains(lower(u.employee_id), '10') OR contains(a.ip_address, '10'))""")
    def _(v):
        return an.activity_log_search(v.activity, v.user, "SERVICE_VIEW", "10").select("id", "username", "description")

    @reg.add("F19_date_range", "v_search_event", "SELECT user_id, count(*) AS n FROM v_search_event WHERE day BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' GROUP BY 1")
    def _(v):
        start, end = an.resolve_range(dt.date(2024, 1, 20), preset="7d")
        return v.search_event.where(an.in_range(start, end)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

    @reg.add("F22_retention_dry_run", LOGS, """SELECT 'activity_routine' AS source, count(*) AS removed FROM v_activity WHERE action NOT IN ('LOGIN_FAILED','LOGIN_BLOCKED','PERMISSION_DENIED') AND created_at < TIMESTAMP '2024-01-17 12:00:00'
      UNION ALL SELECT 'activity_security', count(*) FROM v_activity WHERE action IN ('LOGIN_FAILED','LOGIN_BLOCKED','PERMISSION_DENIED') AND created_at < TIMESTAMP '2024-01-07 12:00:00'
      UNION ALL SELECT 'login_session', count(*) FROM v_activity WHERE action = 'LOGIN' AND created_at < TIMESTAMP '2024-01-17 12:00:00'
      UNION ALL SELECT 'search_event', count(*) FROM v_search_event WHERE created_at < TIMESTAMP '2024-01-17 12:00:00'""")
    def _(v):
        return an.retention_counts(v.activity, v.activity.where("action = 'LOGIN'"), v.search_event, dt.datetime(2025, 6, 15, 12), 515, 525)

    @reg.add("M8_retention_kept", "v_activity", """SELECT id, action FROM v_activity WHERE NOT (CASE WHEN action IN ('LOGIN_FAILED','LOGIN_BLOCKED','PERMISSION_DENIED') THEN created_at < TIMESTAMP '2024-01-07 12:00:00' ELSE created_at < TIMESTAMP '2024-01-17 12:00:00' END)""")
    def _(v):
        return v.activity.where(~an.retention_split(NOW, 515, 525, "created_at", "action")).select("id", "action")

    @reg.add("M8_retention_rewrite", "v_activity", """SELECT id, action FROM v_activity WHERE NOT (CASE WHEN action IN ('LOGIN_FAILED','LOGIN_BLOCKED','PERMISSION_DENIED') THEN created_at < TIMESTAMP '2024-01-07 12:00:00' ELSE created_at < TIMESTAMP '2024-01-17 12:00:00' END)""")
    def _(v):
        from ..streaming import activity as ac

        path = f"{scratch_dir(v.spark)}/log-{uuid.uuid4().hex}"
        ac.append_events(v.activity.drop("day"), path)
        ac.retain(v.spark, path, NOW, 515, 525)
        return v.spark.read.parquet(path).select("id", "action")

    @reg.add("F24_numeric_targets", "v_activity", "SELECT id, TRY_CAST(target_id AS BIGINT) AS target FROM v_activity WHERE regexp_full_match(target_id, '[0-9]+')")
    def _(v):
        return v.activity.select("id", F.expr("try_cast(target_id AS bigint)").alias("target")).where("target IS NOT NULL")

    @reg.add("U4_recent_feed", LOGS, """SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at_time, grp, description, detail FROM (
      SELECT created_at, id, CASE event_type WHEN 'SEARCH' THEN 'search' WHEN 'CLIENT_MATCH' THEN 'client' ELSE 'filters' END AS grp,
        CASE WHEN event_type='CLIENT_MATCH' THEN 'Checked suitable services for a client' WHEN event_type='FILTER' THEN 'Applied Service Library filters' WHEN query <> '' THEN 'Searched for "' || query || '"' ELSE 'Completed a Toolkit search' END AS description,
        result_count || CASE WHEN result_count = 1 THEN ' result' ELSE ' results' END AS detail FROM v_search_event WHERE event_type <> 'SUGGESTION_CLICK'
      UNION ALL SELECT created_at, id, CASE WHEN action = 'SERVICE_VIEW' THEN 'views' WHEN action IN ('SERVICE_SAVE','SERVICE_UNSAVE') OR action LIKE 'COLLECTION%' THEN 'saved' WHEN action LIKE 'SERVICE_FLYER%' THEN 'flyer'
        WHEN action = 'EXTERNAL_LINK_OPEN' THEN 'external' WHEN action IN ('LOGIN','LOGOUT') THEN 'sessions' ELSE 'other' END, description,
        array_to_string(list_transform(string_split(lower(action), '_'), lambda w: upper(w[1]) || w[2:]), ' ') FROM v_activity WHERE action NOT IN ('SEARCH','FILTER','CLIENT_MATCH'))
      ORDER BY created_at DESC, id DESC LIMIT 12""")
    def _(v):
        return an.recent_feed(v.search_event, v.activity).select(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at_time"), "grp", "description", "detail")

    @reg.add("T6_recent_searches", "v_search_event", "SELECT id, query FROM v_search_event WHERE event_type='SEARCH' ORDER BY created_at DESC, id DESC LIMIT 20")
    def _(v):
        return v.search_event.where("event_type='SEARCH'").orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id", "query")

    @reg.add("X22_clock", "v_search_event", "SELECT id, strftime(created_at, '%I:%M %p') AS console_time, round_even((hour(created_at) * 60 + minute(created_at)) / 1440.0 * 100, 2) AS timeline_pct FROM v_search_event")
    def _(v):
        return v.search_event.select("id", *an.clock_columns())

    @reg.add("X23_units", "v_client", "SELECT client_id, CAST(annual_turnover * 100000 AS DOUBLE) AS rupees, CAST(floor((client_id % 40) / 4.0 * 12) AS BIGINT) AS months FROM v_client")
    def _(v):
        return v.client.select("client_id", money.turnover_in_rupees(F.col("annual_turnover"), F.lit("LAKH")).cast("double").alias("rupees"),
                               money.age_in_months((F.col("client_id") % 40) / 4).cast("bigint").alias("months"))

    @reg.add("M15_saved_state", "v_activity", """SELECT user_id, target_id FROM (SELECT user_id, target_id, action, row_number() OVER (PARTITION BY user_id, target_id ORDER BY created_at DESC, id DESC) AS rn
      FROM v_activity WHERE action IN ('SERVICE_SAVE','SERVICE_UNSAVE')) WHERE rn = 1 AND action = 'SERVICE_SAVE'""")
    def _(v):
        return an.saved_state(v.activity)

    # ---- import batches and rows ---------------------------------------------------------
    @reg.add("F15_import_history", "v_batch", "SELECT id, source_name FROM v_batch WHERE source_type='CSV' AND status='IMPORTED' AND (contains(lower(source_name), '7') OR contains(file_sha256, '7'))")
    def _(v):
        return rv.history(v.batch, "CSV", "IMPORTED", "7").select("id", "source_name")

    @reg.add("F16_latest_reviewable", "v_batch v_row", """SELECT id FROM v_batch b WHERE status IN ('PREVIEWED','VALIDATED') AND NOT contains(metadata, 'true') AND EXISTS (SELECT 1 FROM v_row r WHERE r.batch_id = b.id) ORDER BY created_at DESC, id DESC LIMIT 1""")
    def _(v):
        return rv.latest_reviewable(v.batch, v.row)

    @reg.add("J5_change_flag", "v_batch v_change", "SELECT b.id, EXISTS (SELECT 1 FROM v_change c WHERE c.batch_id = b.id AND NOT c.is_reversed) AS has_changes FROM v_batch b")
    def _(v):
        return rv.with_change_flag(v.batch.select("id"), v.change)

    @reg.add("J12_rows_of_service", "v_row", "SELECT DISTINCT service_id, row_id FROM (SELECT imported_service_id AS service_id, id AS row_id FROM v_row UNION ALL SELECT matched_service_id, id FROM v_row) WHERE service_id IS NOT NULL")
    def _(v):
        return rv.rows_of_service(v.row)

    @reg.add("J16_duplicate_batches", "v_batch", "SELECT b.id, (SELECT min(o.id) FROM v_batch o WHERE o.file_sha256 = b.file_sha256 AND o.id <> b.id AND o.status = 'IMPORTED') AS duplicate_of FROM v_batch b WHERE duplicate_of IS NOT NULL")
    def _(v):
        return rv.duplicate_batches(v.batch)

    for key, col in (("W12_previous_same_file", "file_sha256"), ("W12_previous_same_name", "source_name")):
        reg.add(key, "v_batch", f"SELECT id, lag(id) OVER (PARTITION BY {col} ORDER BY created_at, id) AS previous_id FROM v_batch")(
            lambda v, col=col: rv.previous_batch(v.batch, col).select("id", "previous_id"))

    stats_sql = """, f AS (SELECT *, CASE candidate_action WHEN 'SKIP' THEN false WHEN 'CREATE' THEN delta_status <> 'NEW_SERVICE' WHEN 'UPDATE' THEN delta_status NOT IN ('NO_CHANGE','SAFE_ADDITION') ELSE true END AS att FROM v_row)"""

    @reg.add("A15_review_stats", "v_row", stats_sql + """ SELECT batch_id, count(*) AS source_rows, count(*) FILTER (candidate_action <> 'UNDECIDED') AS candidates, count(*) FILTER (candidate_action = 'CREATE') AS create_rows, count(*) FILTER (candidate_action = 'UPDATE') AS update_rows,
      count(*) FILTER (candidate_action = 'UPDATE' AND NOT att) AS safe_update, count(*) FILTER (candidate_action = 'MERGE_REVIEW') AS merge_review, count(*) FILTER (candidate_action <> 'UNDECIDED' AND att) AS needs_attention,
      count(*) FILTER (candidate_action NOT IN ('UNDECIDED','SKIP') AND delta_status = 'CHANGED_INFORMATION') AS blocked, count(*) FILTER (candidate_action <> 'UNDECIDED' AND decision = 'APPROVED' AND NOT att) AS approved,
      count(*) FILTER (candidate_action = 'SKIP') AS skipped, count(*) FILTER (candidate_action = 'UNDECIDED') AS knowledge_rows FROM f GROUP BY 1""")
    def _(v):
        return rv.review_stats(v.row)

    dec = "CASE WHEN candidate_action = 'SKIP' THEN 'SKIPPED' ELSE upper(coalesce(nullif(decision, ''), 'PENDING')) END"

    @reg.add("A16_batch_preview", "v_row", f""", f AS (SELECT *, {dec} AS d FROM v_row WHERE candidate_action <> 'UNDECIDED') SELECT batch_id, count(*) AS candidate_rows, count(*) FILTER (delta_status='NEW_SERVICE') AS new_service, count(*) FILTER (delta_status='NO_CHANGE') AS no_change,
      count(*) FILTER (delta_status='SAFE_ADDITION') AS safe_addition, count(*) FILTER (delta_status='CHANGED_INFORMATION') AS changed_information, count(*) FILTER (delta_status='CONFLICT') AS conflict,
      count(*) FILTER (d='APPROVED') AS approved, count(*) FILTER (d='SKIPPED') AS skipped, count(*) FILTER (d NOT IN ('APPROVED','SKIPPED') AND delta_status <> 'NO_CHANGE') AS pending_changes FROM f GROUP BY 1""")
    def _(v):
        return rv.batch_preview(v.row)

    @reg.add("A17_history_totals", "v_batch", "SELECT count(*) AS batches, count(DISTINCT file_sha256) AS unique_sources, count(*) FILTER (contains(metadata, 'true')) AS duplicates, CAST(sum(row_count) AS BIGINT) AS rows_processed FROM v_batch")
    def _(v):
        return rv.history_totals(v.batch)

    @reg.add("A18_action_counts", "v_row", "SELECT sheet_name, candidate_action, validation_status, count(*) AS n FROM v_row GROUP BY 1, 2, 3")
    def _(v):
        return v.row.groupBy("sheet_name", "candidate_action", "validation_status").agg(F.count(F.lit(1)).alias("n"))

    @reg.add("A26_active_changes", "v_change", "SELECT batch_id, count(*) AS active_changes FROM v_change WHERE NOT is_reversed GROUP BY 1")
    def _(v):
        return rv.active_changes(v.change)

    ready = "candidate_action IN ('CREATE','UPDATE') AND validation_status = 'VALID' AND upper(coalesce(decision,'')) NOT IN ('SKIPPED','APPROVED') AND (candidate_action = 'CREATE' OR matched_service_id IS NOT NULL)"

    @reg.add("M10_approve_ready", "v_row", f"SELECT id, CASE WHEN {ready} THEN 'APPROVED' ELSE decision END AS new_decision FROM v_row")
    def _(v):
        return rv.approve_ready(v.row).select("id", "new_decision")

    @reg.add("M10_blockers", "v_row", """SELECT id, reason FROM (SELECT id, CASE WHEN candidate_action = 'MERGE_REVIEW' THEN 'possible duplicate needs a decision' WHEN candidate_action = 'INVALID' THEN 'invalid item needs review or skip'
      WHEN validation_status <> 'VALID' THEN 'validation is not clean' WHEN candidate_action = 'UPDATE' AND matched_service_id IS NULL THEN 'update without a matched service' END AS reason FROM v_row
      WHERE candidate_action NOT IN ('UNDECIDED','SKIP') AND upper(coalesce(decision,'')) <> 'SKIPPED' AND NOT (candidate_action IN ('CREATE','UPDATE') AND upper(coalesce(decision,'')) = 'APPROVED')) WHERE reason IS NOT NULL""")
    def _(v):
        return rv.blockers(v.row).select("id", "reason")

    dsql = """dd AS (SELECT id AS row_id, CASE CAST(quantity AS BIGINT) % 4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'SKIPPED' WHEN 2 THEN 'RESTORE' ELSE 'PENDING' END AS decision, reviewed_at AS decided_at, 1 AS seq FROM v_row WHERE quantity > 20
      UNION ALL SELECT id, 'APPROVED', TIMESTAMP '1999-01-01', 0 FROM v_row WHERE quantity < 30)"""

    @reg.add("M11_apply_decisions", "v_row", f"""WITH {dsql}, l AS (SELECT row_id, decision, row_number() OVER (PARTITION BY row_id ORDER BY decided_at DESC, seq DESC) AS rn FROM dd)
      SELECT r.id, CASE WHEN l.decision = 'SKIPPED' THEN 'SKIP' WHEN l.decision = 'RESTORE' AND r.candidate_action = 'SKIP' THEN CASE WHEN r.matched_service_id IS NOT NULL THEN 'UPDATE' ELSE 'CREATE' END ELSE r.candidate_action END AS new_action,
       CASE WHEN l.decision = 'RESTORE' THEN 'PENDING' ELSE coalesce(l.decision, r.decision) END AS new_decision FROM v_row r LEFT JOIN l ON l.row_id = r.id AND l.rn = 1""")
    def _(v):
        r = v.row
        kinds = F.array(*[F.lit(x) for x in ("APPROVED", "SKIPPED", "RESTORE", "PENDING")])
        a = r.where("quantity > 20").select(F.col("id").alias("row_id"), F.element_at(kinds, (F.col("quantity").cast("bigint") % 4 + 1).cast("int")).alias("decision"),
                                            F.col("reviewed_at").cast("timestamp").alias("decided_at"), F.lit(1).alias("seq"))
        b = r.where("quantity < 30").select(F.col("id").alias("row_id"), F.lit("APPROVED").alias("decision"), F.lit("1999-01-01").cast("timestamp").alias("decided_at"), F.lit(0).alias("seq"))
        return rv.apply_decisions(r, a.union(b)).select("id", "new_action", "new_decision")

    @reg.add("M12_review_flags", "v_row", stats_sql + " SELECT id, att AS needs_attention, candidate_action <> 'SKIP' AND NOT att AS can_approve, candidate_action <> 'SKIP' AND delta_status = 'CHANGED_INFORMATION' AS is_changed, confidence >= 0.8 AS clear_suggestion FROM f")
    def _(v):
        return rv.derive_flags(v.row).select("id", "needs_attention", "can_approve", "is_changed", "clear_suggestion")

    @reg.add("M13_reconciliation_rows", "v_row", """SELECT id, CASE delta_status WHEN 'NO_CHANGE' THEN 'SKIP' WHEN 'SAFE_ADDITION' THEN 'UPDATE' END AS rec_action, CASE delta_status WHEN 'NO_CHANGE' THEN 'SKIPPED' WHEN 'SAFE_ADDITION' THEN 'PENDING' END AS rec_decision,
      delta_status NOT IN ('NO_CHANGE','SAFE_ADDITION') AS unsafe FROM v_row WHERE candidate_action <> 'UNDECIDED'""")
    def _(v):
        return rv.reconciliation_rows(v.row).select("id", "rec_action", "rec_decision", "unsafe")

    @reg.add("M16_deletable_sources", "v_batch", "SELECT id FROM v_batch WHERE source_type = 'CSV' AND status <> 'IMPORTED'")
    def _(v):
        return rv.deletable(v.batch, v.batch.where("source_type = 'CSV'").select("id"))

    @reg.add("W3_append_sequence", "v_section v_rule", """, m AS (SELECT service_id, max(display_order) AS top FROM v_rule GROUP BY 1)
      SELECT s.id, s.service_id, coalesce(m.top, 0) + row_number() OVER (PARTITION BY s.service_id ORDER BY s.id) AS seq FROM v_section s LEFT JOIN m ON m.service_id = s.service_id""")
    def _(v):
        top = v.rule.groupBy("service_id").agg(F.max("display_order").alias("top"))
        numbered = win.group_row_number(v.section.select("id", "service_id"), ["service_id"], F.floor(F.col("id") / 100_000), ["id"], "n")
        return numbered.join(top, "service_id", "left").select("id", "service_id", (F.coalesce("top", F.lit(0)) + F.col("n")).alias("seq"))

    @reg.add("W5_first_seen", "v_section", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) ORDER BY id) AS rn FROM v_section) WHERE rn = 1")
    def _(v):
        from ..functions.text import normalize_ws
        prints = v.section.select("id", F.sha2(normalize_ws("content"), 256).alias("fp"))
        return prints.groupBy("fp").agg(F.min("id").alias("id")).select("id")
