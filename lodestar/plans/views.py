"""Bindings from the supplied parquet tables to the catalogue data model.

Every view is one SELECT that both Spark and the SQL oracle can run. The few dialect
differences are written with ``@`` marks (array literal, array type, SHA-256). ``@TODAY`` is
the evaluation day.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import group_row_number

TODAY = "2024-06-15"


def pick(expr: str, values: list[str], quote: bool = True) -> str:
    """CASE expression choosing ``values[expr mod len(values)]``."""
    arms = " ".join(
        f"WHEN {i} THEN " + (f"'{v}'" if quote else v) for i, v in enumerate(values)
    )
    return f"(CASE CAST(({expr}) % {len(values)} AS INT) {arms} END)"


def _arr(*values: str) -> str:
    return "@ARRAY(" + ", ".join(f"'{v}'" for v in values) + ")"


QUERY_TEXTS = [
    "loan for women in dairy", "mujhe startup ke liye seed funding chahiye", "5 lakh grant", "1.5 crore equity", "ai",
    "iot device", "artificial intelligence startup funding", "Food Technology subsidy scheme", "red ring", "GST refund",
    "income tax exemption for start-up", "animal husbandry loan 25 lakh msme", "certificate", "small bolt grant",
    "zzz nothing matches this zzz", "export & import_credit", "venture capital", "section 8 company research", "ention",
    "Grant of Rs. 5.00 Lakh", "hot gear registration", "machinery", "the whole thing", "tech growth",
]
NO_ARRAY = "CAST(NULL AS @STRARRAY)"

SERVICE_SQL = f"""
SELECT p.p_partkey AS id,
  'SVC-' || lpad(CAST(p.p_partkey AS STRING), 8, '0') AS service_id,
  p.p_name || ' ' || {pick('p.p_size', ['grant', 'loan scheme', 'seed fund', 'registration', 'certificate', 'programme'])} AS title,
  'svc-' || CAST(p.p_partkey AS STRING) AS slug,
  CAST((p.p_partkey * 7) % 25 AS BIGINT) AS category_id,
  CAST(((p.p_partkey * 7) % 25) % 5 AS BIGINT) AS domain_id,
  {pick('p.p_partkey', ['REGISTRATION', 'COMPLIANCE', 'CERTIFICATION', 'GOVT_SCHEME', 'GRANT', 'LOAN', 'DEBT', 'EQUITY', 'VC', 'SUBSIDY', 'LEGAL', 'DIGITAL', 'CONSULTING', 'OTHER'])} AS service_kind,
  {pick('p.p_partkey', ['PUBLISHED', 'APPROVED', 'PUBLISHED', 'EXPIRING', 'DRAFT', 'PUBLISHED', 'UNDER_REVIEW', 'APPROVED', 'ARCHIVED'])} AS status,
  {pick('p.p_size', ['CRITICAL', 'HIGH', 'NORMAL', 'LOW', ''])} AS priority,
  CASE WHEN p.p_partkey % 5 = 0 THEN NULL WHEN p.p_partkey % 12 = 0 THEN DATE '@TODAY' + CAST((p.p_partkey * 17) % 131 - 65 AS INT) ELSE DATE '@TODAY' - CAST((p.p_partkey * 17) % 131 AS INT) END AS effective_from,
  CASE WHEN p.p_partkey % 3 = 0 THEN NULL ELSE DATE '@TODAY' + CAST((p.p_partkey * 7) % 90 - 20 AS INT) END AS pitch_until,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE DATE '@TODAY' + CAST((p.p_partkey * 11) % 120 - 15 AS INT) END AS application_deadline,
  CASE WHEN p.p_partkey % 8 = 0 THEN ' Rolling basis ' ELSE '' END AS application_deadline_raw,
  {pick('p.p_partkey', ['UNKNOWN', 'DATED', 'ROLLING', 'ONGOING', 'OPEN', 'CLOSED', 'NO_DEADLINE', 'OTHER', ''])} AS deadline_status,
  {pick('p.p_partkey', [NO_ARRAY, _arr('AUTOMOBILE', 'Machinery'), _arr('All Industries'), _arr('BUILDING', ' building ', 'Household'), _arr('FURNITURE'), _arr('HOUSEHOLD', 'Food Processing', ''), _arr('MACHINERY')], quote=False)} AS industries,
  {pick('p.p_partkey', [_arr('Private Limited', 'LLP'), NO_ARRAY, _arr('Proprietorship'), _arr('All Business Types'), _arr('OPC', 'LLP')], quote=False)} AS business_types,
  {pick('p.p_size', [NO_ARRAY, _arr('Idea Stage', 'MVP Stage'), _arr('Growth Stage'), _arr('any')], quote=False)} AS business_stages,
  {pick('p.p_partkey', [_arr('Pan India'), NO_ARRAY, _arr('NATION_1', 'NATION_2', 'NATION_3'), _arr('nation_4', 'Nation_5'), _arr('NATION_6', 'NATION_7', 'NATION_8', 'NATION_9')], quote=False)} AS applicable_states,
  {pick('p.p_size', [NO_ARRAY, _arr('Women'), NO_ARRAY, _arr('SC', 'ST'), _arr('All Founders'), NO_ARRAY], quote=False)} AS founder_categories,
  CAST({pick('p.p_partkey', ['NULL', '12', 'NULL', '24'], quote=False)} AS INT) AS min_business_age_months,
  CAST({pick('p.p_size', ['NULL', '120', '60', 'NULL', '36'], quote=False)} AS INT) AS max_business_age_months,
  CAST({pick('p.p_partkey', ['NULL', 'NULL', '1000', 'NULL', '2500.50'], quote=False)} AS DECIMAL(16,2)) AS min_turnover,
  CAST({pick('p.p_size', ['NULL', '5000', 'NULL', '9000.25'], quote=False)} AS DECIMAL(16,2)) AS max_turnover,
  CASE WHEN p.p_partkey % 4 = 1 THEN '  ' ELSE 'Supports ' || p.p_name || ' makers with credit up to ' || CAST(p.p_size AS STRING) || ' lakh' END AS bde_summary,
  CASE WHEN p.p_partkey % 7 = 2 THEN '' ELSE p.p_brand || ' scheme for ' || {pick('p.p_partkey', ['women entrepreneurs', 'dairy and livestock units', 'start-up founders', 'exporters', 'food technology ventures', 'AI research labs', 'paid campaigns'])} END AS overview,
  CASE WHEN p.p_partkey % 3 = 1 THEN '' ELSE {pick('p.p_size', ['Grant of Rs. 5.00 Lakh', 'Interest subsidy of 25 lakh', 'Seed funding up to 1.5 crore', 'Income tax exemption', 'GST refund'])} END AS benefits,
  CASE WHEN p.p_partkey % 6 = 5 THEN '' ELSE {pick('p.p_partkey', ['Private Limited or LLP incorporated within the last 7 years', 'Registered Society or Trust in Gujarat and West Bengal', 'Partnership firm engaged in manufacturing, annual turnover of the unit not exceeding Rs. 25 lakh', 'Limited Liability Partnership at idea stage, pan india', 'Only for women with a minimum viable product in food processing', 'Proprietorship up to 10 years from the date of incorporation in Tamil Nadu', 'Technology start-up, pre-revenue, turnover below 2 crore in Kerala', 'Section 8 company doing research and development, exclusively for SC'])} END AS eligibility_summary,
  {pick('p.p_size', ['', 'MSME units', 'Startups and individuals', 'Cooperative bodies', 'HUF or OPC'])} AS applicable_for_raw,
  {pick('p.p_partkey', ['Central Bank', '', 'State Agency', 'Venture Capital Council'])} AS funding_organisation,
  {pick('p.p_partkey', ['Grant', 'Debt', 'Equity', ''])} AS funding_type,
  CASE WHEN p.p_partkey % 9 = 4 THEN 'Capital subsidy of 15% and 2 lakh' ELSE '' END AS subsidy_details,
  CASE WHEN p.p_partkey % 10 = 3 THEN 'Great for IoT device makers' ELSE '' END AS sales_pitch,
  CASE WHEN p.p_partkey % 12 = 7 THEN 'Not for listed companies' ELSE '' END AS restrictions,
  CASE WHEN p.p_partkey % 13 = 9 THEN 'Please note: growth stage only' ELSE '' END AS important_notes,
  CAST('@TODAY 12:00:00' AS TIMESTAMP) - CAST(p.p_partkey % 97 AS INT) * INTERVAL '1' HOUR AS updated_at,
  p.p_retailprice AS retail_price
FROM {{part}} p
"""

SHEET_ROWS = """        SELECT 'Sheet_' || CAST(cat AS STRING) AS sheet, 0 AS ord, cat AS id, 0 AS sub,
          CASE cat % 4 WHEN 0 THEN @ARRAY('Updated list', '', '') WHEN 1 THEN @ARRAY('Service', 'Vendor Cost', 'Our Fee', 'Remarks') WHEN 3 THEN @ARRAY('Sr No', 'Benefit') ELSE @ARRAY('Programme overview') END AS vals,
          @ARRAY('', '', '', '') AS urls
          FROM (SELECT DISTINCT (p_partkey * 7) % 25 AS cat FROM {part}) c WHERE cat % 4 <> 2
        UNION ALL SELECT 'Sheet_' || CAST(cat AS STRING), 1, cat, 0, @ARRAY('Scheme Name', 'Benefits', 'Eligibility Criteria', 'Last Date', 'Portal Link'), @ARRAY('', '', '', '', '')
          FROM (SELECT DISTINCT (p_partkey * 7) % 25 AS cat FROM {part}) c WHERE cat % 4 = 0
        UNION ALL SELECT 'Sheet_' || CAST((p_partkey * 7) % 25 AS STRING), 2, p_partkey, 0,
          CASE ((p_partkey * 7) % 25) % 4
            WHEN 0 THEN @ARRAY(p_name || ' ' || CASE p_size % 3 WHEN 0 THEN 'seed funding' WHEN 1 THEN 'loan' ELSE 'certificate' END, CASE WHEN p_size % 2 = 0 THEN 'Grant of Rs. 5 lakh' ELSE '' END, 'Registered MSME', CAST(p_size AS STRING) || ' March', 'https://portal.example/' || CAST(p_partkey AS STRING))
            WHEN 1 THEN @ARRAY(p_name || ' registration', 'Rs ' || CAST(p_size * 100 AS STRING), CASE WHEN p_size % 3 = 0 THEN '' ELSE 'Rs 10' END, '')
            WHEN 2 THEN @ARRAY(p_name || ' ' || CASE p_size % 6 WHEN 0 THEN 'grant' WHEN 1 THEN 'loan scheme' WHEN 2 THEN 'seed fund' WHEN 3 THEN 'registration' WHEN 4 THEN 'certificate' ELSE 'programme' END, 'Equity support up to ' || CAST(p_size AS STRING) || ' lakh', 'Applicant should be private limited', 'Dairy and food technology')
            ELSE @ARRAY(CAST(p_partkey AS STRING), p_name) END,
          CASE WHEN p_size % 5 = 0 THEN @ARRAY('', 'https://link.example/' || p_brand, '', '', '') ELSE @ARRAY('', '', '', '', '') END
          FROM {part}
        UNION ALL SELECT 'Story_' || source, 3, doc_id, 0, @ARRAY(CASE doc_id % 6 WHEN 0 THEN 'Eligibility:' WHEN 1 THEN '*Documents required*' WHEN 2 THEN 'small ring grant' WHEN 3 THEN 'Benefits' WHEN 4 THEN 'How to apply' ELSE 'Other details' END, ''), @ARRAY('', '') FROM {documents}
        UNION ALL SELECT 'Story_' || source, 3, doc_id, 1, @ARRAY(text), @ARRAY('') FROM {documents}"""
#: ids of a sheet's rows that are numbered in one task
SHEET_IDS = 10_000

VIEW_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_service": (SERVICE_SQL, ("part",)),
    "v_domain": (
        f"""SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, lower(replace(r_name, ' ', '-')) AS slug,
        CAST((r_regionkey * 3) % 5 AS BIGINT) AS display_order, r_regionkey <> 3 AS is_active FROM {{region}}""",
        ("region",),
    ),
    "v_category": (
        """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, lower(n_name) AS slug,
        CAST(n_nationkey % 5 AS BIGINT) AS domain_id, CAST((n_nationkey * 7) % 11 AS BIGINT) AS display_order,
        n_nationkey % 9 <> 4 AS is_active FROM {nation}""",
        ("nation",),
    ),
    "v_classification": (
        """SELECT p_partkey AS service_id, CAST((p_partkey * 7 + 3) % 25 AS BIGINT) AS category_id FROM {part} WHERE p_partkey % 2 = 0
        UNION ALL
        SELECT p_partkey AS service_id, CAST((p_partkey + p_size) % 25 AS BIGINT) AS category_id FROM {part}
        WHERE p_partkey % 3 = 0 AND NOT (p_partkey % 2 = 0 AND (p_partkey * 7 + 3) % 25 = (p_partkey + p_size) % 25)""",
        ("part",),
    ),
    "v_client": (
        f"""SELECT c_custkey AS client_id,
        {pick('c_custkey', ["'Private Limited'", "'LLP'", 'CAST(NULL AS STRING)', "'Proprietorship'", "'OPC'", "'Trust'"], quote=False)} AS business_type,
        {pick('c_custkey', ["'Idea Stage'", 'CAST(NULL AS STRING)', "'growth  stage'"], quote=False)} AS business_stage,
        CASE WHEN c_custkey % 11 = 5 THEN NULL ELSE c_mktsegment END AS industry,
        CASE WHEN c_custkey % 13 = 6 THEN NULL ELSE n_name END AS state,
        {pick('c_custkey', ['CAST(NULL AS STRING)', "'Women'", "'General'", "'SC'"], quote=False)} AS founder_category,
        CAST(CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE (c_custkey * 5) % 150 END AS INT) AS business_age_months,
        CAST(CASE WHEN c_custkey % 9 = 1 THEN NULL ELSE c_acctbal END AS DECIMAL(16,2)) AS annual_turnover,
        {pick('c_custkey', ['', 'loan for women', 'seed fund', 'ai ring', '5 lakh grant', 'gear'])} AS need_query
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
        ("customer", "nation"),
    ),
    "v_sheet": (
        f"""SELECT 'catalogue' AS file, sheet, CAST(row_number() OVER (PARTITION BY sheet ORDER BY ord, id, sub) AS INT) AS row_no, vals AS values, urls AS links FROM (
{SHEET_ROWS}) x""",
        ("part", "documents"),
    ),
    "v_query": (
        f"""SELECT query, min(c_custkey) AS query_id FROM (SELECT c_custkey, {pick('c_custkey', QUERY_TEXTS)} ||
        CASE WHEN c_custkey % 9 < 7 THEN '' ELSE ' ' || lower(c_mktsegment) END AS query FROM {{customer}}) c GROUP BY query""",
        ("customer",),
    ),
    "v_section": (
        f"""SELECT doc_id AS id, doc_id % (SELECT count(*) FROM {{part}}) AS service_id, source AS title, text AS content,
        {pick('doc_id', ['OVERVIEW', 'BENEFITS', 'ELIGIBILITY', 'FUNDING', 'PROCESS', 'DOCUMENTS', 'NOTES', 'COMMERCIAL', 'OTHER'])} AS section_type,
        CASE WHEN doc_id % 3 = 2 THEN 'ADMIN_ONLY' ELSE 'BDE' END AS visibility, lang,
        CAST(doc_id % 17 AS BIGINT) AS display_order FROM {{documents}}""",
        ("documents", "part"),
    ),
    "v_source": (
        f"""SELECT page_id AS id, page_id % (SELECT count(*) FROM {{part}}) AS service_id, url AS source_url,
        {pick('page_id', ['OFFICIAL_PORTAL', 'APPLICATION', 'FLYER', 'REFERENCE', 'OTHER'])} AS source_kind,
        CASE WHEN page_id % 4 = 0 THEN '' ELSE 'Link ' || CAST(page_id AS STRING) END AS source_name,
        page_id % 2 = 0 AS is_official, html FROM {{pages}}""",
        ("pages", "part"),
    ),
    "v_rule": (
        f"""SELECT doc_id AS id, doc_id % (SELECT count(*) FROM {{part}}) AS service_id,
        {pick('doc_id', ['REQUIRED', 'OPTIONAL', 'DISQUALIFIER', 'INFORMATION'])} AS rule_type,
        'Applicants need quality ' || CAST(quality AS STRING) AS rule_text, CAST(doc_id % 5 AS BIGINT) AS display_order,
        toxic = 0 AS is_active FROM {{labels}}""",
        ("labels", "part"),
    ),
    "v_search_event": (
        """SELECT event_id AS id, ts AS created_at, CAST(ts AS DATE) AS day, user_id,
        CASE WHEN event_type = 'purchase' THEN 'CLIENT_MATCH' WHEN event_id % 3 = 0 THEN 'FILTER'
             WHEN event_id % 11 = 1 THEN 'SUGGESTION_CLICK' ELSE 'SEARCH' END AS event_type,
        CASE WHEN event_id % 10 = 0 THEN '' ELSE 'term ' || regexp_extract(props, '([0-9]+)', 1) END AS query,
        CASE WHEN value < 50 THEN CAST(0 AS BIGINT) ELSE CAST(floor(value / 10) AS BIGINT) END AS result_count
        FROM {events} WHERE event_type IN ('click', 'purchase')""",
        ("events",),
    ),
    "v_activity": (
        f"""SELECT event_id AS id, ts AS created_at, CAST(ts AS DATE) AS day, user_id,
        CASE event_type
          WHEN 'view' THEN {pick('event_id', ['SERVICE_VIEW', 'SERVICE_VIEW', 'SERVICE_FLYER_PREVIEW', 'SERVICE_VIEW', 'EXTERNAL_LINK_OPEN', 'SERVICE_FLYER_DOWNLOAD'])}
          WHEN 'click' THEN 'SEARCH' WHEN 'purchase' THEN {pick('event_id', ['SERVICE_SAVE', 'SERVICE_UNSAVE', 'COLLECTION_CREATE', 'CLIENT_MATCH', 'COLLECTION_ADD_SERVICE'])}
          WHEN 'signup' THEN {pick('event_id', ['LOGIN', 'LOGOUT', 'IMPORT_UPLOAD', 'LOGIN'])}
          ELSE {pick('event_id', ['LOGIN_FAILED', 'PERMISSION_DENIED', 'LOGIN_FAILED'])} END AS action,
        CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 19 = 0 THEN '' ELSE CAST((event_id * 37) % ((SELECT count(*) FROM {{part}}) + 20) AS STRING) END AS target_id,
        CASE WHEN event_id % 4 = 3 THEN 'Collection' ELSE 'Service' END AS target_type,
        'Event ' || CAST(event_id AS STRING) || ' for key ' || regexp_extract(props, '([0-9]+)', 1) AS description,
        '10.0.' || CAST(user_id % 7 AS STRING) || '.' || CAST(event_id % 50 AS STRING) AS ip_address
        FROM {{events}}""",
        ("events", "part"),
    ),
    "v_user": (
        f"""SELECT DISTINCT user_id AS id, 'user' || CAST(user_id AS STRING) AS username,
        'EMP' || lpad(CAST(user_id AS STRING), 5, '0') AS employee_id,
        {pick('user_id', ['BDE', 'BDE', 'ADMIN', 'BDE', 'DATA_ADMIN'])} AS role, user_id % 6 <> 2 AS is_account_active FROM {{events}}""",
        ("events",),
    ),
    "v_batch": (
        f"""SELECT o_orderkey AS id, o_custkey AS owner_id,
        {pick('o_orderkey', ['XLSX', 'CSV', 'GOOGLE_SHEET'])} AS source_type,
        'Workbook ' || CAST(o_custkey % 400 AS STRING) || '.xlsx' AS source_name,
        @SHA(CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 3 AS STRING)@) AS file_sha256,
        CASE o_orderstatus WHEN 'O' THEN {pick('o_orderkey', ['PREVIEWED', 'VALIDATED'])}
          WHEN 'F' THEN 'IMPORTED' ELSE {pick('o_orderkey', ['ROLLED_BACK', 'FAILED', 'QUEUED'])} END AS status,
        CAST(o_orderkey % 90 AS BIGINT) AS row_count, CAST(o_orderkey % 6 + 1 AS BIGINT) AS sheet_count,
        '{{{{"duplicate_detected": ' || CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END || '}}}}' AS metadata,
        o_orderdate AS created_at FROM {{orders}}""",
        ("orders",),
    ),
    "v_row": (
        f"""SELECT l_orderkey AS batch_id, row_no, l_orderkey * 1000 + row_no AS id, 'Schemes' AS sheet_name,
        CASE l_returnflag WHEN 'A' THEN 'CREATE' WHEN 'N' THEN {pick('l_partkey', ['UPDATE', 'UPDATE', 'MERGE_REVIEW'])} ELSE {pick('l_partkey', ['UPDATE', 'SKIP', 'UNDECIDED', 'INVALID'])} END AS candidate_action,
        CASE l_linestatus WHEN 'O' THEN 'VALID' ELSE {pick('l_partkey', ['WARNING', 'INVALID', 'PROCESSED', 'VALID', 'PENDING'])} END AS validation_status,
        CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_partkey END AS matched_service_id,
        CASE WHEN l_suppkey % 5 = 0 THEN l_partkey ELSE NULL END AS imported_service_id,
        {pick('l_partkey + l_suppkey', ["'APPROVED'", "'PENDING'", "'SKIPPED'", 'CAST(NULL AS STRING)', "'approved'"], quote=False)} AS decision,
        {pick('l_partkey * 3 + l_suppkey', ['SAFE_ADDITION', 'NO_CHANGE', 'NEW_SERVICE', 'CHANGED_INFORMATION', 'CONFLICT'])} AS delta_status,
        l_discount * 10 AS confidence, l_quantity AS quantity, l_shipdate AS reviewed_at
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS row_no FROM {{lineitem}}) l""",
        ("lineitem",),
    ),
    "v_change": (
        f"""SELECT l_orderkey * 1000 + row_no AS id, l_orderkey AS batch_id, row_no, 'service' AS object_model, l_partkey AS object_pk,
        {pick('l_suppkey', ['CREATE', 'UPDATE', 'UPDATE'])} AS action, l_discount > 0.05 AS is_reversed,
        CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'q' || CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS before_text,
        'd' || CAST(CAST(l_extendedprice AS BIGINT) AS STRING) AS after_text, l_shipdate AS created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS row_no FROM {{lineitem}}) l""",
        ("lineitem",),
    ),
    "v_flyer": (
        """SELECT l_partkey AS service_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS version,
        @SHA(CAST(l_suppkey AS STRING) || '/' || CAST(CAST(l_quantity AS BIGINT) AS STRING)@) AS sha256,
        l_orderkey AS upload_id FROM {lineitem} WHERE l_linestatus = 'O'""",
        ("lineitem",),
    ),
    "v_saved": (
        """SELECT user_id, service_id, min(event_id) AS id, max(ts) AS saved_at FROM (
        SELECT user_id, (event_id * 37) % (SELECT count(*) FROM {part}) AS service_id, event_id, ts FROM {events} WHERE event_type = 'purchase' AND event_id % 4 <> 2) s
        GROUP BY user_id, service_id""",
        ("events", "part"),
    ),
    "v_collection": (
        """SELECT DISTINCT user_id * 10 + event_id % 3 AS id, user_id, 'Client ' || CAST(event_id % 3 AS STRING) AS name FROM {events}""",
        ("events",),
    ),
    "v_collection_item": (
        """SELECT user_id * 10 + event_id % 2 AS collection_id, user_id, (event_id * 37) % (SELECT count(*) FROM {part}) AS service_id, max(ts) AS added_at
        FROM {events} WHERE event_type = 'purchase' AND event_id % 4 = 1 GROUP BY 1, 2, 3""",
        ("events", "part"),
    ),
}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dialect(sql: str, spark_side: bool) -> str:
    sql = sql.replace("@TODAY", TODAY)
    pairs = (
        [("@ARRAY(", "array("), ("@STRARRAY", "ARRAY<STRING>"), ("@SHA(", "sha2("), ("@)", ", 256)")]
        if spark_side
        else [("@ARRAY(", "list_value("), ("@STRARRAY", "VARCHAR[]"), ("@SHA(", "sha256("), ("@)", ")")]
    )
    for mark, text in pairs:
        sql = sql.replace(mark, text)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame for one derived view."""
    sql, tables = VIEW_SQL[name]
    read = {t: table(spark, sf_dir, t) for t in tables}
    if name == "v_sheet":
        # the row numbers of its SQL, block by block: a sheet holds the texts of a whole source
        rows = spark.sql(_dialect(SHEET_ROWS, True), **read)
        block = F.struct("ord", F.floor(F.col("id") / SHEET_IDS))
        numbered = group_row_number(rows, ["sheet"], block, ["ord", "id", "sub"], "row_no")
        return numbered.select(F.lit("catalogue").alias("file"), "sheet", F.col("row_no").cast("int").alias("row_no"), F.col("vals").alias("values"), F.col("urls").alias("links"))
    return spark.sql(_dialect(sql, True), **read)


@lru_cache(maxsize=None)
def oracle_view(name: str) -> str:
    """The same view as a SELECT for the SQL oracle."""
    sql, tables = VIEW_SQL[name]
    return _dialect(sql, False).format(**{t: t for t in tables})


def with_views(names: str, body: str) -> str:
    """``WITH`` clause over the named views, followed by ``body`` (SELECT or more CTEs)."""
    parts = ", ".join(f"{n} AS ({oracle_view(n)})" for n in names.split())
    body = body.replace("@TODAY", TODAY).strip()
    if not parts:
        return body
    if body.startswith(","):
        return f"WITH {parts}{body}"
    if body.upper().startswith("WITH "):
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"
