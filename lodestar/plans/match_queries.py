"""Matching and eligibility operators bound to the catalogue views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import eligibility as el
from ..functions.wordlists import GENERIC_WILDCARDS, STATE_WILDCARDS
from ..operators import catalogue as cat
from ..operators import match as ma
from ..operators import search as se
from ..session import materialize
from . import search_queries as sq
from .catalogue_queries import PITCHABLE
from .registry import Registry
from .views import TODAY, table

RULES = [c for _, c, *_ in ma.CATEGORICAL] + ["min_business_age_months", "max_business_age_months", "min_turnover", "max_turnover", "application_deadline"]


def _list_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _cat_sql(client: str, allowed: str, extra=()) -> str:
    names = f"list_transform(list_filter(list_transform(s.{allowed}, lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '\\s+', ' ', 'g'))"
    return f"""CASE WHEN s.{allowed} IS NULL OR len({names}) = 0 THEN NULL WHEN coalesce(c.{client}, '') = '' THEN 'unknown'
      WHEN list_has_any({names}, {_list_sql((*GENERIC_WILDCARDS, *extra))}) THEN 'match' WHEN list_contains({names}, trim(regexp_replace(lower(c.{client}), '\\s+', ' ', 'g'))) THEN 'match' ELSE 'mismatch' END"""


def _range_sql(value: str, low: str, high: str) -> str:
    return f"CASE WHEN s.{low} IS NULL AND s.{high} IS NULL THEN NULL WHEN c.{value} IS NULL THEN 'unknown' WHEN c.{value} < s.{low} OR c.{value} > s.{high} THEN 'mismatch' ELSE 'match' END"


CHECKS = ", ".join(
    [_cat_sql(c, a, x) for c, a, _, x in ma.CATEGORICAL]
    + [_range_sql("business_age_months", "min_business_age_months", "max_business_age_months"), _range_sql("annual_turnover", "min_turnover", "max_turnover"),
       "CASE WHEN s.application_deadline < DATE '@TODAY' THEN 'mismatch' END"]
)
COUNTS = """CAST(len(list_filter(k, lambda x: x = 'match')) AS BIGINT) AS matched_count, CAST(len(list_filter(k, lambda x: x = 'mismatch')) AS BIGINT) AS mismatch_count, CAST(len(list_filter(k, lambda x: x = 'unknown')) AS BIGINT) AS unknown_count"""
VERDICT = "CASE WHEN mismatch_count > 0 THEN 'NOT_ELIGIBLE' WHEN matched_count > 0 AND unknown_count = 0 THEN 'HIGH' ELSE 'POSSIBLE' END"
ORDER = """CASE WHEN classification = 'NOT_ELIGIBLE' THEN mismatch_count ELSE -matched_count END, CASE WHEN classification = 'NOT_ELIGIBLE' THEN -matched_count ELSE unknown_count END, -relevance,
  CASE WHEN classification = 'NOT_ELIGIBLE' THEN 0 ELSE CASE priority WHEN 'CRITICAL' THEN -4 WHEN 'HIGH' THEN -3 WHEN 'NORMAL' THEN -2 WHEN 'LOW' THEN -1 ELSE 0 END END, lower(title), service_id"""


def bought_pairs(v):
    """(client, service) pairs a client has dealt with."""
    o = table(v.spark, v.sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("client_id"))
    li = table(v.spark, v.sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("service_id"))
    keys = o.join(li, "o_orderkey").select("client_id", "service_id").distinct()
    svc = ma.prepare_services(v.service.drop("service_id").withColumnRenamed("id", "service_id").select("service_id", "title", "priority", *RULES))
    return keys.join(ma.prepare_clients(v.client), "client_id").join(svc, "service_id")


def register(reg: Registry) -> None:
    pairs = f"""pr AS (SELECT DISTINCT o_custkey AS client_id, l_partkey AS service_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
      ck AS (SELECT c.client_id, s.id AS service_id, s.title, s.priority, [{CHECKS}] AS k FROM pr JOIN v_client c ON c.client_id = pr.client_id JOIN v_service s ON s.id = pr.service_id),
      ct AS (SELECT *, {COUNTS} FROM ck)"""

    @reg.add("E5_verdicts", "v_client v_service", f"WITH {pairs} SELECT client_id, service_id, {VERDICT} AS classification, matched_count, mismatch_count, unknown_count, matched_count + mismatch_count + unknown_count AS criteria_count FROM ct")
    def _(v):
        return ma.evaluate(bought_pairs(v), TODAY).select("client_id", "service_id", "classification", "matched_count", "mismatch_count", "unknown_count", "criteria_count")

    singles = [("E1_business_type", 0, lambda: ma.categorical_check(*ma.CATEGORICAL[0])), ("E1_industry", 2, lambda: ma.categorical_check(*ma.CATEGORICAL[2])), ("E1_state", 3, lambda: ma.categorical_check(*ma.CATEGORICAL[3])),
               ("E2_age_range", 5, lambda: ma.range_check("business_age_months", "min_business_age_months", "max_business_age_months", "Business age")),
               ("E3_turnover_range", 6, lambda: ma.range_check("annual_turnover", "min_turnover", "max_turnover", "Turnover")), ("E4_deadline", 7, lambda: ma.deadline_check(TODAY))]
    for key, pos, check in singles:
        def single(v, check=check):
            return bought_pairs(v).withColumn("c", check()).select("client_id", "service_id", F.col("c.state").alias("state")).where("state IS NOT NULL")

        reg.add(key, "v_client v_service", f"WITH {pairs} SELECT client_id, service_id, k[{pos + 1}] AS state FROM ck WHERE k[{pos + 1}] IS NOT NULL")(single)

    @reg.add("J7_theta_match", "v_client v_service", f""", ck AS (SELECT c.client_id, s.id AS service_id, [{CHECKS}] AS k FROM v_client c, v_service s WHERE {PITCHABLE}), ct AS (SELECT *, {COUNTS} FROM ck)
      SELECT client_id, {VERDICT} AS classification, count(*) AS bucket_count FROM ct GROUP BY 1, 2""")
    def _(v):
        rows = ma.match_all(v.client, v.service, TODAY, k=1)
        return rows.select("client_id", "classification", "bucket_count")

    @reg.add("E7_ranked_buckets", "v_client v_service", f""", ck AS (SELECT c.client_id, s.id AS service_id, s.title, s.priority, [{CHECKS}] AS k, 0 AS relevance FROM v_client c, v_service s WHERE {PITCHABLE}),
      ct AS (SELECT *, {COUNTS} FROM ck), cl AS (SELECT *, {VERDICT} AS classification FROM ct), rk AS (SELECT *, row_number() OVER (PARTITION BY client_id, classification ORDER BY {ORDER}) AS rank, count(*) OVER (PARTITION BY client_id, classification) AS bucket_count FROM cl)
      SELECT client_id, classification, service_id, rank, bucket_count, matched_count, mismatch_count, unknown_count FROM rk WHERE rank <= 50""")
    def _(v):
        return ma.match_all(v.client, v.service, TODAY).select(
            "client_id", "classification", "service_id", F.col("rank").cast("bigint").alias("rank"), "bucket_count", "matched_count", "mismatch_count", "unknown_count")

    needs = sq.GROUPS.replace("FROM v_query", "FROM v_need"), sq.TEXTS.replace("v_query", "v_need")

    @reg.add("E6_need_gate", sq.VIEWS + " v_client", f"""WITH v_need AS (SELECT DISTINCT need_query AS query FROM v_client WHERE need_query <> ''), {needs[0]}, {needs[1]}, {sq.NATURAL}, {sq.SCORES}, {sq.FOUND.replace('v_query', 'v_need')},
      al AS (SELECT fd.query, cv.*, coalesce(rk.score, 0) + {sq.BOOST.replace('query', 'fd.query').replace('title', 'cv.title')} AS relevance FROM fd JOIN cv ON cv.id = fd.service_id LEFT JOIN rk ON rk.query = fd.query AND rk.service_id = fd.service_id),
      ck AS (SELECT c.client_id, s.id AS service_id, s.title, s.priority, s.relevance, [{CHECKS}] AS k FROM v_client c JOIN al s ON s.query = c.need_query WHERE {PITCHABLE}),
      ct AS (SELECT *, {COUNTS} FROM ck), cl AS (SELECT *, {VERDICT} AS classification FROM ct), rn AS (SELECT *, row_number() OVER (PARTITION BY client_id, classification ORDER BY {ORDER}) AS rank, count(*) OVER (PARTITION BY client_id, classification) AS bucket_count FROM cl)
      SELECT client_id, classification, service_id, rank, relevance, bucket_count FROM rn WHERE rank <= 50""")
    def _(v):
        services = sq.catalogue(v)
        queries = v.client.where("need_query <> ''").select(F.col("need_query").alias("query")).distinct()
        found = se.search_candidates(queries, services, sq.texts(v))
        titles = services.select(F.col("id").alias("service_id"), F.col("title").alias("t"))
        scored = materialize(found.join(titles, "service_id").select("query", "service_id", (F.col("score") + se.title_boost("query", "t")).alias("score")))
        return ma.match_need(v.client, services, scored, TODAY).select(
            "client_id", "classification", "service_id", F.col("rank").cast("bigint").alias("rank"), F.col("relevance").cast("bigint").alias("relevance"), "bucket_count")

    @reg.add("T4_bucket_order", "v_client v_service", f"WITH {pairs}, cl AS (SELECT *, {VERDICT} AS classification, 0 AS relevance FROM ct), rk AS (SELECT *, row_number() OVER (PARTITION BY client_id, classification ORDER BY {ORDER}) AS rank, count(*) OVER (PARTITION BY client_id, classification) AS bucket_count FROM cl) SELECT client_id, classification, service_id, rank, bucket_count FROM rk WHERE rank <= 5")
    def _(v):
        rows = ma.evaluate(bought_pairs(v), TODAY).withColumn("relevance", F.lit(0))
        return ma.rank_buckets(rows, ["client_id"], 5).select("client_id", "classification", "service_id", F.col("rank").cast("bigint").alias("rank"), "bucket_count")

    # --- extraction -----------------------------------------------------------------------
    def labels_sql(rules, body="body") -> str:
        arms = ", ".join(f"CASE WHEN regexp_matches({body}, '{'|'.join(p)}') THEN '{label}' END" for label, p in rules)
        return f"list_filter([{arms}], lambda x: x IS NOT NULL)"

    clean = "trim(regexp_replace(regexp_replace(lower(regexp_replace({}, '<[^>]+>', ' ', 'g')), '[–—]', '-', 'g'), '\\s+', ' ', 'g'))"
    named = labels_sql(el.STATES)
    rest = f"regexp_replace(body, '{el.LLP_WORDS}', ' ', 'g')"

    def agg(expr: str) -> str:
        return f"array_to_string(list_sort(list_distinct(flatten(list({expr})))), '; ')"

    age = "coalesce(" + ", ".join(f"nullif(regexp_extract(body, '{p}', 1), '')" for p in el.AGE_YEARS) + ")"
    turn = "coalesce(" + ", ".join(
        f"TRY_CAST(nullif(regexp_extract(body, '{p}', 1), '') AS DECIMAL(16,2)) * CASE WHEN regexp_extract(body, '{p}', 2) LIKE 'cr%' THEN 100 ELSE 1 END" for p in el.TURNOVER) + ")"
    def rule_of(patterns) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches(body, '{p}') THEN {i}" for i, p in enumerate(patterns)) + " END"

    bodies = f"""bd AS (SELECT id, title, {clean.format("concat_ws(' ', eligibility_summary, applicable_for_raw, restrictions, important_notes)")} AS body, -1 AS pos FROM v_service
       UNION ALL SELECT s.id, s.title, {clean.format('x.content')}, x.id FROM v_section x JOIN v_service s ON s.id = x.service_id WHERE x.visibility = 'BDE' AND x.section_type = 'ELIGIBILITY'),
      fx AS (SELECT id, list_concat({labels_sql(el.BUSINESS_TYPES)}, {labels_sql((el.PARTNERSHIP,), rest)}) AS bt, {labels_sql(el.BUSINESS_STAGES)} AS bs, {labels_sql(el.INDUSTRIES)} AS ind,
        CASE WHEN regexp_matches(body, '{el.PAN_INDIA}') THEN ['Pan India'] ELSE {named} END AS st, list_concat(CASE WHEN regexp_matches(lower(title), '{el.WOMEN}') AND regexp_matches(body, '{el.WOMEN}') THEN ['Women'] ELSE [] END, {labels_sql(el.FOUNDERS)}) AS fo,
        CAST({age} AS BIGINT) * 12 AS age, {rule_of(el.AGE_YEARS)} * CAST(1000000000 AS BIGINT) + pos AS age_at, {turn} AS turn, {rule_of(el.TURNOVER)} * CAST(1000000000 AS BIGINT) + pos AS turn_at FROM bd),
      ex AS (SELECT id, list_sort(list_distinct(flatten(list(bt)))) AS bt, list_sort(list_distinct(flatten(list(bs)))) AS bs, list_sort(list_distinct(flatten(list(ind)))) AS ind,
        CASE WHEN list_contains(flatten(list(st)), 'Pan India') THEN ['Pan India'] ELSE list_sort(list_distinct(flatten(list(st)))) END AS st, list_sort(list_distinct(flatten(list(fo)))) AS fo, arg_min(age, age_at) AS age, arg_min(turn, turn_at) AS turn FROM fx GROUP BY id)"""

    @reg.add("E8_extract_eligibility", "v_service v_section", f"""WITH {bodies} SELECT id, array_to_string(bt, '; ') AS business_types, array_to_string(bs, '; ') AS stages, array_to_string(ind, '; ') AS industries, array_to_string(st, '; ') AS states, array_to_string(fo, '; ') AS founders,
       age AS max_age, CAST(turn AS DOUBLE) AS max_turnover FROM ex""")
    def _(v):
        e = ma.extract_eligibility(v.service, v.section)
        j = {"business_types": "business_types", "stages": "business_stages", "industries": "industries", "states": "applicable_states", "founders": "founder_categories"}
        return e.select("id", *[F.array_join(c, "; ").alias(n) for n, c in j.items()], F.col("max_business_age_months").cast("bigint").alias("max_age"), F.col("max_turnover").cast("double").alias("max_turnover"))

    def empty(col: str) -> str:
        return f"len(list_filter(coalesce(s.{col}, []), lambda x: trim(x) <> '')) = 0"

    pairs9 = [("business_types", "bt"), ("business_stages", "bs"), ("industries", "ind"), ("applicable_states", "st"), ("founder_categories", "fo")]
    changed = ", ".join([f"CASE WHEN {empty(c)} AND len(e.{p}) > 0 THEN '{c}' END" for c, p in pairs9] + [
        "CASE WHEN s.max_business_age_months IS NULL AND e.age IS NOT NULL THEN 'max_business_age_months' END", "CASE WHEN s.max_turnover IS NULL AND e.turn IS NOT NULL THEN 'max_turnover' END"])

    @reg.add("E9_fill_empty", "v_service v_section", f"WITH {bodies} SELECT s.id, CAST(coalesce(s.max_business_age_months, e.age) AS BIGINT) AS max_age, array_to_string(list_filter([{changed}], lambda x: x IS NOT NULL), ',') AS changed FROM v_service s JOIN ex e ON e.id = s.id")
    def _(v):
        f = ma.fill_empty(v.service, ma.extract_eligibility(v.service, v.section))
        return f.select("id", F.col("max_business_age_months").cast("bigint").alias("max_age"), F.array_join("changed_fields", ",").alias("changed"))
