"""Ingestion and entity resolution bound to sheet rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sheet_terms as st
from ..functions import text
from ..functions import titles as tt
from ..functions import urls
from ..operators import ingest as ing
from ..operators import knowledge as kn
from ..operators import resolve as rs
from ..session import materialize, scratch_dir
from ..sources import files as fs
from .registry import Registry
from .views import view

NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _any(body: str, words) -> str:
    return "(" + " OR ".join(f"contains({body}, '{w}')" for w in words) + ")"


def _field_sql(expr: str) -> str:
    n = NORM.format(expr)
    arms = []
    for field, aliases in st.HEADER_ALIASES.items():
        test = f"{n} IN ({', '.join(repr(a) for a in aliases)})"
        long = [a for a in aliases if len(a) >= st.CONTAINED_ALIAS]
        arms.append(f"WHEN {test}" + (f" OR {_any(n, long)}" if long else "") + f" THEN '{field}'")
    return "CASE " + " ".join(arms) + " END"


def _section_sql(expr: str) -> str:
    n = NORM.format(expr)
    return "CASE " + " ".join(f"WHEN {_any(n, m)} THEN '{s}'" for s, m in st.SECTION_MARKERS) + " END"


def _heading_sql(e: str) -> str:
    return f"""({e} <> '' AND ((starts_with({e}, '*') AND ends_with({e}, '*')) OR (length({e}) <= 110 AND {_section_sql(e)} IS NOT NULL) OR (length({e}) <= 90 AND (ends_with({e}, ':') OR {NORM.format(e)} IN ('benefits','commercials','timeline')))))"""


def _canon_sql(expr: str) -> str:
    out = NORM.format(expr)
    for pattern, new in tt.TITLE_REWRITES:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


HEAD = f"""fl AS (SELECT file, sheet, row_no, values, list_transform(values, lambda x: {_field_sql('x')}) AS fields, len(list_filter(values, lambda x: {NORM.format('x')} <> '')) AS nonempty FROM v_sheet),
 sc AS (SELECT *, list_distinct(list_filter(fields, lambda f: f IS NOT NULL)) AS found FROM fl),
 bs AS (SELECT *, len(found) * 10 + least(nonempty, 10) AS score FROM sc WHERE len(found) > 0),
 hr AS (SELECT file, sheet, row_no AS header_row, nonempty, score, fields, found FROM (SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY score DESC, row_no) AS k FROM bs) WHERE k = 1)"""


def service_titles(v):
    return v.service.select("id", "title")


def category_slugs(v):
    """The fixed category slugs, as many as the nation table has rows."""
    names = [s for s, _, _ in st.CATEGORY_MARKERS] + [st.FALLBACK_CATEGORY]
    return v.category.where(F.col("id") < len(names)).select(F.get(F.array(*[F.lit(n) for n in names]), F.col("id").cast("int")).alias("slug"))


def incoming_titles(v):
    """Altered catalogue titles: suffix, swapped words, lost letter, abbreviation, unrelated."""
    t, i = F.col("title"), F.col("id")
    words = F.split(t, " ")
    kind = i % 6
    altered = (
        F.when(kind == 0, t)
        .when(kind == 1, F.concat(t, F.lit(" india")))
        .when(kind == 2, F.array_join(F.reverse(words), " "))
        .when(kind == 3, F.expr("substring(title, 1, length(title) - 1)"))
        .when(kind == 4, F.concat(F.upper(t), F.lit(" Pvt Ltd")))
        .otherwise(F.concat(F.lit("unrelated matter "), i.cast("string")))
    )
    return v.service.select("id", altered.alias("title"))


def register(reg: Registry) -> None:
    @reg.add("I1_header_fields", "v_sheet", f"SELECT DISTINCT x AS header, {_field_sql('x')} AS field FROM (SELECT unnest(values) AS x FROM v_sheet)")
    def _(v):
        cells = v.sheet.select(F.explode("values").alias("header")).distinct()
        return cells.select("header", ing.header_field("header").alias("field"))

    for key in ("I2_header_detection", "W8_header_argmax"):
        reg.add(key, "v_sheet", f"WITH {HEAD} SELECT file, sheet, CAST(header_row AS BIGINT) AS header_row, CAST(score AS BIGINT) AS score, CAST(len(found) AS BIGINT) AS fields FROM hr")(
            lambda v: ing.detect_headers(v.sheet).select("file", "sheet", F.col("header_row").cast("bigint").alias("header_row"), F.col("score").cast("bigint").alias("score"), F.size("mapping").cast("bigint").alias("fields")))

    @reg.add("I3_sheet_kinds")
    def _(v):
        return ing.sheet_kinds(v.sheet, ing.detect_headers(v.sheet)).select("sheet", "kind", "header_row", "n_rows")

    @reg.add("I4_suspicious_headers")
    def _(v):
        kinds = materialize(ing.sheet_kinds(v.sheet, ing.detect_headers(v.sheet)))
        return ing.suspicious_headers(kinds, v.sheet, service_titles(v))

    @reg.add("I5_structured_candidates")
    def _(v):
        kinds = ing.sheet_kinds(v.sheet, ing.detect_headers(v.sheet)).where("kind IN ('STRUCTURED_TABLE', 'COMMERCIAL_SERVICE_TABLE')")
        c = ing.structured_candidates(v.sheet, materialize(kinds), service_titles(v), ing.available_slugs(category_slugs(v)))
        return c.select("sheet", "source_row", "title", F.size("fields").alias("n_fields"), F.size("links").alias("n_links"), "proposal.category_slug", "match.action", "match.matched_service_id")

    @reg.add("I6_headerless_candidates")
    def _(v):
        kinds = materialize(ing.sheet_kinds(v.sheet, ing.detect_headers(v.sheet)))
        rows = v.sheet.join(ing.suspicious_headers(kinds, v.sheet, service_titles(v)), ["file", "sheet"], "left_semi")
        c = ing.headerless_candidates(rows, service_titles(v), ing.available_slugs(category_slugs(v)))
        return c.select("sheet", "source_row", "title", F.to_json("fields").alias("fields"), "proposal.category_slug", "match.action")

    scores = {
        "financial": (lambda x: " + ".join(f"CASE WHEN contains(lower({x}), '{m}') THEN 2 ELSE 0 END" for m in st.FINANCIAL_MARKERS) + f" + CASE WHEN contains({x}, '%') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower({x}), '\\b\\d+\\s*(?:lakh|crore)\\b') THEN 3 ELSE 0 END"),
        "eligible": (lambda x: " + ".join(f"CASE WHEN contains({NORM.format(x)}, '{m}') THEN 2 ELSE 0 END" for m in st.ELIGIBILITY_MARKERS)),
        "sector_score": (lambda x: " + ".join(f"CASE WHEN contains({NORM.format(x)}, '{m}') THEN 2 ELSE 0 END" for m in st.SECTOR_MARKERS) + f" + CASE WHEN {NORM.format(x)} <> '' AND length({x}) - length(replace({x}, chr(10), '')) >= 2 THEN 2 ELSE 0 END"),
    }

    @reg.add("I7_content_scores", "v_section", "SELECT id, " + ", ".join(f"CAST({f('content')} AS BIGINT) AS {n}" for n, f in scores.items()) + " FROM v_section")
    def _(v):
        got = v.section.select("id", *ing.content_scores("content"))
        return got.select("id", *[F.col(c).cast("bigint").alias(c) for c in scores])

    story = f"""ce AS (SELECT sheet, row_no, unnest(values) AS content, generate_subscripts(values, 1) AS col FROM v_sheet WHERE sheet LIKE 'Story%'),
      cl AS (SELECT sheet, row_no, col, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content FROM ce WHERE trim(content) <> ''),
      ty AS (SELECT *, {_heading_sql('content')} AS is_heading, CASE WHEN {_heading_sql('content')} THEN {_section_sql('content')} END AS own FROM cl WHERE content <> '')"""
    for key in ("W1_section_carry_forward", "I9_section_types"):
        reg.add(key, "v_sheet", f"WITH {story} SELECT sheet, row_no AS source_row, col AS source_column, is_heading, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no, col ROWS UNBOUNDED PRECEDING), 'OTHER') AS section_type FROM ty")(
            lambda v: ing.narrative_sections(v.sheet.where("sheet LIKE 'Story%'"), 16).select("sheet", "source_row", "source_column", "is_heading", "section_type"))

    @reg.add("I8_narrative_candidates")
    def _(v):
        sections = materialize(ing.narrative_sections(v.sheet.where("sheet LIKE 'Story%'")))
        c = ing.narrative_candidates(sections, service_titles(v), ing.available_slugs(category_slugs(v)))
        return c.select("sheet", "title", "source_title_hint", "proposal.category_slug", "match.action", "match.method")

    rules = "CASE " + " ".join(f"WHEN {_any(NORM.format('body'), m)} THEN {i}" for i, (_, _, m) in enumerate(st.CATEGORY_MARKERS)) + " ELSE -1 END"
    slugs = "CASE " + rules + " " + " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _, _) in enumerate(st.CATEGORY_MARKERS)) + f" ELSE '{st.FALLBACK_CATEGORY}' END"
    kinds = "CASE " + rules + " " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k, _) in enumerate(st.CATEGORY_MARKERS)) + " ELSE 'OTHER' END"

    @reg.add("I10_category_proposal", "v_service", f"SELECT id, {slugs} AS category_slug, {kinds} AS service_kind, CASE WHEN {rules} >= 0 THEN 0.85 ELSE 0.35 END AS confidence FROM (SELECT id, concat_ws(' ', title, benefits, eligibility_summary) AS body FROM v_service)")
    def _(v):
        available = ing.available_slugs(category_slugs(v))
        body = v.service.select("id", F.concat_ws(" ", "title", "benefits", "eligibility_summary").alias("body"))
        p = body.withColumn("p", ing.proposal(ing.category_rule("body", available), available))
        return p.select("id", "p.category_slug", "p.service_kind", "p.confidence")

    @reg.add("I11_canonical_title", "v_service", f"SELECT id, {_canon_sql(chr(39) + 'Start-up 80 IAC Govt. ' + chr(39) + ' || eligibility_summary || title')} AS canonical FROM v_service")
    def _(v):
        return v.service.select("id", tt.canonical_title(F.concat(F.lit("Start-up 80 IAC Govt. "), "eligibility_summary", "title")).alias("canonical"))

    generic = "[" + ", ".join(f"'{w}'" for w in sorted(tt.GENERIC_TITLE_WORDS)) + "]"
    for key in ("U5_title_token_sets", "I12_title_metrics"):
        reg.add(key, "v_service", f""", p AS (SELECT s.id, list_distinct(string_split({_canon_sql('s.title')}, ' ')) AS a, list_distinct(string_split({_canon_sql('t.title')}, ' ')) AS b FROM v_service s JOIN v_service t ON t.id = s.id + 1)
          SELECT id, round(len(list_intersect(a, b)) / least(len(a), len(b)), 4) AS containment, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) AS jaccard, CAST(len(list_filter(list_intersect(a, b), lambda x: NOT list_contains({generic}, x))) AS BIGINT) AS distinctive_shared FROM p""")(
            lambda v: rs.title_metrics(v.service.select("id", F.col("title").alias("left")).join(v.service.select((F.col("id") - 1).alias("id"), F.col("title").alias("right")), "id")).drop("left", "right"))

    @reg.add("I12_sequence_ratio")
    def _(v):
        a = v.service.select("id", tt.canonical_title("title").alias("a"))
        b = incoming_titles(v).select("id", tt.canonical_title("title").alias("b"))
        return a.join(b, "id").select("id", F.round(rs.sequence_ratio_udf("b", "a"), 4).alias("ratio"))

    @reg.add("I13_match_decision", "v_row", """SELECT id, CASE WHEN s >= 0.9 OR (s >= 0.82 AND sh >= 2) THEN 'UPDATE' WHEN s >= 0.72 THEN 'MERGE_REVIEW' ELSE 'CREATE' END AS action,
      CASE WHEN (s >= 0.9 OR (s >= 0.82 AND sh >= 2)) AND an THEN 'BUSINESS_IDENTITY_MATCH' WHEN s >= 0.9 OR (s >= 0.82 AND sh >= 2) THEN 'STRONG_TITLE_MATCH' WHEN s >= 0.72 THEN 'POSSIBLE_EXISTING_SERVICE' ELSE 'NO_SAFE_EXISTING_MATCH' END AS method
      FROM (SELECT id, round(0.5 + quantity / 100, 2) AS s, row_no % 4 AS sh, row_no % 3 = 0 AS an FROM v_row)""")
    def _(v):
        r = v.row.select("id", F.round(0.5 + F.col("quantity") / 100, 2).alias("s"), (F.col("row_no") % 4).alias("sh"), (F.col("row_no") % 3 == 0).alias("an"))
        d = r.withColumn("d", tt.decide(F.lit(False), F.col("s"), F.col("sh"), F.col("an"), F.lit(False)))
        return d.select("id", "d.action", "d.method")

    for key in ("J8_entity_resolution", "W7_best_match"):
        reg.add(key)(lambda v: rs.resolve_titles(incoming_titles(v), service_titles(v)))

    @reg.add("J8_exact_titles", "v_service", f""", k AS (SELECT {_canon_sql('title')} AS c, min(title || '#' || lpad(CAST(id AS VARCHAR), 12, '0')) AS m FROM v_service GROUP BY 1)
      SELECT DISTINCT s.title, CAST(split_part(k.m, '#', 2) AS BIGINT) AS matched_service_id FROM v_service s JOIN k ON k.c = {_canon_sql('s.title')}""")
    def _(v):
        r = rs.resolve_titles(v.service.select("title"), service_titles(v))
        return r.where("method = 'EXACT_NORMALIZED_TITLE'").select("title", "matched_service_id")

    @reg.add("I14_staging_status", "v_row", """SELECT id, CASE WHEN stale THEN 'MERGE_REVIEW' ELSE candidate_action END AS new_action, CASE WHEN stale OR candidate_action = 'MERGE_REVIEW' THEN 'WARNING' WHEN candidate_action = 'INVALID' THEN 'INVALID' ELSE 'VALID' END AS status
       FROM (SELECT *, coalesce(matched_service_id % 7 = 0, false) AS stale FROM v_row)""")
    def _(v):
        stale = F.coalesce(F.col("matched_service_id") % 7 == 0, F.lit(False))
        a, s = ing.staging_status(F.col("candidate_action"), stale)
        return v.row.select("id", a.alias("new_action"), s.alias("status"))

    key_sql = "CASE WHEN k = '' OR regexp_matches(k, 'vendor|bdm|deduction|internal|escalation|commercial|commission|margin|employee|password') THEN NULL "
    from ..functions.wordlists import KEY_SECTION_MARKERS, DISQUALIFIER_MARKERS, REQUIRED_MARKERS, MANDATORY_DOCUMENT_MARKERS
    key_sql += " ".join(f"WHEN {_any('k', m)} THEN '{s}'" for s, m in KEY_SECTION_MARKERS) + " END"

    @reg.add("I15_key_section_types", "v_sheet", f"SELECT DISTINCT x AS key, {key_sql} AS section_type FROM (SELECT x, trim(regexp_replace(regexp_replace(lower(x), '[_\\-/]+', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM (SELECT unnest(values) AS x FROM v_sheet WHERE sheet NOT LIKE 'Story%'))")
    def _(v):
        cells = v.sheet.where("sheet NOT LIKE 'Story%'").select(F.explode("values").alias("key")).distinct()
        return cells.select("key", kn.key_section_type("key").alias("section_type"))

    body = "trim(regexp_replace(lower(concat_ws(' ', eligibility_summary, bde_summary, restrictions)), '\\s+', ' ', 'g'))"

    @reg.add("I18_rule_types", "v_service", f"SELECT id, CASE WHEN {_any('b', DISQUALIFIER_MARKERS)} THEN 'DISQUALIFIER' WHEN {_any('b', REQUIRED_MARKERS)} THEN 'REQUIRED' WHEN contains(b, 'optional') THEN 'OPTIONAL' ELSE 'INFORMATION' END AS rule_type, {_any('b', MANDATORY_DOCUMENT_MARKERS)} AS documents FROM (SELECT id, {body} AS b FROM v_service)")
    def _(v):
        b = v.service.select("id", F.concat_ws(" ", "eligibility_summary", "bde_summary", "restrictions").alias("b"))
        return b.select("id", kn.rule_type("b").alias("rule_type"), kn.documents_required("b", F.lit("")).alias("documents"))

    # --- files --------------------------------------------------------------------------------
    @reg.add("S3_csv_ingest", "v_service", "SELECT id || '' AS id, title, overview FROM v_service")
    def _(v):
        path = f"{scratch_dir(v.spark)}/csv-{id(v)}-{v.spark.sparkContext.startTime}"
        v.service.select(F.col("id").cast("string").alias("id"), "title", "overview").write.mode("overwrite").option("sep", ";").option("quoteAll", "true").csv(path)
        rows = fs.sheet_rows(fs.binary_files(v.spark, path, "*.csv"))
        return rows.select(F.get("values", F.lit(0)).alias("id"), F.get("values", F.lit(1)).alias("title"), F.get("values", F.lit(2)).alias("overview"))

    @reg.add("S4_preview", "v_sheet", """SELECT sheet, row_no, array_to_string(values[1:30], '|') AS cells, total_rows, width FROM (SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY row_no) AS rn, count(*) OVER (PARTITION BY file, sheet) AS total_rows, max(len(values)) OVER (PARTITION BY file, sheet) AS width FROM v_sheet) WHERE rn <= 8""")
    def _(v):
        return ing.preview(v.sheet).select("sheet", "row_no", F.array_join("values", "|").alias("cells"), "total_rows", "width")

    @reg.add("S6_fingerprints", "v_section", "SELECT id, sha256(content) AS sha256 FROM v_section")
    def _(v):
        return v.section.select("id", F.sha2("content", 256).alias("sha256"))

    @reg.add("S7_row_fingerprint", "v_rule", "SELECT id, sha256('{\"display_order\":' || display_order || ',\"rule_text\":\"' || rule_text || '\",\"rule_type\":\"' || rule_type || '\"}') AS row_hash FROM v_rule")
    def _(v):
        return v.rule.select("id", text.row_fingerprint("rule_type", "rule_text", "display_order").alias("row_hash"))

    @reg.add("S8_stage_rows")
    def _(v):
        found = ing.analyse(v.sheet, service_titles(v), category_slugs(v))
        staged = ing.stage_rows(v.sheet, materialize(found["candidates"]), v.service, 1)
        return staged.select("sheet", "row_no", "source_key", "row_hash", "candidate_action", "validation_status", "matched_service_id")

    @reg.add("S9_analyse_source")
    def _(v):
        return ing.action_counts(ing.analyse(v.sheet, service_titles(v), category_slugs(v))["candidates"])

    @reg.add("S11_census", "v_sheet", """SELECT file, sheet, count(*) AS n_rows, CAST(sum(len(list_filter(values, lambda x: trim(x) <> ''))) AS BIGINT) AS cells, CAST(sum(len(list_filter(links, lambda x: x <> ''))) AS BIGINT) AS links,
      CAST(sum(len(list_filter(values, lambda x: starts_with(x, '=')))) AS BIGINT) AS formulas FROM v_sheet GROUP BY ROLLUP (file, sheet)""")
    def _(v):
        return ing.census(v.sheet)

    # --- URLs and lists --------------------------------------------------------------------------
    @reg.add("X12_normalize_url", "v_source", """SELECT id, lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || lower(regexp_replace(regexp_extract(source_url, '^[a-zA-Z]+://([^/?#]*)', 1), '^.*@', ''))
       || regexp_replace(regexp_extract(source_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN regexp_extract(source_url, '\\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(source_url, '\\?([^#]*)', 1) ELSE '' END AS url FROM v_source""")
    def _(v):
        return v.source.select("id", urls.normalize_url("source_url").alias("url"))

    @reg.add("X13_reference_url", "v_source", """SELECT id, CASE WHEN regexp_matches(c, '^https?://') THEN 1 WHEN NOT contains(c, ' ') AND regexp_matches(c, '^(?:www\\.)?[a-z0-9][a-z0-9.-]*\\.[a-z]{2,}(?:[/:?#].*)?$') THEN 2 ELSE 0 END AS kind
      FROM (SELECT id, CASE id % 3 WHEN 0 THEN lower(source_url) WHEN 1 THEN regexp_replace(lower(source_url), '^https?://', '') ELSE 'Label ' || source_name END AS c FROM v_source)""")
    def _(v):
        c = F.when(F.col("id") % 3 == 0, F.lower("source_url")).when(F.col("id") % 3 == 1, F.regexp_replace(F.lower("source_url"), "^https?://", "")).otherwise(F.concat(F.lit("Label "), "source_name"))
        return v.source.select("id", c.alias("c")).select("id", F.when(urls.reference_url("c") == "", 0).when(F.col("c").rlike("^https?://"), 1).otherwise(2).alias("kind"))

    @reg.add("X14_extract_urls", "v_source", "SELECT id, count(*) AS n FROM (SELECT DISTINCT id, lower(u) AS u FROM (SELECT id, unnest(regexp_extract_all(html || ' see "' || source_url || '" or ' || source_url, '(?i)https?://[^\\s\"''<>]+')) AS u FROM v_source)) GROUP BY id")
    def _(v):
        return v.source.select("id", F.size(urls.extract_urls(F.concat("html", F.lit(' see "'), "source_url", F.lit('" or '), "source_url"))).cast("bigint").alias("n")).where("n > 0")

    mark = "^\\s*(?:[•●▪◦\\-–—*]|\\d+[.)]|[a-zA-Z][.)])\\s+"
    lines = f"""ln AS (SELECT id, content, list_filter(list_transform(regexp_split_to_array(content, '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM v_section),
      it AS (SELECT id, content, list_filter(list_transform(list_filter(l, lambda x: regexp_matches(x, '{mark}')), lambda x: regexp_replace(regexp_replace(x, '{mark}', ''), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS items,
        list_filter(list_transform(string_split(content, ';'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM ln)"""

    @reg.add("X16_split_items", "v_section", f"WITH {lines} SELECT id, CAST(CASE WHEN len(items) >= 2 THEN len(items) WHEN len(parts) >= 2 THEN len(parts) ELSE 0 END AS BIGINT) AS n, CASE WHEN len(items) >= 2 THEN items[1] WHEN len(parts) >= 2 THEN parts[1] END AS first_item FROM it")
    def _(v):
        got = v.section.select("id", text.split_items_strict("content").alias("x"))
        return got.select("id", F.size("x").cast("bigint").alias("n"), F.get("x", F.lit(0)).alias("first_item"))

    @reg.add("X17_list_layout", "v_service", """SELECT id, CASE WHEN len(regexp_extract_all(b, '\\(\\d{1,2}\\)[ \\t]')) >= 2 THEN regexp_replace(b, '[ \\t]+(\\(\\d{1,2}\\)[ \\t])', chr(10) || '\\1', 'g') ELSE b END AS laid_out
      FROM (SELECT id, 'Items (1) ' || bde_summary || CASE WHEN id % 2 = 0 THEN ' (2) ' ELSE ' / ' END || title AS b FROM v_service)""")
    def _(v):
        b = F.concat(F.lit("Items (1) "), "bde_summary", F.when(F.col("id") % 2 == 0, " (2) ").otherwise(" / "), "title")
        return v.service.select("id", text.list_layout(b).alias("laid_out"))

    @reg.add("X18_slugs", "v_service", """, b AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_\\s-]+', '', 'g'), '[-\\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')[1:240] AS base FROM v_service),
      n AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM b) SELECT id, CASE WHEN k = 1 THEN base ELSE base[1:240 - length('-' || k)] || '-' || k END AS slug FROM n""")
    def _(v):
        from ..operators.windows import group_row_number
        b = v.service.select("id", text.slug_base("title").alias("base"))
        n = group_row_number(b, ["base"], F.floor(F.col("id") / 100_000), ["id"], "k")
        return n.select("id", text.numbered(F.col("base"), F.col("k"), 240).alias("slug"))

    @reg.add("X19_truncate", "v_section", "SELECT id, content[1:255] AS cut FROM v_section")
    def _(v):
        return v.section.select("id", text.truncate("content", 255).alias("cut"))

    @reg.add("X25_json_safe", "v_service", "SELECT id, strftime(pitch_until, '%Y-%m-%d') AS d, CAST(min_turnover AS VARCHAR) AS m, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS t FROM v_service")
    def _(v):
        return v.service.select("id", text.json_safe("pitch_until", "date").alias("d"), text.json_safe("min_turnover", "decimal(16,2)").alias("m"), text.json_safe("updated_at", "timestamp").alias("t"))
