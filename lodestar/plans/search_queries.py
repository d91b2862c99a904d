"""Search operators bound to the catalogue views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import money, pitch, text
from ..functions import search_terms as st
from ..operators import catalogue as cat
from ..operators import search as se
from ..operators import suggest as sg
from ..session import materialize, scratch_dir
from .registry import Registry

VIEWS = "v_service v_domain v_category v_classification v_section v_source v_rule v_query"


def catalogue(v):
    return cat.enrich(v.service, v.domain, v.category).where(pitch.searchable())


def knowledge(v):
    return [
        se.knowledge_text(v.section, ["title", "content"], F.col("visibility") == "BDE"),
        se.knowledge_text(v.source, ["source_name", "source_url"]),
        se.knowledge_text(v.rule, ["rule_type", "rule_text"], F.col("is_active")),
    ]


def texts(v):
    return se.catalogue_text(catalogue(v), v.classification, v.category, knowledge(v))


# --- SQL counterparts -------------------------------------------------------------------------
def _values(rows, cols: str, name: str) -> str:
    body = ", ".join("(" + ", ".join("'" + c.replace("'", "''") + "'" for c in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


DICTS = ", ".join([
    _values([(k, x) for k, vs in st.CONCEPT_VARIANTS.items() for x in vs], "concept, variant", "d_variant"),
    _values(list(st.TOKEN_TO_CONCEPT.items()), "token, concept", "d_token"),
    _values(list(st.PHRASE_TO_CONCEPT.items()), "phrase, concept", "d_phrase"),
    _values([(s,) for s in sorted(st.SEARCH_STOPWORDS)], "token", "d_stop"),
    _values([(s,) for s in st.SPECIFIC_FINANCE], "concept", "d_specific"),
])
NQ = "trim(regexp_replace(regexp_replace(replace(lower({}), '&', ' and '), '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g'))"
UNIT = "(lakh|lakhs|lac|lacs|crore|crores|cr)"
GROUPS = f"""{DICTS}, q0 AS (SELECT query, {NQ.format('query')} AS q FROM v_query),
 ph AS (SELECT query, phrase, concept FROM q0, d_phrase WHERE regexp_matches(q, '(^|[^a-z0-9])' || phrase || '($|[^a-z0-9])')),
 used AS (SELECT DISTINCT query, unnest(regexp_extract_all(phrase, '[a-z0-9]+')) AS token FROM ph),
 am AS (SELECT query, unnest(regexp_extract_all(q, '\\b(\\d+(?:\\.\\d+)?)\\s*{UNIT}\\b', 1)) AS num, unnest(regexp_extract_all(q, '\\b(\\d+(?:\\.\\d+)?)\\s*{UNIT}\\b', 2)) AS unit FROM q0),
 am2 AS (SELECT query, num, CASE WHEN unit LIKE 'cr%' THEN 'crore' ELSE 'lakh' END AS unit FROM am),
 tk AS (SELECT DISTINCT query, unnest(regexp_extract_all(q, '[a-z0-9]+')) AS token FROM q0),
 tk2 AS (SELECT t.query, t.token FROM tk t WHERE length(token) >= 3 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN (SELECT token FROM d_stop)
   AND NOT EXISTS (SELECT 1 FROM used u WHERE u.query = t.query AND u.token = t.token)),
 g0 AS (SELECT query, concept AS grp FROM ph UNION SELECT query, 'amount:' || num || ':' || unit FROM am2 UNION SELECT t.query, coalesce(d.concept, 'literal:' || t.token) FROM tk2 t LEFT JOIN d_token d ON d.token = t.token),
 qg AS (SELECT g.query, g.grp FROM g0 g WHERE NOT (grp = 'funding' AND EXISTS (SELECT 1 FROM g0 o JOIN d_specific s ON s.concept = o.grp WHERE o.query = g.query))),
 nf AS (SELECT DISTINCT num, unit, unnest(list_distinct([num, CASE WHEN printf('%.2f', CAST(num AS DOUBLE)) LIKE '%.00' THEN printf('%.2f', CAST(num AS DOUBLE)) ELSE regexp_replace(printf('%.2f', CAST(num AS DOUBLE)), '\\.?0+$', '') END, printf('%.2f', CAST(num AS DOUBLE))])) AS form FROM am2),
 av AS (SELECT 'amount:' || num || ':' || unit AS grp, p || form || ' ' || u AS variant FROM nf, (VALUES ('lakh','lakh'),('lakh','lakhs'),('lakh','lac'),('lakh','lacs'),('crore','crore'),('crore','crores'),('crore','cr')) uu(k, u), (VALUES (''),('rs '),('rs. '),('₹'),('₹ ')) pp(p) WHERE uu.k = unit),
 gv AS (SELECT DISTINCT grp, variant FROM (SELECT concept AS grp, variant FROM d_variant UNION ALL SELECT grp, variant FROM av UNION ALL SELECT grp, grp[9:] FROM qg WHERE grp LIKE 'literal:%') x WHERE grp IN (SELECT grp FROM qg))"""

ENR = """cv AS (SELECT s.*, d.name AS domain_name, d.display_order AS domain_order, c.name AS category_name FROM v_service s JOIN v_domain d ON s.domain_id = d.id JOIN v_category c ON s.category_id = c.id WHERE s.status IN ('APPROVED','PUBLISHED','EXPIRING'))"""
FIELDS = ", ".join(se.OWN_TEXT)
TEXTS = f"""{ENR}, tx AS (SELECT id AS service_id, lower(unnest([{FIELDS}])) AS body FROM cv
   UNION ALL SELECT k.service_id, lower(c.name) FROM v_classification k JOIN v_category c ON c.id = k.category_id
   UNION ALL SELECT service_id, lower(unnest([title, content])) FROM v_section WHERE visibility = 'BDE'
   UNION ALL SELECT service_id, lower(unnest([source_name, source_url])) FROM v_source
   UNION ALL SELECT service_id, lower(unnest([rule_type, rule_text])) FROM v_rule WHERE is_active),
 sx AS (SELECT id AS service_id, array_to_string(list_transform(list_filter(industries, lambda x: x <> ''), lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))), ' ') AS body FROM cv),
 nd AS (SELECT grp, lower(trim(variant)) AS variant FROM gv UNION SELECT 'raw:' || query, lower(trim(query)) FROM v_query WHERE trim(query) <> ''),
 st0 AS (SELECT grp, variant, list_filter(regexp_extract_all(variant, '[a-z0-9]+'), lambda t: length(t) > 2) AS l FROM nd),
 st1 AS (SELECT grp, CASE WHEN len(list_filter(l, lambda t: t NOT IN ('scheme','schemes','service','services','sector','related','for','the','and','business','company','client'))) > 0 THEN list_filter(l, lambda t: t NOT IN ('scheme','schemes','service','services','sector','related','for','the','and','business','company','client')) ELSE l END AS terms FROM st0),
 hits AS (SELECT h.grp, h.service_id FROM (SELECT DISTINCT nd.grp, tx.service_id FROM nd, tx WHERE CASE WHEN nd.variant IN ('ai','iot') THEN regexp_matches(tx.body, '(^|[^a-z0-9])' || nd.variant || '([^a-z0-9]|$)') ELSE contains(tx.body, nd.variant) END
   UNION SELECT DISTINCT st1.grp, sx.service_id FROM st1, sx WHERE len(terms) > 0 AND len(list_filter(terms, lambda t: contains(sx.body, t))) = len(terms)) h WHERE h.service_id IN (SELECT id FROM cv))"""
NATURAL = """nq AS (SELECT query, count(*) AS n FROM qg GROUP BY 1),
 hc AS (SELECT qg.query, hits.service_id, count(*) AS hits FROM qg JOIN hits ON hits.grp = qg.grp GROUP BY 1, 2),
 mx AS (SELECT hc.*, n, max(hits) OVER (PARTITION BY hc.query) AS best FROM hc JOIN nq ON nq.query = hc.query),
 nm AS (SELECT query, service_id, hits, n FROM mx WHERE hits >= CASE WHEN best = n THEN n WHEN n <= 2 THEN n WHEN n = 3 THEN 2 ELSE greatest(2, n - 1) END),
 ev AS (SELECT DISTINCT t.term, b.service_id FROM (VALUES ('ai'),('iot')) t(term), (SELECT service_id, body FROM tx UNION ALL SELECT service_id, body FROM sx) b WHERE regexp_matches(b.body, '(^|[^a-z0-9])' || t.term || '([^a-z0-9]|$)')),
 gd AS (SELECT nm.* FROM nm WHERE (NOT (regexp_matches(lower(query), '(^|[^a-z0-9])ai([^a-z0-9]|$)') OR contains(lower(query), 'artificial intelligence')) OR EXISTS (SELECT 1 FROM ev WHERE term = 'ai' AND ev.service_id = nm.service_id))
   AND (NOT (regexp_matches(lower(query), '(^|[^a-z0-9])iot([^a-z0-9]|$)') OR contains(lower(query), 'internet of things')) OR EXISTS (SELECT 1 FROM ev WHERE term = 'iot' AND ev.service_id = nm.service_id)))"""
_RANKCAT = "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in se.RANK_TEXT) + ")"
_AMT = "list_distinct(list_transform(list_zip(regexp_extract_all(lower({0}), '([0-9]+(?:\\.[0-9]+)?)\\s*(?:lakhs|lakh|lacs|lac|crores|crore|cr)\\b', 1), regexp_extract_all(lower({0}), '([0-9]+(?:\\.[0-9]+)?)\\s*(lakhs|lakh|lacs|lac|crores|crore|cr)\\b', 2)), lambda z: CAST(z[1] AS DECIMAL(18,6)) * CASE WHEN z[2] LIKE 'cr%' THEN 100 ELSE 1 END))"
SCORES = f"""sv AS (SELECT id AS service_id, {NQ.format('title')} AS t, {NQ.format(_RANKCAT)} AS core, {NQ.format('category_name')} AS ca, {NQ.format('domain_name')} AS da, {_AMT.format(_RANKCAT)} AS offered FROM cv),
 nv AS (SELECT grp, {NQ.format('variant')} AS v FROM gv WHERE grp NOT LIKE 'amount:%'),
 gp AS (SELECT h.grp, h.service_id, 450 + CASE WHEN bool_or(contains(sv.t, nv.v)) THEN 350 ELSE 0 END + CASE WHEN bool_or(contains(sv.core, nv.v)) THEN 220 ELSE 0 END + CASE WHEN bool_or(contains(sv.ca, nv.v) OR contains(sv.da, nv.v)) THEN 100 ELSE 0 END AS points
   FROM hits h JOIN nv ON nv.grp = h.grp JOIN sv ON sv.service_id = h.service_id GROUP BY 1, 2),
 ql AS (SELECT query, count(*) AS n, count(*) FILTER (grp LIKE 'amount:%') AS na, {_AMT.format('query')} AS wanted FROM qg GROUP BY query),
 bs AS (SELECT qg.query, h.service_id, sum(coalesce(gp.points, 0)) AS points, count(gp.points) AS plain FROM qg JOIN hits h ON h.grp = qg.grp LEFT JOIN gp ON gp.grp = h.grp AND gp.service_id = h.service_id GROUP BY 1, 2),
 ax AS (SELECT bs.*, ql.n, ql.na, na > 0 AND len(list_intersect(wanted, offered)) > 0 AS exact, len(wanted) > 0 AND len(offered) > 0 AND list_max(offered) >= list_min(wanted) AS enough FROM bs JOIN ql ON ql.query = bs.query JOIN sv ON sv.service_id = bs.service_id),
 rk AS (SELECT query, service_id, CAST(points + na * CASE WHEN exact THEN 2500 WHEN enough THEN 120 ELSE 0 END + CASE WHEN plain + CASE WHEN exact THEN na ELSE 0 END = n THEN 1500 WHEN n >= 3 AND plain + CASE WHEN exact THEN na ELSE 0 END = n - 1 THEN 200 ELSE 0 END AS BIGINT) AS score FROM ax)"""
BOOST = f"CASE WHEN {NQ.format('title')} = {NQ.format('query')} THEN 5000 WHEN starts_with({NQ.format('title')}, {NQ.format('query')}) THEN 1800 WHEN contains({NQ.format('title')}, {NQ.format('query')}) THEN 900 ELSE 0 END"
FOUND = "fd AS (SELECT query, service_id FROM gd UNION SELECT r.query, h.service_id FROM v_query r JOIN hits h ON h.grp = 'raw:' || r.query)"


def register(reg: Registry) -> None:
    @reg.add("Q1_query_groups", "v_query", f"WITH {GROUPS} SELECT qg.query, qg.grp, gv.variant FROM qg JOIN gv ON gv.grp = qg.grp")
    def _(v):
        return se.query_groups(v.query).select("query", "grp", F.explode("variants").alias("variant")).distinct()

    @reg.add("Q2_variant_match", VIEWS, f"WITH {GROUPS}, {TEXTS} SELECT grp, service_id FROM hits")
    def _(v):
        g = materialize(se.query_groups(v.query))
        raw = v.query.select("query", F.concat(F.lit("raw:"), "query").alias("grp"), F.array("query").alias("variants"))
        vis = catalogue(v).select(F.col("id").alias("service_id"))
        return se.group_hits(texts(v), g.unionByName(raw)).join(vis, "service_id", "left_semi").select("grp", "service_id")

    @reg.add("A24_concept_hits", VIEWS, f"WITH {GROUPS}, {TEXTS} SELECT qg.query, hits.service_id, count(*) AS hits FROM qg JOIN hits ON hits.grp = qg.grp GROUP BY 1, 2")
    def _(v):
        g = materialize(se.query_groups(v.query))
        vis = catalogue(v).select(F.col("id").alias("service_id"))
        hits = se.group_hits(texts(v), g).join(vis, "service_id", "left_semi")
        return se.group_counts(g, hits)

    @reg.add("Q4_intersection_or_threshold", VIEWS, f"WITH {GROUPS}, {TEXTS}, {NATURAL} SELECT query, service_id, hits, n AS n_groups FROM nm")
    def _(v):
        g = materialize(se.query_groups(v.query))
        vis = catalogue(v).select(F.col("id").alias("service_id"))
        return se.natural_matches(g, se.group_hits(texts(v), g).join(vis, "service_id", "left_semi"))

    @reg.add("F7_short_term_guard", VIEWS, f"WITH {GROUPS}, {TEXTS}, {NATURAL} SELECT query, service_id FROM gd")
    def _(v):
        g, s, tx = materialize(se.query_groups(v.query)), catalogue(v), texts(v)
        hits = se.group_hits(tx, g).join(s.select(F.col("id").alias("service_id")), "service_id", "left_semi")
        return se.guard(se.natural_matches(g, hits).select("query", "service_id"), se.short_tech_evidence(tx))

    @reg.add("Q5_rank_scores", VIEWS, f"WITH {GROUPS}, {TEXTS}, {SCORES} SELECT query, service_id, score FROM rk")
    def _(v):
        g, s = materialize(se.query_groups(v.query)), catalogue(v)
        hits = se.group_hits(texts(v), g).join(s.select(F.col("id").alias("service_id")), "service_id", "left_semi")
        return se.rank_scores(s, g, hits)

    @reg.add("Q7_search", VIEWS, f"""WITH {GROUPS}, {TEXTS}, {NATURAL}, {SCORES}, {FOUND},
      al AS (SELECT fd.query, fd.service_id, cv.title, cv.domain_order, coalesce(rk.score, 0) + {BOOST.replace('query', 'fd.query').replace('title', 'cv.title')} AS score FROM fd JOIN cv ON cv.id = fd.service_id LEFT JOIN rk ON rk.query = fd.query AND rk.service_id = fd.service_id)
      SELECT query, service_id, title, score, rank, result_count FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, domain_order, {NQ.format('title')}, service_id) AS rank, count(*) OVER (PARTITION BY query) AS result_count FROM al) WHERE rank <= 250""")
    def _(v):
        return se.search(v.query, catalogue(v), texts(v))

    @reg.add("Q6_title_boost", "v_service v_query", f"""SELECT s.id, q.query, {BOOST} AS boost FROM v_service s JOIN v_query q ON q.query_id = s.id""")
    def _(v):
        j = v.service.join(v.query, F.col("id") == F.col("query_id"))
        return j.select("id", "query", se.title_boost("query", "title").alias("boost"))

    kn = """tx AS (SELECT service_id, lower(unnest([title, content])) AS body FROM v_section WHERE visibility = 'BDE' UNION ALL SELECT service_id, lower(unnest([source_name, source_url])) FROM v_source
       UNION ALL SELECT service_id, lower(unnest([rule_type, rule_text])) FROM v_rule WHERE is_active)"""

    @reg.add("F8_knowledge_search", "v_section v_source v_rule v_query", f"WITH {kn} SELECT DISTINCT q.query, tx.service_id FROM v_query q, tx WHERE CASE WHEN lower(q.query) IN ('ai','iot') THEN regexp_matches(tx.body, '(^|[^a-z0-9])' || lower(q.query) || '([^a-z0-9]|$)') ELSE contains(tx.body, lower(q.query)) END")
    def _(v):
        tx = None
        for frame in knowledge(v):
            part = frame.select("service_id", F.lit(False).alias("sector"), F.lower("text").alias("text"))
            tx = part if tx is None else tx.unionByName(part)
        raw = v.query.select(F.col("query").alias("grp"), F.array("query").alias("variants"))
        return se.group_hits(tx, raw).select(F.col("grp").alias("query"), "service_id")

    ck = "array_to_string(list_transform(string_split({}, ' '), lambda t: coalesce(map_extract_value(m, t), t)), ' ')"
    from ..functions.wordlists import TYPEAHEAD_PHRASE_ALIASES, TYPEAHEAD_WORD_ALIASES, KIND_LABELS

    def canon(expr: str) -> str:
        out = f"trim(regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for a, b in TYPEAHEAD_PHRASE_ALIASES:
            out = f"replace({out}, '{a}', '{b}')"
        amap = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in TYPEAHEAD_WORD_ALIASES.items()) + "}"
        return f"array_to_string(list_transform(string_split({out}, ' '), lambda t: coalesce(({amap})[t], t)), ' ')"

    @reg.add("X7_canonicalize", "v_section", f"SELECT id, {canon('content')} AS c FROM v_section")
    def _(v):
        return v.section.select("id", text.canonicalize("content").alias("c"))

    kinds = "CASE service_kind " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KIND_LABELS.items()) + " ELSE service_kind END"
    direct = "concat_ws(' ', " + ", ".join(sg.DIRECT_TEXT) + ")"

    def hit(col: str) -> str:
        return f"len(list_filter(terms, lambda t: CASE WHEN length(t) <= 3 THEN NOT list_contains(string_split({col}, ' '), t) ELSE NOT contains({col}, t) END)) = 0 AND {col} <> ''"

    @reg.add("Q8_typeahead", VIEWS, f"""WITH {ENR}, bc AS (SELECT service_id, string_agg({canon('content')}, ' ' ORDER BY id) AS content_c FROM v_section WHERE visibility = 'BDE' GROUP BY 1),
      cc AS (SELECT cv.id AS service_id, title, {canon('title')} AS title_c, {canon('cv.service_id')} AS code_c, {canon('category_name')} AS category_c, {canon('domain_name')} AS domain_c, {canon(kinds)} AS kind_c,
        {canon("coalesce(array_to_string(industries, ' '), '')")} AS industries_c, {canon(direct)} AS direct_c, coalesce(content_c, '') AS content_c FROM cv LEFT JOIN bc ON bc.service_id = cv.id),
      aq AS (SELECT query, {canon('query')} AS qc FROM v_query WHERE length(trim(query)) >= 2), ta AS (SELECT query, qc, list_distinct(string_split(qc, ' ')) AS terms FROM aq WHERE qc <> ''),
      pr AS (SELECT *, concat_ws(' ', title_c, code_c, category_c, domain_c, kind_c, industries_c, direct_c, content_c) AS all_c FROM ta, cc),
      tr AS (SELECT query, service_id, title, CASE WHEN title_c = qc THEN 0 WHEN length(qc) > 3 AND starts_with(title_c, qc) THEN 1 WHEN {hit('title_c')} THEN 2 WHEN {hit('category_c')} OR {hit('domain_c')} THEN 3 WHEN {hit('industries_c')} THEN 4
        WHEN {hit('direct_c')} THEN 5 WHEN {hit('content_c')} THEN 6 ELSE 7 END AS tier FROM pr WHERE {hit('all_c')})
      SELECT query, service_id, title, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, lower(title), service_id) AS rank FROM tr) WHERE rank <= 8""")
    def _(v):
        sections = v.section.where("visibility = 'BDE'").join(catalogue(v).select(F.col("id").alias("service_id")), "service_id", "left_semi")
        return sg.typeahead(v.query, catalogue(v), sections)

    @reg.add("T3_suggestions")
    def _(v):
        """The stored index: built while some services are missing and some have other titles, then brought up to date for these."""
        now = catalogue(v)
        sections = v.section.where("visibility = 'BDE'").join(now.select(F.col("id").alias("service_id")), "service_id", "left_semi")
        before = now.where("id % 7 <> 3").withColumn("title", F.when(F.col("id") % 5 == 1, F.concat(F.lit("former loan "), "title")).otherwise(F.col("title")))
        index = sg.SuggestIndex(v.spark, f"{scratch_dir(v.spark)}/index-{uuid.uuid4().hex}")
        index.build(before, sections.where("service_id % 7 <> 3"), 1)
        index.update(now, sections, now.where("id % 7 = 3 OR id % 5 = 1").select(F.col("id").alias("service_id")), 2)
        return index.suggest(v.query)

    reg.sql["T3_suggestions"] = reg.sql["Q8_typeahead"]

    @reg.add("X8_phrase_present", "v_section", "SELECT id, regexp_matches(lower(content), '(^|[^a-z0-9])the($|[^a-z0-9])') AS the_word, regexp_matches(lower(content), '(^|[^a-z0-9])of the($|[^a-z0-9])') AS of_the FROM v_section")
    def _(v):
        low = F.lower("content")
        return v.section.select("id", text.phrase_present(low, "the").alias("the_word"), text.phrase_present(low, "of the").alias("of_the"))

    @reg.add("X9_money_amounts", "v_service", f"SELECT id, array_to_string(list_transform(list_sort({_AMT.format(_RANKCAT)}), lambda x: printf('%.2f', CAST(x AS DOUBLE))), ',') AS amounts FROM v_service")
    def _(v):
        got = money.amounts_in_lakh(text.join_nonblank(*se.RANK_TEXT))
        return v.service.select("id", F.array_join(F.transform(F.array_sort(got), lambda x: F.format_string("%.2f", x.cast("double"))), ",").alias("amounts"))

    @reg.add("X10_amount_variants", "v_client", """, n AS (SELECT client_id, CAST(client_id % 997 AS VARCHAR) || CASE WHEN client_id % 3 = 0 THEN '.5' ELSE '' END AS num, CASE WHEN client_id % 2 = 0 THEN 'lakh' ELSE 'crore' END AS unit FROM v_client),
      f AS (SELECT client_id, unit, unnest(list_distinct([num, CASE WHEN num LIKE '%.5' THEN num ELSE num || '.00' END, CASE WHEN num LIKE '%.5' THEN num || '0' ELSE num || '.00' END])) AS form FROM n)
      SELECT client_id, p || form || ' ' || u AS variant FROM f, (VALUES ('lakh','lakh'),('lakh','lakhs'),('lakh','lac'),('lakh','lacs'),('crore','crore'),('crore','crores'),('crore','cr')) uu(k, u), (VALUES (''),('rs '),('rs. '),('₹'),('₹ ')) pp(p) WHERE k = unit""")
    def _(v):
        num = F.concat((F.col("client_id") % 997).cast("string"), F.when(F.col("client_id") % 3 == 0, ".5").otherwise(""))
        unit = F.when(F.col("client_id") % 2 == 0, "lakh").otherwise("crore")
        return v.client.select("client_id", F.explode(money.amount_variants(num, unit)).alias("variant"))
