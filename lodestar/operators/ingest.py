"""Workbook understanding: headers, sheet kinds and candidate extraction.

Input rows are ``(file, sheet, row_no, values array<string>, links array<string>)`` without
empty rows. Everything per sheet is an aggregate over its rows, so one large sheet spreads over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sheet_terms as st
from ..functions import text
from ..session import materialize
from .knowledge import contains_any
from .resolve import resolve_titles
from .windows import best_per_group, carry_forward, top_per_group

KEYS = ["file", "sheet"]


def marker_count(body: Column, markers) -> Column:
    """How many of the markers occur."""
    total = F.lit(0)
    for m in markers:
        total = total + F.contains(body, F.lit(m)).cast("int")
    return total


def header_field(value) -> Column:
    """Field a header names, NULL if none. The first field in order wins."""

    def named(n: Column) -> Column:
        out = None
        for field, aliases in st.HEADER_ALIASES.items():
            test = n.isin(*aliases)
            long = [a for a in aliases if len(a) >= st.CONTAINED_ALIAS]
            if long:
                test = test | contains_any(n, long)
            out = F.when(test, field) if out is None else out.when(test, field)
        return out

    return text.bound(text.norm_alnum(value), named)


def detect_headers(rows: DataFrame, first_rows: int | None = None) -> DataFrame:
    """Best header row of each sheet, with its field positions.

    ``first_rows`` looks at that many rows of a sheet only; by default all rows are candidates.
    """
    first = rows.select(*KEYS, "row_no", "values")
    if first_rows is not None:
        first = top_per_group(first, KEYS, ["row_no"], first_rows).drop("rank")
    fields = first.select(
        *KEYS, "row_no", "values", F.transform("values", header_field).alias("fields"),
        F.size(F.filter("values", lambda v: text.norm_alnum(v) != "")).alias("nonempty"),
    ).withColumn("found", F.array_distinct(F.array_compact("fields")))
    scored = fields.where(F.size("found") > 0).withColumn(
        "score", F.size("found") * 10 + F.least("nonempty", F.lit(10))
    )
    best = best_per_group(scored, KEYS, [F.desc("score"), "row_no"])
    return best.select(
        *KEYS, F.col("row_no").alias("header_row"), "nonempty", "score", F.col("values").alias("header_values"),
        F.map_from_entries(
            F.transform("found", lambda f: F.struct(f, (F.array_position("fields", f) - 1).cast("int")))
        ).alias("mapping"),
    )


def _cell(field: str) -> Column:
    """Text of the mapped column of a row, NULL when absent."""
    return F.get("values", F.try_element_at("mapping", F.lit(field)))


def sheet_kinds(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Kind of every sheet by an ordered decision list over its features."""
    filled = F.filter("values", lambda v: F.trim(v) != "")
    joined = rows.select(*KEYS, "row_no", "values", filled.alias("cells")).join(
        headers.select(*KEYS, "header_row", "nonempty", "mapping"), KEYS, "left"
    )
    is_data = F.col("header_row").isNull() | (F.col("row_no") > F.col("header_row"))
    titled = is_data & (F.trim(F.coalesce(_cell("scheme_name"), F.lit(""))) != "")
    commercial = None
    for field in st.COMMERCIAL_FIELDS:
        there = F.trim(F.coalesce(_cell(field), F.lit(""))) != ""
        commercial = there if commercial is None else commercial | there
    # a marker counts once per sheet, in whichever row it stands
    words = F.array_join(F.transform("cells", text.norm_alnum), " ")
    joined = joined.withColumn("words", words)
    signals = {"n_comm": st.COMMUNICATION_SIGNALS, "n_know": st.KNOWLEDGE_SIGNALS}
    shape = joined.groupBy(*KEYS).agg(
        F.max(F.size("values")).alias("width"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.size("cells")).alias("n_values"),
        F.sum(F.size(F.filter("cells", lambda v: F.length(F.trim(v)) >= 35))).alias("n_long"),
        F.count_if(is_data & (F.size("cells") > 0)).alias("n_data"),
        F.count_if(is_data & (F.size("cells") >= 2)).alias("n_multi"),
        F.count_if(titled).alias("n_titled"),
        F.count_if(titled & commercial).alias("n_commercial"),
        *(F.max(F.contains("words", F.lit(m)).cast("int")).alias(f"{name}_{i}") for name, markers in signals.items() for i, m in enumerate(markers)),
    )
    f = shape.join(headers, KEYS, "left").withColumns({
        name: sum((F.col(f"{name}_{i}") for i in range(1, len(markers))), F.col(f"{name}_0")) for name, markers in signals.items()
    })
    has = F.col("header_row").isNotNull()
    scheme = F.coalesce(F.map_contains_key("mapping", F.lit("scheme_name")), F.lit(False))
    known = F.coalesce(F.size("mapping"), F.lit(0))
    paid = F.lit(False)
    for field in st.COMMERCIAL_FIELDS:
        paid = paid | F.coalesce(F.map_contains_key("mapping", F.lit(field)), F.lit(False))
    pair_ratio = F.coalesce(F.try_divide("n_multi", "n_data"), F.lit(0.0))
    long_ratio = F.coalesce(F.try_divide("n_long", "n_values"), F.lit(0.0))
    paid_ratio = F.coalesce(F.try_divide("n_commercial", "n_titled"), F.lit(0.0))
    kind = (
        F.when(has & scheme & paid & (F.col("n_commercial") >= 5) & (paid_ratio >= 0.35), "COMMERCIAL_SERVICE_TABLE")
        .when((F.col("width") <= 2) & (F.col("n_comm") >= 3) & (F.col("n_know") <= 1), "COMMUNICATION")
        .when(has & scheme & (F.col("nonempty") >= 4) & (F.col("nonempty") - known >= 3) & (known <= 2), "COMPARISON_MATRIX")
        .when(has & scheme & (known >= 2), "STRUCTURED_TABLE")
        .when(has & ~scheme & (F.col("nonempty") <= 3) & (pair_ratio >= 0.60), "REFERENCE_TABLE")
        .when((F.col("n_know") >= 2) & ((long_ratio >= 0.08) | ((F.col("width") <= 3) & (pair_ratio < 0.60))), "NARRATIVE_KNOWLEDGE")
        .when(has, "REFERENCE_TABLE")
        .otherwise("UNKNOWN")
    )
    return f.select(*KEYS, kind.alias("kind"), "header_row", "header_values", "mapping", "n_rows", "width")


def section_type(value) -> Column:
    def named(n: Column) -> Column:
        out = None
        for name, markers in st.SECTION_MARKERS:
            test = contains_any(n, markers)
            out = F.when(test, name) if out is None else out.when(test, name)
        return out

    return text.bound(text.norm_alnum(value), named)


def is_heading(value) -> Column:
    raw = text.strip(text.blank(value))
    starred = raw.startswith("*") & raw.endswith("*")
    typed = (F.length(raw) <= 110) & section_type(raw).isNotNull()
    short = (F.length(raw) <= 90) & (raw.endswith(":") | text.norm_alnum(raw).isin(*st.PLAIN_HEADINGS))
    return (raw != "") & (starred | typed | short)


def category_rule(value, available: list[str]) -> Column:
    """Number of the first category rule whose marker occurs, NULL if none."""

    def numbered(n: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, (slug, _, markers) in reversed(list(enumerate(st.CATEGORY_MARKERS))):
            if slug in available:
                out = F.when(contains_any(n, markers), F.lit(i)).otherwise(out)
        return out

    return text.bound(text.norm_alnum(value), numbered)


def proposal(rule: Column, available: list[str]) -> Column:
    """Struct of category, kind and confidence for a rule number."""
    slugs = F.array(*[F.lit(s) for s, _, _ in st.CATEGORY_MARKERS])
    kinds = F.array(*[F.lit(k) for _, k, _ in st.CATEGORY_MARKERS])
    fallback = st.FALLBACK_CATEGORY if st.FALLBACK_CATEGORY in available else None
    return F.struct(
        F.when(rule.isNotNull(), F.get(slugs, rule)).otherwise(F.lit(fallback)).alias("category_slug"),
        F.when(rule.isNotNull(), F.get(kinds, rule)).otherwise(F.lit("OTHER")).alias("service_kind"),
        F.when(rule.isNotNull(), st.MARKED_CONFIDENCE).otherwise(st.FALLBACK_CONFIDENCE).alias("confidence"),
    )


def available_slugs(categories: DataFrame) -> list[str]:
    """Which of the fixed category slugs exist; at most one row per fixed slug is read."""
    wanted = [s for s, _, _ in st.CATEGORY_MARKERS] + [st.FALLBACK_CATEGORY]
    return [r["slug"] for r in categories.where(F.col("slug").isin(*wanted)).select("slug").distinct().collect()]


def content_scores(value) -> list[Column]:
    """Financial, eligibility and sector evidence of a cell."""
    low, n = F.lower(text.blank(value)), text.norm_alnum(value)
    financial = (
        marker_count(low, st.FINANCIAL_MARKERS) * 2
        + F.when(F.contains(low, F.lit("%")), 2).otherwise(0)
        + F.when(F.regexp_like(low, F.lit(r"\b\d+\s*(?:lakh|crore)\b")), 3).otherwise(0)
    )
    sector = marker_count(n, st.SECTOR_MARKERS) * 2 + F.when(
        (n != "") & (F.regexp_count(text.blank(value), F.lit("\n")) >= 2), 2
    ).otherwise(0)
    return [financial.alias("financial"), (marker_count(n, st.ELIGIBILITY_MARKERS) * 2).alias("eligible"), sector.alias("sector_score")]


def content_field(financial, eligible, sector) -> Column:
    """Field of the best evidence (greater name on ties), additional_info below two points."""
    best = F.greatest(
        F.struct(F.col(financial).alias("s"), F.lit("benefits").alias("f")),
        F.struct(F.col(eligible).alias("s"), F.lit("eligibility").alias("f")),
        F.struct(F.col(sector).alias("s"), F.lit("focus_sectors").alias("f")),
    )
    return F.when(best["s"] >= 2, best["f"]).otherwise(F.lit("additional_info"))


def _match_struct() -> Column:
    return F.struct("action", "matched_service_id", "score", "method", "matched_title").alias("match")


def _with_match(candidates: DataFrame, catalogue: DataFrame) -> DataFrame:
    candidates = materialize(candidates)  # read for the titles and again for the join
    found = resolve_titles(candidates.select("title"), catalogue).select("title", _match_struct())
    return candidates.join(found, "title")


def structured_candidates(rows: DataFrame, kinds: DataFrame, catalogue: DataFrame, available: list[str]) -> DataFrame:
    """One candidate per titled row below the header of table sheets."""
    body = rows.join(kinds.select(*KEYS, "header_row", "mapping"), KEYS).where("row_no > header_row")
    order = F.array_sort(F.transform(F.map_entries("mapping"), lambda e: F.struct(e["value"].alias("i"), e["key"].alias("f"))))
    cells = F.transform(order, lambda e: F.struct(e["f"].alias("f"), F.get("values", e["i"]).alias("v"), F.get("links", e["i"]).alias("u")))
    step = body.withColumn("cells", cells)
    filled = F.filter("cells", lambda c: F.trim(F.coalesce(c["v"], F.lit(""))) != "")
    step = step.select(
        *KEYS, F.col("row_no").alias("source_row"),
        F.map_from_entries(F.transform(filled, lambda c: F.struct(c["f"], c["v"]))).alias("fields"),
        F.transform(F.filter("cells", lambda c: F.coalesce(c["u"], F.lit("")) != ""), lambda c: F.struct(c["f"].alias("field"), c["u"].alias("url"))).alias("links"),
        F.array_join(F.transform(filled, lambda c: c["v"]), " ").alias("body"),
    )
    step = step.withColumn("title", text.strip(F.coalesce(F.try_element_at("fields", F.lit("scheme_name")), F.lit("")))).where("title <> ''")
    rule = category_rule(F.concat_ws(" ", "title", "body"), available)
    out = step.withColumn("proposal", proposal(rule, available)).drop("body")
    return _with_match(out, catalogue).withColumn("extraction_mode", F.lit("STRUCTURED"))


def suspicious_headers(kinds: DataFrame, rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Sheets whose chosen header row looks like data."""
    heads = kinds.where("kind = 'STRUCTURED_TABLE'").select(
        *KEYS, "header_row", "mapping",
        text.strip(F.coalesce(F.get("header_values", F.try_element_at("mapping", F.lit("scheme_name"))), F.lit(""))).alias("title"),
    ).where(F.map_contains_key("mapping", F.lit("scheme_name")) & ~text.norm_alnum("title").isin(*st.HEADER_LABELS))
    first = rows.groupBy(*KEYS).agg(F.min("row_no").alias("first_row"))
    known = resolve_titles(heads.select("title"), catalogue)
    late = (F.col("header_row") > F.col("first_row")) & (F.size("mapping") <= 2)
    strong = (F.col("action") == "UPDATE") & (F.col("score") >= 0.90)
    return heads.join(first, KEYS).join(known, "title").where(strong | late).select(*KEYS)


def headerless_candidates(rows: DataFrame, catalogue: DataFrame, available: list[str]) -> DataFrame:
    """Rows of tables without a usable header: title by match, other cells by their evidence."""
    cells = rows.select(*KEYS, "row_no", "links", F.posexplode("values").alias("pos", "cell")).where(F.trim("cell") != "")
    one_line = ~F.contains("cell", F.lit("\n"))
    cells = cells.withColumn("title", text.strip(F.col("cell")))
    tried = cells.where((F.length("title") <= 180) & one_line)
    found = resolve_titles(tried.select("title"), catalogue).select("title", _match_struct())
    scored = cells.join(found, "title", "left").select(
        *KEYS, "row_no", "pos", "cell", "title", "match", F.get("links", F.col("pos")).alias("url"), *content_scores("cell")
    )
    update = (F.col("match.action") == "UPDATE") & one_line & (F.length("title") <= 180)
    brief = (F.length("title") <= 140) & one_line & (F.size(F.split("title", r"\s+")) <= 18)
    pick = F.struct("pos", "title", "match")
    # one row holds at most the columns of a sheet
    grouped = scored.withColumn("field", content_field("financial", "eligible", "sector_score")).groupBy(*KEYS, "row_no").agg(
        F.max_by(F.when(update, pick), F.when(update, F.struct(F.col("match.score"), -F.col("pos")))).alias("known"),
        F.min_by(F.when(brief, pick), F.when(brief, F.col("pos"))).alias("brief"),
        F.array_sort(F.collect_list(F.struct("pos", "field", "cell", "url"))).alias("cells"),
    )
    step = grouped.withColumn("pick", F.coalesce("known", "brief")).where("pick IS NOT NULL")
    rest = F.filter("cells", lambda c: c["pos"] != F.col("pick.pos"))

    def text_of(name: str) -> Column:
        mine = F.transform(F.filter("rest", lambda c: c["field"] == name), lambda c: c["cell"])
        return F.aggregate(
            mine, F.lit(""),
            lambda acc, x: F.when(acc == "", x).when(F.contains(acc, text.strip(x)), acc).otherwise(F.concat(text.strip(acc), F.lit("\n"), text.strip(x))),
        )

    names = ["benefits", "eligibility", "focus_sectors", "additional_info"]
    step = step.withColumn("rest", rest)
    entries = F.filter(
        F.array(F.struct(F.lit("scheme_name").alias("f"), F.col("pick.title").alias("v")), *[F.struct(F.lit(n).alias("f"), text_of(n).alias("v")) for n in names]),
        lambda e: e["v"] != "",
    )
    step = step.withColumn("entries", entries)
    rule = category_rule(F.concat_ws(" ", "pick.title", F.array_join(F.transform("entries", lambda e: e["v"]), " ")), available)
    return step.select(
        F.col("pick.title").alias("title"), *KEYS, F.col("row_no").alias("source_row"),
        F.map_from_entries("entries").alias("fields"),
        F.transform(F.filter("rest", lambda c: F.coalesce(c["url"], F.lit("")) != ""), lambda c: F.struct(c["field"].alias("field"), c["url"].alias("url"))).alias("links"),
        proposal(rule, available).alias("proposal"), F.col("pick.match").alias("match"),
        F.lit("HEADERLESS_STRUCTURED").alias("extraction_mode"),
    )


def narrative_sections(rows: DataFrame, block_rows: int = 10_000) -> DataFrame:
    """Every cell as a typed section; cells inherit the type of the last typed heading."""
    cells = rows.select(*KEYS, "row_no", "links", F.posexplode("values").alias("pos", "cell"))
    cells = cells.withColumn("content", text.strip(text.blank("cell"))).where("content <> ''")
    head = is_heading("content")
    typed = cells.select(
        *KEYS, F.col("row_no").alias("source_row"), (F.col("pos") + 1).alias("source_column"), "content",
        head.alias("is_heading"), F.when(head, section_type("content")).alias("own_type"), F.get("links", F.col("pos")).alias("url"),
    )
    out = carry_forward(typed, KEYS, F.floor(F.col("source_row") / block_rows), ["source_row", "source_column"], "own_type", "section_type")
    return out.withColumn("section_type", F.coalesce("section_type", F.lit("OTHER"))).drop("own_type")


def clean_hint(value) -> Column:
    return F.regexp_replace(F.regexp_replace(text.blank(value), r"[*_]+", ""), st.TITLE_EDGE, "")


def title_like(value) -> Column:
    """A narrative cell that reads like a service title."""
    v = clean_hint(value)
    words = F.size(F.split(text.strip(v), r"\s+"))
    return (
        F.length(v).between(4, 150)
        & (F.regexp_count(v, F.lit(",")) <= 2) & (F.regexp_count(v, F.lit(";")) <= 1)
        & words.between(2, 18) & ~text.norm_alnum(v).isin(*st.NOT_TITLES)
        & contains_any(text.norm_alnum(v), st.TITLE_MARKERS)
    )


def narrative_candidates(sections: DataFrame, catalogue: DataFrame, available: list[str]) -> DataFrame:
    """One candidate per narrative sheet: subject by sheet name, else the first titles inside."""
    hints = sections.where(title_like("content")).select(*KEYS, "source_row", "source_column", clean_hint("content").alias("title"))
    sheets = sections.groupBy(*KEYS).agg(
        F.min("source_row").alias("source_row"), F.min(category_rule("content", available)).alias("body_rule")
    ).withColumn("sheet_hint", clean_hint(F.regexp_replace("sheet", "_", " ")))
    names = hints.select("title").union(sheets.select(F.col("sheet_hint").alias("title")))
    found = materialize(resolve_titles(names, catalogue).select("title", _match_struct()))
    matched = hints.join(found, "title").join(sheets.select(*KEYS, "sheet_hint"), KEYS).where("title <> sheet_hint")
    at = F.struct("source_row", "source_column")
    pick = F.struct("title", "match")

    def first(action: str) -> Column:
        here = F.col("match.action") == action
        return F.min_by(F.when(here, pick), F.when(here, at))

    best = matched.groupBy(*KEYS).agg(first("UPDATE").alias("u"), first("MERGE_REVIEW").alias("m"), first("CREATE").alias("c"))
    own = found.select(F.col("title").alias("sheet_hint"), F.col("match").alias("sheet_match"))
    step = sheets.join(own, "sheet_hint", "left").join(best, KEYS, "left")
    specific = F.regexp_count("sheet_hint", F.lit("[A-Za-z0-9]+")) >= 3
    trusted = (F.col("sheet_match.action") == "UPDATE") & ((F.col("sheet_match.method") == "EXACT_NORMALIZED_TITLE") | specific)
    sheet_pick = F.struct(F.col("sheet_hint").alias("title"), F.col("sheet_match").alias("match"))
    chosen = F.coalesce(
        F.when(trusted, sheet_pick), F.col("u"), F.when(F.col("sheet_match.action") == "MERGE_REVIEW", sheet_pick), F.col("m"), F.col("c")
    )
    step = step.withColumn("chosen", chosen)
    hint = F.coalesce("chosen.title", F.when(F.col("sheet_hint") != "", F.col("sheet_hint")).otherwise(F.col("sheet")))
    method = (
        F.when(F.col("chosen").isNull(), "NO_SERVICE_TITLE_FOUND")
        .when((F.col("chosen.match.action") == "CREATE") & ~title_like(hint), "NARRATIVE_TITLE_NOT_SERVICE_LIKE")
    )
    title = F.coalesce(F.when(F.col("chosen.match.action").isin("UPDATE", "MERGE_REVIEW"), F.col("chosen.match.matched_title")), hint)
    match = F.struct(
        F.when(method.isNotNull(), "INVALID").otherwise(F.col("chosen.match.action")).alias("action"),
        F.col("chosen.match.matched_service_id").alias("matched_service_id"),
        F.coalesce("chosen.match.score", F.lit(0.0)).alias("score"),
        F.coalesce(method, F.col("chosen.match.method")).alias("method"),
        F.col("chosen.match.matched_title").alias("matched_title"),
    )
    rule = F.least(category_rule(title, available), F.col("body_rule"))
    return step.select(
        *KEYS, "source_row", title.alias("title"), hint.alias("source_title_hint"),
        proposal(rule, available).alias("proposal"), match.alias("match"), F.lit("NARRATIVE").alias("extraction_mode"),
    )


def analyse(rows: DataFrame, catalogue: DataFrame, categories: DataFrame) -> dict[str, DataFrame]:
    """Sheets with their kinds, typed sections and all candidates of a set of files."""
    available = available_slugs(categories)
    kinds = materialize(sheet_kinds(rows, detect_headers(rows)))
    false_heads = materialize(suspicious_headers(kinds, rows, catalogue))
    table_kinds = kinds.where("kind IN ('STRUCTURED_TABLE', 'COMMERCIAL_SERVICE_TABLE')").join(false_heads, KEYS, "left_anti")
    tables = structured_candidates(rows, table_kinds, catalogue, available)
    loose = headerless_candidates(rows.join(false_heads, KEYS, "left_semi"), catalogue, available)
    stories = rows.join(kinds.where("kind = 'NARRATIVE_KNOWLEDGE'"), KEYS, "left_semi")
    sections = materialize(narrative_sections(stories))
    told = narrative_candidates(sections, catalogue, available)
    candidates = tables.unionByName(loose).unionByName(told, allowMissingColumns=True)
    return {"sheets": kinds, "sections": sections, "candidates": candidates}


def action_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(F.col("match.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def preview(rows: DataFrame, n_rows: int = 8, n_columns: int = 30) -> DataFrame:
    """First rows and columns of each sheet with its total size."""
    size = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total_rows"), F.max(F.size("values")).cast("bigint").alias("width"))
    first = top_per_group(rows.select(*KEYS, "row_no", "values"), KEYS, ["row_no"], n_rows)
    return first.withColumn("values", F.slice("values", 1, n_columns)).join(size, KEYS)


def census(rows: DataFrame) -> DataFrame:
    """Filled cells, hyperlinks and formulas per sheet, with a total row per file and overall."""
    per_row = rows.select(
        *KEYS,
        F.size(F.filter("values", lambda v: F.trim(v) != "")).alias("cells"),
        F.size(F.filter("links", lambda u: F.coalesce(u, F.lit("")) != "")).alias("links"),
        F.size(F.filter("values", lambda v: v.startswith("="))).alias("formulas"),
    )
    return per_row.rollup("file", "sheet").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("cells").alias("cells"), F.sum("links").alias("links"), F.sum("formulas").alias("formulas")
    )


# --- staging ------------------------------------------------------------------------------------
def staging_status(match_action, stale) -> list[Column]:
    """(candidate_action, validation_status) of a staged row."""
    action = F.when(stale, "MERGE_REVIEW").when(match_action.isNull(), "UNDECIDED").otherwise(match_action)
    status = (
        F.when(match_action.isNull(), "PENDING").when(stale | (action == "MERGE_REVIEW"), "WARNING")
        .when(action == "INVALID", "INVALID").otherwise("VALID")
    )
    return [action.alias("candidate_action"), status.alias("validation_status")]


def stage_rows(rows: DataFrame, candidates: DataFrame, services: DataFrame, batch_id: int) -> DataFrame:
    """Every physical row with its candidate, if any. Two candidates on one row are an error."""
    twice = candidates.groupBy(*KEYS, "source_row").count().where("count > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError("two candidates share one source row")
    c = candidates.select(
        *KEYS, F.col("source_row").alias("row_no"), F.col("title").alias("c_title"), "proposal",
        F.col("match.action").alias("match_action"), F.col("match.matched_service_id").alias("sid"),
        F.to_json(F.struct("title", "proposal", "match", *[x for x in ("fields", "links") if x in candidates.columns])).alias("candidate"),
    )
    known = services.select(F.col("id").alias("sid"), F.lit(True).alias("known"))
    joined = rows.join(c, [*KEYS, "row_no"], "left").join(known, "sid", "left")
    stale = F.col("sid").isNotNull() & F.col("known").isNull()
    first_cell = F.get(F.filter("values", lambda v: F.trim(v) != ""), F.lit(0))
    payload = F.to_json(F.struct("candidate", "file", "links", "row_no", "sheet", "values"), {"ignoreNullFields": "false"})
    return joined.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), *KEYS, "row_no",
        F.coalesce(F.when(F.col("c_title") != "", F.col("c_title")), first_cell, F.lit("")).alias("source_key"),
        F.sha2(payload, 256).alias("row_hash"), payload.alias("raw_data"),
        *staging_status(F.col("match_action"), stale),
        F.when(F.col("known"), F.col("sid")).alias("matched_service_id"),
    )


def write_staged(staged: DataFrame, path: str) -> None:
    staged.write.mode("append").partitionBy("batch_id").parquet(path)
