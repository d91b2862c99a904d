"""Typing of imported knowledge keys, sections, rules and documents."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.wordlists import (
    BLOCKED_KEY_PARTS,
    DISQUALIFIER_MARKERS,
    KEY_SECTION_MARKERS,
    MANDATORY_DOCUMENT_MARKERS,
    REQUIRED_MARKERS,
)
from ..session import materialize
from .windows import best_per_group, carry_forward, group_row_number


def contains_any(haystack: Column, needles) -> Column:
    """Any of the fixed needles is a substring; the haystack is evaluated once."""
    return F.regexp_like(haystack, F.lit("|".join(rf"\Q{n}\E" for n in needles)))


def any_contained(haystack: Column, needles) -> Column:
    """As ``contains_any``, for a haystack that is at hand: a search for each needle that holds no other, which short texts pass sooner."""
    fewest = [n for n in needles if not any(m != n and m in n for m in needles)]
    return functools.reduce(operator.or_, [F.contains(haystack, F.lit(n)) for n in fewest])


def blocked_key(key) -> Column:
    """Keys about internal or commercial data."""
    return text.bound(text.normalise_key(key), lambda k: any_contained(k, BLOCKED_KEY_PARTS))


def _typed(k: Column) -> Column:
    out = F.when((k == "") | any_contained(k, BLOCKED_KEY_PARTS), F.lit(None))
    for section, markers in KEY_SECTION_MARKERS:
        out = out.when(any_contained(k, markers), F.lit(section))
    return out


def key_section_type(key) -> Column:
    """Section type of a raw key, NULL when blocked or unknown."""
    return text.bound(text.normalise_key(key), _typed)


def rule_type(value) -> Column:
    n = text.norm_space(value)
    return (
        F.when(contains_any(n, DISQUALIFIER_MARKERS), "DISQUALIFIER")
        .when(contains_any(n, REQUIRED_MARKERS), "REQUIRED")
        .when(F.contains(n, F.lit("optional")), "OPTIONAL")
        .otherwise("INFORMATION")
    )


def documents_required(heading, content) -> Column:
    return contains_any(
        text.norm_space(F.concat_ws(" ", text.blank(heading), text.blank(content))), MANDATORY_DOCUMENT_MARKERS
    )


# --- raw import rows to sections -------------------------------------------------------------
#: levels of a text that are opened before its nodes are written
LEVELS = 3
_NODE = "struct<key:string,text:string,shape:string,links:array<string>>"


def _node(key: Column, held: Column, shape: Column, links: Column | None = None) -> Column:
    links = F.lit(None) if links is None else links
    return F.struct(key.alias("key"), held.alias("text"), shape.alias("shape"), links.cast("array<string>").alias("links"))


def _is_open(node: Column) -> Column:
    return node["shape"].isin("{", "[")


def _inside(node: Column) -> Column:
    """Nodes inside an open node. ``shape`` is the first character of a node's JSON, ``text`` the JSON of a container or the plain text
    of anything else."""
    body, is_object = node["text"], node["shape"] == "{"
    # texts of strings lose their quotes: where one may look like a container or a truth value, the same values as variants tell
    doubtful = any_contained(body, ('"[', '"{', '"\\', '"true"', '"false"'))
    objects, lists = F.map_values(F.from_json(body, "map<string,variant>")), F.from_json(body, "array<variant>")
    variants = F.when(doubtful, F.when(is_object, objects).otherwise(lists))
    none = F.array().cast(f"array<{_NODE}>")

    def shape_of(held: Column, place: Column, v: Column) -> Column:
        first = F.substring(held, 1, 1)
        known = F.when(v.isNull(), first).otherwise(F.substring(F.to_json(F.get(v, place)), 1, 1))
        return F.when(held.isNull(), "n").when(first.isin("[", "{") | held.isin("true", "false"), known).otherwise("s")

    def leaf(entries: Column) -> Column:
        held = F.try_element_at(entries, F.lit("value"))
        links = F.filter(F.array(*[F.try_element_at(entries, F.lit(k)) for k in ("hyperlink_target", "hyperlink_location")]), lambda u: F.coalesce(u != "", F.lit(False)))
        place = F.array_position(F.map_keys(entries), "value").cast("int") - 1
        shape = F.when(held.isin("true", "false"), text.bound(variants, lambda v: shape_of(held, place, v))).otherwise("s")
        return F.array(_node(node["key"], held, shape, links))

    def fields(entries: Column) -> Column:
        def child(v: Column) -> Column:
            def made(e: Column, i: Column) -> Column:
                key = F.when(node["key"] == "", e["key"]).otherwise(F.concat_ws(".", node["key"], e["key"]))
                return F.when(e["key"] != "_meta", _node(key, e["value"], shape_of(e["value"], i, v)))

            made_all = F.transform(F.map_entries(entries), made)
            return F.when(F.map_contains_key(entries, F.lit("_meta")), F.filter(made_all, lambda n: n.isNotNull())).otherwise(made_all)

        return F.when(F.map_contains_key(entries, F.lit("value")), leaf(entries)).otherwise(text.bound(variants, child))

    def items(v: Column) -> Column:
        def made(x: Column, i: Column) -> Column:
            return _node(F.concat(node["key"], F.lit("["), i.cast("string"), F.lit("]")), x, shape_of(x, i, v))

        return F.transform(F.from_json(body, "array<string>"), made)

    opened = F.when(is_object, text.bound(F.from_json(body, "map<string,string>"), fields)).otherwise(text.bound(variants, items))
    return F.coalesce(opened, none)


def _open(nodes: Column) -> Column:
    """The nodes in order, each container that is no leaf replaced by the nodes inside."""

    def opened(held: Column) -> Column:
        inside = F.flatten(F.transform(held, lambda n: F.when(_is_open(n), _inside(n)).otherwise(F.array(n))))
        return F.when(F.exists(held, _is_open), inside).otherwise(held)

    return text.bound(nodes, opened)


def _leaf(node: Column) -> Column:
    held = F.when(node["shape"].isin("t", "f"), F.initcap(node["text"])).otherwise(F.coalesce(node["text"], F.lit("")))
    return F.struct(node["key"].alias("key"), text.plain_once(held).alias("value"), F.coalesce(node["links"], F.array().cast("array<string>")).alias("links"))


def flatten_json(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """Leaves of JSON texts of unknown depth as ``(row_id, pos, key, value, links)`` rows; ``pos`` counts the leaves of a text.

    A text stays one row until its leaves are known: ``LEVELS`` levels are opened in a pass and written once; passes go on with the
    texts that are not open yet. ``_meta`` is skipped; an object with a ``value`` is a leaf, with its hyperlinks; a container as
    such a value stays JSON. Texts that are null, blank or no JSON (a repeated key included) have no leaves; blank values drop out;
    rows with equal ids count as one text's leaves.
    """
    # the first value stays a column of its own, as it is read several times
    rows = df.select(F.col(id_column).cast("bigint").alias("row_id"), F.col(json_column).alias("text"))
    raw, none = F.col("text"), F.array().cast(f"array<{_NODE}>")

    def top(first: Column) -> Column:
        scalar = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0))
        alone = _node(F.lit(""), scalar, F.substring(F.to_json(F.try_parse_json(raw)), 1, 1))
        return F.when(F.try_parse_json(raw).isNull(), none).when(first.isin("{", "["), F.array(_node(F.lit(""), raw, first))).otherwise(F.array(alone))

    left, leaves = rows.select("row_id", text.bound(F.substring(F.ltrim(raw, F.lit(text.SPACE)), 1, 1), top).alias("nodes")), None
    while True:
        nodes = F.col("nodes")
        for _ in range(LEVELS):
            nodes = _open(nodes)

        def settled(n: Column) -> Column:
            more = F.exists(n, _is_open)
            return F.struct(F.when(more, n).alias("nodes"), F.when(~more, F.transform(n, _leaf)).alias("leaves"))

        level = materialize(left.select("row_id", text.bound(nodes, settled).alias("x")).select("row_id", "x.nodes", "x.leaves"))
        done = level.where("leaves IS NOT NULL").select("row_id", "leaves")
        leaves = done if leaves is None else leaves.unionByName(done)
        left = level.where("nodes IS NOT NULL").select("row_id", "nodes")
        if left.isEmpty():
            break
    shared = materialize(leaves.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("row_id").alias("shared_id")))
    columns = ["row_id", "pos", "x.key", "x.value", "x.links"]
    if shared.isEmpty():
        flat = leaves.select("row_id", F.posexplode("leaves").alias("pos", "x"))
    else:
        same = F.col("row_id").eqNullSafe(F.col("shared_id"))
        alone = leaves.join(shared, same, "left_anti").select("row_id", F.posexplode("leaves").alias("pos", "x"))
        mixed = leaves.join(shared, same, "left_semi").select("row_id", F.posexplode("leaves").alias("at", "x"))
        numbered = mixed.withColumn("pos", F.row_number().over(Window.partitionBy("row_id").orderBy("at", "x")) - 1)
        flat = alone.unionByName(numbered.select("row_id", "pos", "x"))
    return flat.select(*columns).withColumn("pos", F.col("pos").cast("bigint")).where("value <> ''")


def raw_sections(flat: DataFrame) -> DataFrame:
    """Typed sections of flattened import rows; blocked and untyped keys drop out."""
    typed = text.bound(text.normalise_key("key"), lambda k: F.struct(_typed(k).alias("section_type"), F.initcap(k).alias("title")))
    # exploded, so that the filter below doesn't type each key once more
    rows = flat.select("row_id", "pos", F.explode_outer(F.array(typed)).alias("x"), F.col("value").alias("content"))
    return rows.where("x.section_type IS NOT NULL").select("row_id", "pos", "x.section_type", "x.title", "content")


#: fixed values: a service's own fields as sections, in order
OWN_SECTIONS = (
    ("OVERVIEW", "Overview", "overview"), ("BENEFITS", "Benefits", "benefits"), ("ELIGIBILITY", "Eligibility", "eligibility_summary"),
    ("NOTES", "Restrictions", "restrictions"), ("NOTES", "Important Notes", "important_notes"), ("FUNDING", "Subsidy Details", "subsidy_details"),
)
#: order of a candidate within its service: own fields, then import rows by sheet and row
SOURCE_ORDER = ["is_row", "sheet_name", "row_no", "import_row_id", "pos"]


def linked_rows(rows: DataFrame, services: DataFrame) -> DataFrame:
    """``(service_id, import_row_id, sheet_name, row_no)``: import rows of the given services, by the service they were imported to
    or matched with, each once."""
    both = F.array_distinct(F.array_compact(F.array("imported_service_id", "matched_service_id")))
    x = rows.select(F.col("id").alias("import_row_id"), "sheet_name", "row_no", F.explode(both).alias("service_id"))
    return x.join(services.select(F.col("id").alias("service_id")), "service_id", "left_semi")


def _of_linked(flat: DataFrame, linked: DataFrame) -> DataFrame:
    """Leaves of linked import rows; keys are typed for these only."""
    return flat.join(linked.select(F.col("import_row_id").alias("row_id")), "row_id", "left_semi")


def source_sections(services: DataFrame, rows: DataFrame, flat: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Candidate sections of published services from their own fields and their linked import rows' raw texts.

    ``rows`` is ``(id, sheet_name, row_no, imported_service_id, matched_service_id)``, ``flat`` their flattened texts. Each
    (service, type, text) comes once, compared without case and spacing. ``linked`` is their ``linked_rows``, where these are at hand.
    """
    shown = services.where("status = 'PUBLISHED'")
    own = F.explode(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(kind).alias("section_type"), F.lit(title).alias("title"), text.blank(c).alias("content"))
        for i, (kind, title, c) in enumerate(OWN_SECTIONS)]))
    direct = shown.select(F.col("id").alias("service_id"), own.alias("x")).select("service_id", "x.*").withColumns(
        {"is_row": F.lit(0), "sheet_name": F.lit(""), "row_no": F.lit(0).cast("bigint"), "import_row_id": F.lit(None).cast("bigint")})
    linked = materialize(linked_rows(rows, shown)) if linked is None else linked
    raw = raw_sections(_of_linked(flat, linked)).withColumnRenamed("row_id", "import_row_id").join(linked, "import_row_id").withColumn("is_row", F.lit(1))
    columns = ["service_id", *SOURCE_ORDER, "section_type", "title", "content"]
    return dedupe_sections(direct.select(columns).unionByName(raw.withColumn("row_no", F.col("row_no").cast("bigint")).select(columns)), SOURCE_ORDER)


def source_items(sections: DataFrame, kind: str) -> DataFrame:
    """List items of the candidate sections of one type, in order: ``(service_id, SOURCE_ORDER, item_pos, item)``."""
    rows = sections.where(F.col("section_type") == kind)
    return rows.select("service_id", *SOURCE_ORDER, F.posexplode(text.split_items("content")).alias("item_pos", "item"))


def _numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers per group; a block is an import row, so the rows of a service are numbered in several tasks."""
    return group_row_number(rows, keys, F.struct(*order[:4]), order[4:], name)


def apply_source(sections: DataFrame, content: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """Rows that candidate sections add to ``content`` ``(service_id, section_type, content)`` and ``rules`` ``(service_id, text)``.

    Commercial sections are never published. Sections are numbered by type, those that exist already included. An eligibility
    item stays information until it is typed; its number goes on after the rules that the service has.
    """
    placed = _numbered(sections.where("section_type <> 'COMMERCIAL'"), ["service_id", "section_type"], SOURCE_ORDER, "display_order")
    mark = lambda df, *cols: df.select("service_id", *cols).distinct()
    have = mark(content.withColumn("content", text.strip(F.col("content"))), "section_type", "content")
    new = placed.join(have, ["service_id", "section_type", "content"], "left_anti").select(
        "service_id", "section_type", "title", "content", "display_order", "import_row_id", F.lit("BDE").alias("visibility"))
    items = source_items(sections, "ELIGIBILITY").where("item <> ''")
    first = best_per_group(items, ["service_id", "item"], [*SOURCE_ORDER, "item_pos"])
    unknown = first.join(mark(rules.withColumn("item", text.strip(F.col("text"))), "item"), ["service_id", "item"], "left_anti")
    count = rules.groupBy("service_id").agg(F.count(F.lit(1)).alias("n"))
    numbered = _numbered(unknown, ["service_id"], [*SOURCE_ORDER, "item_pos"], "k").join(count, "service_id", "left")
    added = numbered.select("service_id", F.lit("INFORMATION").alias("rule_type"), F.lit("Eligibility information").alias("title"), F.col("item").alias("text"),
                            (F.coalesce("n", F.lit(0)) + F.col("k")).alias("display_order"))
    return {"content": new, "rules": added}


def plan_report(services: DataFrame, rows: DataFrame, flat: DataFrame, existing: dict[str, DataFrame]) -> DataFrame:
    """The plan of published services as counts ``(part, service_id, n)``: candidates by kind, what exists in each child table,
    linked rows and their evidence (values under keys that aren't blocked), and the total of every part, with a NULL service."""
    shown = services.where("status = 'PUBLISHED'").select(F.col("id").alias("service_id"))
    linked = materialize(linked_rows(rows, services.where("status = 'PUBLISHED'")))
    flat = materialize(_of_linked(flat, linked))
    sections = materialize(source_sections(services, rows, flat, linked))
    # the values of a row lie together, so they are counted before the shuffle
    values = flat.where(~blocked_key("key")).groupBy(F.col("row_id").alias("import_row_id")).agg(F.count(F.lit(1)).alias("values"))
    evidence = values.join(linked, "import_row_id")
    parts = {"sections": sections, "linked_import_rows": linked, "evidence": evidence}
    parts |= {f"{n}_candidates": source_items(sections, k) for n, k in (("eligibility", "ELIGIBILITY"), ("document", "DOCUMENTS"), ("process", "PROCESS"))}
    parts |= {f"existing_{n}": df.join(shown, "service_id", "left_semi") for n, df in existing.items()}
    out = None
    for name, df in parts.items():
        counted = F.sum("values") if name == "evidence" else F.count(F.lit(1))
        part = df.groupBy("service_id").agg(counted.alias("n")).select(F.lit(name).alias("part"), "service_id", "n")
        out = part if out is None else out.unionByName(part)
    both = [["part", "service_id"], ["part"]]
    return out.groupingSets([[F.col(c) for c in g] for g in both], F.col("part"), F.col("service_id")).agg(F.sum("n").alias("n"))


def dedupe_sections(sections: DataFrame, order: list[str]) -> DataFrame:
    """First section of each (service, type, text), compared without case and spacing."""
    kept = sections.withColumn("content", text.plain("content")).where("content <> ''")
    tagged = kept.withColumn("fingerprint", F.sha2(text.normalize_ws("content"), 256))
    return best_per_group(tagged, ["service_id", "section_type", "fingerprint"], order).drop("fingerprint")


def section_items(sections: DataFrame, strict: bool = False) -> DataFrame:
    """List items of sections, numbered per service and type across its sections.

    ``sections`` is ``(service_id, id, section_type, content)``.
    """
    split = text.split_items_strict if strict else text.split_items
    items = sections.select("service_id", "id", "section_type", F.posexplode(split("content")).alias("pos", "item"))
    return group_row_number(items, ["service_id", "section_type"], F.floor(F.col("id") / 100_000), ["id", "pos"], "item_no")


def carried_heading(sections: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """Each section with the last heading of its (service, type) at or before it."""
    return carry_forward(
        sections, ["service_id", "section_type"], F.floor(F.col("id") / block_rows), ["id"], "heading", "carried"
    )


def resolve_section_service(sections: DataFrame, rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Service of a section: own, its import row's, its document's, the document's import row's."""
    r = rows.select(F.col("id").alias("rid"), F.coalesce("imported_service_id", "matched_service_id").alias("row_service"))
    own_row = r.select(F.col("rid").alias("import_row_id"), F.col("row_service").alias("s2"))
    doc = documents.join(r, F.col("import_row_id") == F.col("rid"), "left").select(
        F.col("id").alias("document_id"), F.col("service_id").alias("s3"), F.col("row_service").alias("s4"))
    out = sections.join(own_row, "import_row_id", "left").join(doc, "document_id", "left")
    s1 = F.col("service_id")
    method = (
        F.when(s1.isNotNull(), "DIRECT_SERVICE").when(F.col("s2").isNotNull(), "SOURCE_IMPORT_ROW")
        .when(F.col("s3").isNotNull(), "DOCUMENT_SERVICE").when(F.col("s4").isNotNull(), "DOCUMENT_IMPORT_ROW").otherwise("UNRESOLVED")
    )
    return out.withColumn("resolved_id", F.coalesce("service_id", "s2", "s3", "s4")).withColumn("method", method).drop("s2", "s3", "s4")


def missing_rows(new: DataFrame, existing: DataFrame, keys: list[str], value: str) -> DataFrame:
    """New rows whose normalised value does not exist yet under the same keys."""
    have = existing.select(*keys, F.sha2(text.normalize_text(value), 256).alias("fp")).distinct()
    return new.withColumn("fp", F.sha2(text.normalize_text(value), 256)).join(have, [*keys, "fp"], "left_anti").drop("fp")


def apply_knowledge(sections: DataFrame, content: DataFrame, rules: DataFrame, documents: DataFrame, steps: DataFrame) -> dict[str, DataFrame]:
    """Rows that a set of knowledge sections adds: content, rules, documents and process steps.

    ``sections`` is ``(id, service_id, section_type, heading, content)``; existing tables are
    ``(service_id, text, seq)``. Sequence numbers continue after the existing ones.
    """
    titled = materialize(carried_heading(sections))
    bodies = titled.where("heading IS NULL OR heading <> content")

    def append(items: DataFrame, existing: DataFrame) -> DataFrame:
        new = missing_rows(items.withColumnRenamed("item", "text"), existing, ["service_id"], "text")
        top = existing.groupBy("service_id").agg(F.max("seq").alias("top"))
        numbered = group_row_number(new, ["service_id"], F.floor(F.col("id") / 100_000), ["id", "pos"], "n")
        return numbered.join(top, "service_id", "left").withColumn("seq", F.coalesce("top", F.lit(0)) + F.col("n")).drop("top", "n")

    def listed(kind: str) -> DataFrame:
        rows = bodies.where(F.col("section_type") == kind)
        parts = text.split_items_strict("content")
        whole = F.when(F.size(parts) > 0, parts).otherwise(F.array(text.plain("content")))
        return rows.select("service_id", "id", "carried", F.posexplode(whole).alias("pos", "item"))

    all_content = titled.select("service_id", "id", F.lit(0).alias("pos"), F.col("content").alias("item"), "section_type", "carried")
    docs = append(listed("DOCUMENTS"), documents)
    return {
        "content": append(all_content, content),
        "rules": append(listed("ELIGIBILITY"), rules).withColumn("rule_type", rule_type("text")),
        "documents": docs.withColumn("is_mandatory", documents_required("carried", "text")),
        "steps": append(listed("PROCESS"), steps).withColumn("title", F.substring("text", 1, 180)),
    }


# --- completeness -----------------------------------------------------------------------------
COMPLETENESS = ("overview", "benefits", "eligibility", "documents", "process", "funding", "deadline", "source_link", "classification")


def completeness(services: DataFrame, sections: DataFrame, sources: DataFrame, classifications: DataFrame) -> DataFrame:
    """Nine checks per service, their score in percent and the missing ones."""
    kinds = ("ELIGIBILITY", "DOCUMENTS", "PROCESS", "FUNDING", "TIMELINE")
    flags = sections.groupBy("service_id").agg(*[F.max(F.col("section_type") == k).alias(k) for k in kinds])
    linked = sources.where("source_url <> ''").select("service_id", F.lit(True).alias("linked")).distinct()
    classed = classifications.select("service_id", F.lit(True).alias("classed")).distinct()
    s = services.withColumnRenamed("service_id", "code").withColumnRenamed("id", "service_id")
    for part in (flags, linked, classed):
        s = s.join(part, "service_id", "left")

    def filled(column: str) -> Column:
        return text.plain(column) != ""

    def flag(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(False))

    checks = [
        filled("overview"), filled("benefits"), filled("eligibility_summary") | flag("ELIGIBILITY"), flag("DOCUMENTS"), flag("PROCESS"),
        filled("funding_type") | filled("funding_organisation") | flag("FUNDING"),
        F.col("application_deadline").isNotNull() | filled("application_deadline_raw") | flag("TIMELINE"),
        flag("linked"), flag("classed"),
    ]
    missing = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in zip(COMPLETENESS, checks)]))
    return s.select("service_id", missing.alias("missing")).withColumn(
        "score", F.round((len(COMPLETENESS) - F.size("missing")) / len(COMPLETENESS) * 100, 1)
    )


def missing_counts(scores: DataFrame) -> DataFrame:
    return scores.select(F.explode("missing").alias("check")).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def intelligence_plan(services: DataFrame, sections: DataFrame, sources: DataFrame, classifications: DataFrame) -> DataFrame:
    """Per published service: completeness and how many sections and items each type offers."""
    shown = services.where("status = 'PUBLISHED'")
    unique = dedupe_sections(sections, ["id"])
    items = section_items(unique).groupBy("service_id").agg(
        *[F.count_if(F.col("section_type") == k).alias(n) for k, n in (("ELIGIBILITY", "eligibility_items"), ("DOCUMENTS", "document_items"), ("PROCESS", "process_items"))])
    counts = unique.groupBy("service_id").agg(F.count(F.lit(1)).alias("n_sections"))
    scores = completeness(shown, sections, sources, classifications)
    return scores.join(counts, "service_id", "left").join(items, "service_id", "left").fillna(0)


def verbatim(services: DataFrame, sections: DataFrame) -> DataFrame:
    """Benefits, focus sectors and eligibility wording per service, as ordered tall parts.

    ``(service_id, part, ord, content)`` with each distinct text once; a part without sections
    falls back to the service's own columns.
    """
    title = F.regexp_replace(F.lower(F.trim(text.blank("title"))), r"^fields[.:]\s*", "")
    kind = F.upper(F.trim(text.blank("section_type")))
    parts = F.array_compact(F.array(
        F.when((kind == "BENEFITS") | title.isin("benefit", "benefits"), F.lit("benefits")),
        F.when(F.contains(title, F.lit("focus sector")) | title.isin("sector", "sectors"), F.lit("focus_sectors")),
        F.when((kind == "ELIGIBILITY") | title.isin("eligibility", "eligibility criteria", "eligibility criterion"), F.lit("eligibility")),
    ))
    rows = sections.where(text.strip(text.blank("content")) != "").select("service_id", F.explode(parts).alias("part"), F.col("id").alias("ord"), "content")
    first = rows.withColumn("fp", F.sha2("content", 256)).groupBy("service_id", "part", "fp").agg(F.min("ord").alias("ord"), F.first("content").alias("content")).drop("fp")
    have = first.select("service_id", "part").distinct()
    sector = F.array_join(text.clean_list("industries"), "\n")
    elig = F.when(F.trim("eligibility_summary") != "", F.col("eligibility_summary")).otherwise(F.col("applicable_for_raw"))
    own = services.select(F.col("id").alias("service_id"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("part"), text.blank(c).alias("content")) for n, c in (("benefits", "benefits"), ("focus_sectors", sector), ("eligibility", elig))
    ])).alias("x")).select("service_id", "x.part", F.lit(-1).cast("bigint").alias("ord"), "x.content").where(F.trim("content") != "")
    fallback = own.join(have, ["service_id", "part"], "left_anti")
    return first.unionByName(fallback).withColumn("content", text.list_layout("content"))
