"""What an import would change: incoming candidates against the catalogue's own wording.

Existing texts stay tall: ``(service_id, bucket, norm)``. Text containment inside a service is an equi-join on the rarest
feature that a contained text and its container must share, so a service with very many texts is no single group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..session import BROADCAST_ROWS, materialize, spread

# --- fixed values: field routing ---------------------------------------------------------------
CORE_BUCKETS = {
    "benefits": ("benefits",),
    "eligibility": ("eligibility_summary", "applicable_for_raw"),
    "applicable_for": ("applicable_for_raw",),
    "deadline": ("application_deadline_raw", "estimated_processing_time"),
    "funding_organisation": ("funding_organisation",),
    "funding_type": ("funding_type",),
    "scheme_type": ("funding_type",),
    "focus_sectors": ("industries",),
    "additional_info": ("important_notes", "internal_notes"),
    "commercial_remark": ("pricing_notes", "important_notes"),
}
CHILD_BUCKETS = {
    "benefits": ("content",),
    "eligibility": ("rules", "content"),
    "applicable_for": ("rules", "content"),
    "deadline": ("content",),
    "funding_organisation": ("content",),
    "funding_type": ("content",),
    "scheme_type": ("content",),
    "focus_sectors": ("content",),
    "minimum_charge": ("commercial",),
    "government_charge": ("commercial",),
    "government_fee": ("commercial",),
    "vendor_cost": ("commercial",),
    "bdm_deduction": ("commercial",),
    "commercial_remark": ("commercial", "content"),
}
SECTION_BUCKETS = {
    "ELIGIBILITY": ("rules", "content"),
    "PROCESS": ("steps", "content"),
    "DOCUMENTS": ("documents", "content"),
    "COMMERCIAL": ("commercial", "content"),
    "BENEFITS": ("content",),
    "FUNDING": ("content",),
    "SCOPE": ("content",),
    "TIMELINE": ("content",),
    "NOTES": ("content",),
    "OVERVIEW": ("content",),
    "OTHER": ("content",),
}
URL_FIELDS = ("portal_link", "flyer", "application_link", "official_link", "reference_link")
SOURCE_KINDS = {
    "portal_link": ("APPLICATION", "OFFICIAL_PORTAL"),
    "application_link": ("APPLICATION",),
    "official_link": ("OFFICIAL_PORTAL",),
    "flyer": ("FLYER",),
    "reference_link": ("REFERENCE",),
    "additional_info": ("REFERENCE",),
}
TITLE_FIELDS = ("scheme_name", "service_name", "title")
PLAIN_HEADINGS = (
    "benefits",
    "eligibility",
    "documents",
    "documents required",
    "commercials",
    "commercial",
    "please note",
    "process",
    "scope of work",
    "descriptive scope of work",
)
CONTAIN_LENGTH, CONTAIN_RATIO = 12, 0.80


def snapshot_texts(services: DataFrame, core: list[str], children: dict[str, DataFrame]) -> DataFrame:
    """Distinct ``(service_id, bucket, norm)``: own columns by name, child tables by bucket name.

    Each child frame is ``(service_id, text)``.
    """
    own = services.select(
        F.col("id").alias("service_id"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("bucket"), text.normalize_text(c).alias("norm")) for c in core])).alias("x"),
    ).select("service_id", "x.bucket", "x.norm")
    for bucket, frame in children.items():
        own = own.unionByName(frame.select("service_id", F.lit(bucket).alias("bucket"), text.normalize_text("text").alias("norm")))
    return own.where("norm <> ''").distinct()


def snapshot_urls(sources: DataFrame) -> DataFrame:
    """Distinct ``(service_id, url, source_kind)`` with normalised URLs."""
    return sources.select("service_id", urls.normalize_url("source_url").alias("url"), "source_kind").where("url <> ''").distinct()


def text_exists(needle: Column, existing: Column) -> Column:
    """Pairwise test: equal, or contained when long enough."""
    inside = (F.length(needle) >= CONTAIN_LENGTH) & F.contains(existing, needle)
    around = (
        (F.length(existing) >= CONTAIN_LENGTH) & F.contains(needle, existing)
        & (F.length(existing) / F.greatest(F.length(needle), F.lit(1)) >= CONTAIN_RATIO)
    )
    return (needle == existing) | inside | around


#: pieces of words that stand for texts of one or two words
EDGE, GRAM = 3, 6
#: rows of one (keys, feature) that a task meets; features of more rows are split
HEAVY_ROWS = 20_000
#: so few possible containers of a key are all compared
FEW_TEXTS = 4


def _pairs(first: Column, second: Column, key: Column, kind: str, p: int | None = None, q: int | None = None) -> Column:
    """Hashes of neighbouring words, whole or cut to the last ``p`` and first ``q`` characters."""
    if p is None:
        return F.zip_with(first, second, lambda x, y: F.xxhash64(key, F.lit(kind), x, y))
    cut = F.zip_with(first, second, lambda x, y: F.when(
        (F.length(x) >= p) & (F.length(y) >= q), F.xxhash64(key, F.lit(kind), F.right(x, F.lit(p)), F.left(y, F.lit(q)))))
    return F.array_compact(cut)


def _kinds(texts: DataFrame) -> list[tuple]:
    """Kinds of features that the contained texts need: at most 1 + 1 + EDGE * EDGE + 1."""
    n = F.size("words")
    edge = [F.least(F.length(F.get("words", F.lit(i))), F.lit(EDGE)) for i in (0, 1)]

    def named(kind: str, p: Column | None = None, q: Column | None = None) -> Column:
        none = F.lit(0)
        return F.struct(F.lit(kind).alias("kind"), (none if p is None else p).alias("p"), (none if q is None else q).alias("q"))

    kind = F.when(n >= 4, named("b")).when(n == 3, named("w")).when(n == 2, named("p", *edge)).otherwise(named("g"))
    return sorted(tuple(r["k"]) for r in texts.where(F.col("size") >= CONTAIN_LENGTH).select(kind.alias("k")).distinct().collect())


def _contained_features(texts: DataFrame) -> DataFrame:
    """``(small_id, small_size, h)``: what every text that contains this one must show too.

    Between the first and the last word of a contained text words stand as they are: from four words on each
    pair of neighbours among them is a feature, with three words the middle one is. Of two words the end of the first and the
    start of the second are kept, of a single long word its first letters.
    """
    n, w, key = F.size("words"), F.col("words"), F.col("key")
    inner = _pairs(F.slice(w, 2, F.greatest(n - 3, F.lit(0))), F.slice(w, 3, F.greatest(n - 3, F.lit(0))), key, "b")
    edge = F.xxhash64(key, F.lit("p"), F.right(F.get(w, F.lit(0)), F.lit(EDGE)), F.left(F.get(w, F.lit(1)), F.lit(EDGE)))
    h = F.when(n >= 4, F.array_distinct(inner)).when(n == 3, F.array(F.xxhash64(key, F.lit("w"), F.get(w, F.lit(1))))).when(
        n == 2, F.array(edge)).otherwise(F.array(F.xxhash64(key, F.lit("g"), F.left(F.get(w, F.lit(0)), F.lit(GRAM)))))
    return texts.where(F.col("size") >= CONTAIN_LENGTH).select(F.col("id").alias("small_id"), F.col("size").alias("small_size"), F.explode(h).alias("h"))


def _shown_features(texts: DataFrame, kinds: list[tuple]) -> DataFrame:
    """``(big_id, big_size, h)``: all features of the given kinds in a text, each once."""
    n, w, key = F.size("words"), F.col("words"), F.col("key")
    first, second = F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0)))
    parts = []
    for kind, p, q in kinds:
        if kind == "b":
            parts.append(_pairs(first, second, key, "b"))
        elif kind == "w":
            parts.append(F.transform(w, lambda x: F.xxhash64(key, F.lit("w"), x)))
        elif kind == "p":
            parts.append(_pairs(first, second, key, "p", p, q))
        else:
            starts = lambda x: F.sequence(F.lit(1), F.length(x) - GRAM + 1)
            long = F.filter(w, lambda x: F.length(x) >= CONTAIN_LENGTH)
            parts.append(F.flatten(F.transform(long, lambda x: F.transform(starts(x), lambda i: F.xxhash64(key, F.lit("g"), F.substring(x, i, F.lit(GRAM)))))))
    return texts.select(F.col("id").alias("big_id"), F.col("size").alias("big_size"), F.explode(F.array_distinct(F.concat(*parts))).alias("h"))


def _containing_pairs(small: DataFrame, big: DataFrame, sizes: Column) -> DataFrame:
    """``(small_id, big_id)`` of texts ``(id, key, size, words)`` that may contain one another.

    A text is looked up by one feature only, the one that the fewest possible containers of its key show; a text with a
    feature that none shows is in none. Lookups of a feature that many rows show are dealt over several tasks. Where a key has at most
    ``FEW_TEXTS`` possible containers, these are its pairs and no text is taken apart.
    """
    counted = materialize(big.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    few, many = counted.where(F.col("n") <= FEW_TEXTS).select("key"), counted.where(F.col("n") > FEW_TEXTS).select("key")
    left = small.where(F.col("size") >= CONTAIN_LENGTH).join(few, "key", "left_semi").select("key", F.col("id").alias("small_id"), F.col("size").alias("small_size"))
    right = big.join(few, "key", "left_semi").select("key", F.col("id").alias("big_id"), F.col("size").alias("big_size"))
    pairs = left.join(right, "key").where(sizes).select("small_id", "big_id")
    if many.limit(1).isEmpty():
        return pairs
    small, big = small.join(many, "key", "left_semi"), big.join(many, "key", "left_semi")
    kinds = _kinds(small)
    if not kinds:
        return pairs
    shown = _shown_features(big, kinds)
    counts = shown.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    wanted = _contained_features(small)
    # a text is open only while all its features are shown
    rare = wanted.join(counts, "h", "left").groupBy("small_id", "small_size").agg(
        F.min(F.struct("n", "h")).alias("x"), F.count_if(F.col("n").isNull()).alias("missing")).where("missing = 0")
    parts = F.ceil(F.col("x.n") / HEAVY_ROWS).cast("int")
    rare = materialize(rare.select("small_id", "small_size", F.col("x.h").alias("h"), parts.alias("parts")))
    heavy = rare.where("parts > 1").select("h", "parts").distinct()
    n_heavy = heavy.limit(BROADCAST_ROWS + 1).count()
    if n_heavy:
        heavy = F.broadcast(heavy) if n_heavy <= BROADCAST_ROWS else heavy
        shown = shown.join(heavy, "h", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("big_id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        rare = rare.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = rare.drop("parts").join(shown, ["h", "part"] if n_heavy else ["h"]).where(sizes)
    return pairs.unionByName(met.select("small_id", "big_id"))


def _in_reach(small: DataFrame, big: DataFrame, ratio: float | None) -> tuple[DataFrame, DataFrame]:
    """Rows that have a partner of fitting size under their key; compared by sizes alone, before any text is taken apart.

    Without a ratio a text fits into a longest one of its key. With a ratio both sizes lie in one step of that ratio or in
    neighbouring steps.
    """
    if ratio is None:
        most = big.groupBy("key").agg(F.max("size").alias("most"))
        least = small.where(F.col("size") >= CONTAIN_LENGTH).groupBy("key").agg(F.min("size").alias("least"))
        near_small = small.join(most, "key").where((F.col("size") <= F.col("most")) & (F.col("size") >= CONTAIN_LENGTH)).drop("most")
        return near_small, big.join(least, "key").where(F.col("size") >= F.col("least")).drop("least")
    step = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(ratio))).cast("int")
    small, big = small.where(F.col("size") >= CONTAIN_LENGTH).withColumn("step", step), big.withColumn("step", step)
    steps = lambda df, *more: df.select("key", F.explode(F.array(*[F.col("step") + i for i in (0, *more)])).alias("step")).distinct()
    # one more step on either side, for sizes at a step's border
    near_small = small.join(steps(big, -1, -2, 1), ["key", "step"], "left_semi").drop("step")
    return near_small, big.join(steps(small, 1, 2, -1), ["key", "step"], "left_semi").drop("step")


def _once(texts: DataFrame) -> DataFrame:
    """``texts`` with ``norm`` from a generator: a filter on it isn't moved below, where the text would be normalised again."""
    return texts.select(*[c for c in texts.columns if c != "norm"], F.explode(F.array("norm")).alias("norm"))


def existing_needles(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming ``(needle_id, keys, norm)`` rows whose text some existing ``(keys, norm)`` shows.

    Equal texts meet in an equi-join. Containment, either way, meets on one hashed feature of (keys, contained text); texts
    are fetched for these pairs only and compared in full. Blank texts count as shown; rows with a NULL key or text are not.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    same = [*keys, "norm"]
    facts = [*same, F.length("norm").alias("size"), F.xxhash64(*keys).alias("key")]
    # small texts, much work: dealt over all tasks by what the comparison of equal texts needs anyway
    b = spread(_once(existing.select(*same)).where(known & (F.col("norm") != "")), *same).distinct()
    b = materialize(b.select(*facts).withColumn("id", F.monotonically_increasing_id()))
    a = spread(_once(incoming.select("needle_id", *same)).where((F.col("norm") == "") | known & F.col("norm").isNotNull()), *same)
    shown = (F.col("norm") == "") | F.coalesce("equal", F.lit(False))
    a = a.join(b.select(*same, F.lit(True).alias("equal")), same, "left").select("needle_id", *facts, shown.alias("equal"))
    a = materialize(a.withColumn("id", F.monotonically_increasing_id()))
    rest = a.where("NOT equal")
    a_texts, b_texts = (x.select(F.col("id").alias(f"{n}_id"), F.struct(*keys).alias(f"{n}_keys"), F.col("norm").alias(n)) for x, n in ((rest, "needle"), (b, "body")))
    shown = None
    sizes = F.col("small_size") / F.col("big_size")
    for small, big, ratio, names in ((rest, b, None, ("needle", "body")), (b, rest, CONTAIN_RATIO, ("body", "needle"))):
        columns = ["id", "key", "size", F.split("norm", " ").alias("words")]
        small, big = (x.select(*columns) for x in _in_reach(small, big, ratio))
        pairs = _containing_pairs(small, big, (sizes <= 1) if ratio is None else (sizes <= 1) & (sizes >= ratio))
        part = pairs.select(F.col("small_id").alias(f"{names[0]}_id"), F.col("big_id").alias(f"{names[1]}_id"))
        shown = part if shown is None else shown.unionByName(part)
    full = shown.join(a_texts, "needle_id").join(b_texts, "body_id")
    hit = full.where((F.col("needle_keys") == F.col("body_keys")) & text_exists(F.col("needle"), F.col("body"))).select("needle_id").distinct()
    found = a.select("needle_id", F.col("id").alias("__id")).join(hit.withColumnRenamed("needle_id", "__id"), "__id", "left_semi").select("needle_id")
    return a.where("equal").select("needle_id").union(found).distinct()


def _bucket_table(spark, own: dict, child: dict | None = None) -> DataFrame:
    rows = [(f, b) for f, bs in own.items() for b in bs] + [(f, b) for f, bs in (child or {}).items() for b in bs]
    return spark.createDataFrame(rows, "field string, bucket string")


def structured_differences(fields: DataFrame, links: DataFrame, texts: DataFrame, known_urls: DataFrame) -> DataFrame:
    """Differences of table candidates.

    ``fields`` is ``(cand_id, service_id, field, value)``; ``links`` is ``(cand_id, service_id,
    field, url)`` from cell hyperlinks. Result: ``(cand_id, service_id, field, incoming, change_type)``.
    """
    spark = fields.sparkSession
    link = links.select("cand_id", "service_id", "field", urls.normalize_url("url").alias("url")).where("url <> ''")
    f = fields.where(~F.col("field").isin(*TITLE_FIELDS) & (F.trim(text.blank("value")) != "")).withColumn("url", urls.reference_url("value"))
    is_url_field = F.col("field").isin(*URL_FIELDS)
    shown = f.where(is_url_field & (F.col("url") != "")).join(link.select("cand_id", "field"), ["cand_id", "field"], "left_anti")
    urlish = shown.select("cand_id", "service_id", "field", "url").unionByName(link.select("cand_id", "service_id", "field", "url"))
    loose = f.where(~is_url_field & (F.col("url") != "")).select("cand_id", "service_id", "field", "url")
    have = known_urls.select("service_id", "url").distinct()
    kinds = spark.createDataFrame([(k, s) for k, ss in SOURCE_KINDS.items() for s in ss], "field string, source_kind string")
    same_kind = known_urls.select("service_id", "source_kind").distinct().join(F.broadcast(kinds), "source_kind").select(
        "service_id", "field", F.lit(True).alias("occupied")).distinct()
    new_urls = urlish.join(have, ["service_id", "url"], "left_anti").join(same_kind, ["service_id", "field"], "left")
    kind = F.when(F.col("occupied"), "CHANGED_INFORMATION").otherwise("SAFE_ADDITION")
    a = new_urls.select("cand_id", "service_id", "field", F.col("url").alias("incoming"), kind.alias("change_type"))
    b = loose.join(have, ["service_id", "url"], "left_anti").select(
        "cand_id", "service_id", "field", F.col("url").alias("incoming"), F.lit("SAFE_ADDITION").alias("change_type"))
    plain = f.where(~is_url_field & (F.col("url") == "")).select(
        F.struct("cand_id", "field").alias("needle_id"), "cand_id", "service_id", "field", "value", text.normalize_text("value").alias("norm"))
    table = _bucket_table(spark, CORE_BUCKETS, CHILD_BUCKETS)
    known_fields = sorted(set(CORE_BUCKETS) | set(CHILD_BUCKETS))
    have_buckets = texts.select("service_id", "bucket").distinct()
    # short values are dealt over the buckets of their field, so no text is copied for each field that may show it
    listed = F.col("field").isin(*known_fields)
    placed = plain.where(listed).join(F.broadcast(table), "field").unionByName(plain.where(~listed).join(have_buckets, "service_id"))
    shown_in = existing_needles(placed, texts, ["service_id", "bucket"]).union(plain.where("norm = ''").select("needle_id"))
    new = plain.join(shown_in, "needle_id", "left_anti")
    filled = placed.select("service_id", "field", "bucket").join(have_buckets, ["service_id", "bucket"], "left_semi").select(
        "service_id", "field", F.lit(True).alias("occupied")).distinct()
    c = new.join(filled, ["service_id", "field"], "left").select(
        "cand_id", "service_id", "field", F.col("value").alias("incoming"), kind.alias("change_type"))
    return a.unionByName(b).unionByName(c)


def narrative_differences(sections: DataFrame, texts: DataFrame, known_urls: DataFrame) -> DataFrame:
    """Differences of narrative candidates.

    ``sections`` is ``(cand_id, service_id, source_row, source_column, section_type, content, is_heading, url)``.
    """
    s = sections.withColumns({"norm": text.normalize_text("content"), "url": urls.normalize_url("url")})
    s = s.where((F.trim("content") != "") & ~(F.col("is_heading") & F.col("norm").isin(*PLAIN_HEADINGS)))
    s = s.withColumn("needle_id", F.struct("cand_id", "source_row", "source_column"))
    have = known_urls.select("service_id", "url", F.lit(True).alias("url_known")).distinct()
    s = s.join(have, ["service_id", "url"], "left").withColumn("url_new", (F.col("url") != "") & F.col("url_known").isNull())
    s = materialize(s)  # compared twice below
    shown = existing_needles(s, texts.select("service_id", "norm"), ["service_id"]).withColumn("shown", F.lit(True))
    s = s.join(shown, "needle_id", "left").where(F.col("shown").isNull() | F.col("url_new"))
    table = _bucket_table(s.sparkSession, SECTION_BUCKETS).withColumnRenamed("field", "section_type")
    have_buckets = texts.select("service_id", "bucket").distinct()
    filled = have_buckets.join(F.broadcast(table), "bucket").select("service_id", "section_type", F.lit(True).alias("own_filled")).distinct()
    any_text = texts.select("service_id", F.lit(True).alias("any_filled")).distinct()
    s = s.join(filled, ["service_id", "section_type"], "left").join(any_text, "service_id", "left")
    # an empty bucket falls back to every text of the service, where the text is already missing
    # sections are dealt over the one or two buckets of their type; the texts stand once, not once a type
    placed = s.where("own_filled").join(F.broadcast(table), "section_type")
    in_own = existing_needles(placed, texts, ["service_id", "bucket"]).withColumn("in_own", F.lit(True))
    s = s.join(in_own, "needle_id", "left")
    gone = F.coalesce("in_own", F.lit(False)) | (F.col("own_filled").isNull() & F.col("shown").isNotNull())
    a = s.where(~gone).select(
        "cand_id", "service_id", F.concat(F.lit("section:"), "section_type").alias("field"), F.col("content").alias("incoming"), "source_row",
        F.when(F.col("any_filled"), "CHANGED_INFORMATION").otherwise("SAFE_ADDITION").alias("change_type"))
    any_url = known_urls.select("service_id", F.lit(True).alias("any_url")).distinct()
    b = s.where("url_new").where(~gone).join(any_url, "service_id", "left").select(
        "cand_id", "service_id", F.concat(F.lit("link:"), "section_type").alias("field"), F.col("url").alias("incoming"), "source_row",
        F.when(F.col("any_url"), "CHANGED_INFORMATION").otherwise("SAFE_ADDITION").alias("change_type"))
    return a.unionByName(b)


def candidate_status(candidates: DataFrame, differences: DataFrame, services: DataFrame) -> DataFrame:
    """Delta status per ``(cand_id, action, matched_service_id)`` candidate."""
    d = differences.groupBy("cand_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("change_type") == "CHANGED_INFORMATION").alias("n_changed"))
    known = services.select(F.col("id").alias("matched_service_id"), F.lit(True).alias("known"))
    status = (
        F.when(F.col("action").isin("INVALID", "MERGE_REVIEW"), "CONFLICT")
        .when((F.col("action") == "CREATE") | F.col("matched_service_id").isNull(), "NEW_SERVICE")
        .when(F.col("known").isNull(), "CONFLICT")
        .when(F.coalesce("n", F.lit(0)) == 0, "NO_CHANGE")
        .when(F.col("n_changed") > 0, "CHANGED_INFORMATION")
        .otherwise("SAFE_ADDITION")
    )
    return candidates.join(d, "cand_id", "left").join(known, "matched_service_id", "left").withColumn("delta_status", status).drop("n", "n_changed", "known")


def not_imported(files: DataFrame, batches: DataFrame) -> DataFrame:
    """Files whose content was not imported before."""
    done = batches.where("status = 'IMPORTED'").select(F.col("file_sha256").alias("sha256")).distinct()
    return files.join(done, "sha256", "left_anti")
