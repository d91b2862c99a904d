"""Batch concept search: many queries against the whole catalogue.

Substring search is made an equi-join. A text needle contains an anchor, its longest word, and
the anchor can only lie inside one white-space-free word of a text. So the distinct words of all
texts are matched with the anchors on a shared letter gram, and only texts holding one of the
hit words are compared in full. The texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.money import amount_variants, amounts_in_lakh
from ..functions.search_terms import (
    CONCEPT_VARIANTS,
    PHRASE_TO_CONCEPT,
    POINTS,
    QUERY_AMOUNT,
    SEARCH_STOPWORDS,
    SPECIFIC_FINANCE,
    TOKEN_TO_CONCEPT,
)
from ..session import by_key, gather, materialize, spread

#: never part of a query, so joined fields cannot match across their border
FIELD_BREAK = "\u0001"
OWN_TEXT = [
    "sales_pitch", "subsidy_details", "funding_type", "service_kind", "application_deadline_raw",
    "funding_organisation", "applicable_for_raw", "eligibility_summary", "benefits", "overview", "bde_summary",
    "title", "service_id", "category_name", "domain_name",
]
RANK_TEXT = [
    "title", "service_id", "bde_summary", "overview", "benefits", "eligibility_summary", "applicable_for_raw",
    "funding_organisation", "funding_type", "subsidy_details", "sales_pitch", "restrictions", "important_notes",
]


def _literal_map(table: dict) -> Column:
    cells = []
    for key, value in table.items():
        cells += [F.lit(key), F.array(*[F.lit(v) for v in value]) if isinstance(value, tuple) else F.lit(value)]
    return F.create_map(*cells)


def query_groups(queries: DataFrame) -> DataFrame:
    """Concept groups of each query: ``(query, grp, variants)``.

    Phrases come first and consume their words; amounts and the remaining words follow.
    """
    q = text.normalize_query("query")
    by_length = sorted(PHRASE_TO_CONCEPT, key=len, reverse=True)
    present = F.array_compact(F.array(*[F.when(text.phrase_present(q, p), F.lit(p)) for p in by_length]))
    step = queries.select("query", q.alias("q")).withColumn("phrases", present)
    used = F.flatten(F.transform("phrases", text.tokens))
    words = F.filter(
        F.array_except(text.tokens("q"), used),
        lambda t: (F.length(t) >= 3) & ~F.regexp_like(t, F.lit("^[0-9]+$")) & ~t.isin(*sorted(SEARCH_STOPWORDS)),
    )
    numbers = F.regexp_extract_all("q", F.lit(QUERY_AMOUNT), 1)
    units = F.transform(
        F.regexp_extract_all("q", F.lit(QUERY_AMOUNT), 2),
        lambda u: F.when(u.startswith("cr"), F.lit("crore")).otherwise(F.lit("lakh")),
    )
    phrase_map, token_map, variant_map = (
        _literal_map(PHRASE_TO_CONCEPT), _literal_map(TOKEN_TO_CONCEPT), _literal_map(CONCEPT_VARIANTS)
    )
    keys = F.concat(
        F.transform("phrases", lambda p: F.try_element_at(phrase_map, p)),
        F.zip_with(numbers, units, lambda n, u: F.concat(F.lit("amount:"), n, F.lit(":"), u)),
        F.transform(words, lambda t: F.coalesce(F.try_element_at(token_map, t), F.concat(F.lit("literal:"), t))),
    )
    step = step.select("query", F.array_distinct(keys).alias("keys"))
    specific = F.arrays_overlap("keys", F.array(*[F.lit(c) for c in SPECIFIC_FINANCE]))
    kept = F.when(specific, F.filter("keys", lambda k: k != "funding")).otherwise(F.col("keys"))
    out = step.select("query", F.explode(kept).alias("grp"))
    parts = F.split("grp", ":")
    variants = (
        F.when(F.col("grp").startswith("amount:"), amount_variants(F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))))
        .when(F.col("grp").startswith("literal:"), F.array(F.try_element_at(parts, F.lit(2))))
        .otherwise(F.try_element_at(variant_map, F.col("grp")))
    )
    return out.withColumn("variants", variants)


def catalogue_text(
    services: DataFrame, classifications: DataFrame, categories: DataFrame, knowledge: list[DataFrame]
) -> DataFrame:
    """Searchable text ``(service_id, sector, text)`` in lower case.

    ``services`` is the enriched catalogue; each knowledge frame is ``(service_id, text)`` after
    its visibility filter. ``sector`` rows hold the joined industries, which match by terms.
    """
    pk = F.col("id").alias("service_id")
    own = services.select(pk, F.lit(False).alias("sector"), F.lower(F.concat_ws(FIELD_BREAK, *OWN_TEXT)).alias("text"))
    names = classifications.join(
        categories.select(F.col("id").alias("category_id"), F.lower("name").alias("text")), "category_id"
    ).select("service_id", F.lit(False).alias("sector"), "text")
    sector = services.select(pk, F.lit(True).alias("sector"), text.sector_text("industries").alias("text"))
    out = own.unionByName(names).unionByName(sector)
    for frame in knowledge:
        out = out.unionByName(frame.select("service_id", F.lit(False).alias("sector"), F.lower("text").alias("text")))
    return out.where("text <> ''")


def knowledge_text(children: DataFrame, columns: list[str], visible: Column | None = None) -> DataFrame:
    rows = children if visible is None else children.where(visible)
    return rows.select("service_id", F.concat_ws(FIELD_BREAK, *columns).alias("text"))


def _words(value: Column) -> Column:
    return F.filter(F.array_distinct(F.split(value, rf"[\s{FIELD_BREAK}]+")), lambda w: w != "")


def _longest(words: Column) -> Column:
    ranked = F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return F.array_max(ranked)["w"]


def needles(groups: DataFrame) -> DataFrame:
    """Needles of ``(grp, variants)``: one phrase and one term-list row per variant."""
    one = groups.select("grp", F.explode("variants").alias("variant")).distinct()
    one = one.select("grp", F.lower(F.trim("variant")).alias("variant")).where("variant <> ''")
    phrase = one.select(
        "grp", F.lit(False).alias("sector"), "variant", F.array("variant").alias("terms"),
        _longest(_words(F.col("variant"))).alias("anchor"),
    )
    terms = one.select("grp", "variant", text.meaningful_terms("variant").alias("terms")).where(F.size("terms") > 0)
    listed = terms.select("grp", F.lit(True).alias("sector"), "variant", "terms", _longest(F.col("terms")).alias("anchor"))
    return phrase.unionByName(listed)


def _pieces(word: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - size + 1))
    return F.when(F.length(word) >= size, F.transform(starts, lambda i: F.substring(word, i, F.lit(size))))


def _grams(word: Column, sizes: list[int]) -> Column:
    """Distinct pieces of the given lengths."""
    return F.array_distinct(F.flatten(F.array_compact(F.array(*[_pieces(word, n) for n in sizes]))))


def word_hits(texts: DataFrame, sought: DataFrame) -> DataFrame:
    """(word, anchor) for every distinct text word that contains an anchor.

    Both meet on the anchor's first three letters; shorter anchors meet on all of theirs.
    """
    anchors = sought.select("anchor").distinct().withColumn("gram", F.substring("anchor", 1, 3))
    sizes = sorted(r[0] for r in anchors.select(F.length("gram")).distinct().collect())  # at most 1, 2 and 3
    if not sizes:
        return anchors.select(F.col("anchor").alias("word"), "anchor")
    vocabulary = texts.select(F.explode(_words(F.col("text"))).alias("word")).distinct()
    pieces = vocabulary.select("word", F.explode(_grams(F.col("word"), sizes)).alias("gram"))
    return pieces.join(anchors, "gram").where(F.contains("word", F.col("anchor"))).select("word", "anchor").distinct()


def needle_match(body: Column, sector: Column, terms: Column) -> Column:
    """Needle test: all terms are substrings; ``ai`` and ``iot`` are whole words in free text."""
    first = F.element_at(terms, 1)
    boundary = F.regexp_like(body, F.concat(F.lit("(^|[^a-z0-9])"), first, F.lit("([^a-z0-9]|$)")))
    plain = F.forall(terms, lambda t: F.contains(body, t))
    return F.when(~sector & first.isin("ai", "iot"), boundary).otherwise(plain)


def group_hits(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct ``(grp, service_id)`` where any variant of the group is found.

    Row keys, not texts, meet the hit words; only texts with a hit word are read again and compared in full.
    """
    sought = materialize(needles(groups).withColumnRenamed("sector", "n_sector"))
    hits = materialize(word_hits(texts, sought))
    test = (F.col("sector") == F.col("n_sector")) & needle_match(F.col("text"), F.col("sector"), F.col("terms"))
    # texts that share a key are all compared, so a short key loses nothing
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    rows = keyed.select("service_id", "sector", "text_key", F.explode(_words(F.col("text"))).alias("word"))
    place = ["service_id", "sector", "text_key"]
    pairs = gather(rows.join(hits, "word").select(*place, "anchor"), *place).distinct()
    found = pairs.join(keyed, place).join(sought, "anchor").where(test)
    return gather(found.select("grp", "service_id"), "grp", "service_id").distinct()


def short_tech_evidence(texts: DataFrame) -> DataFrame:
    """``(term, service_id)`` with ai or iot as a whole word in any text or industry."""

    def shows(term: str) -> Column:
        word = F.regexp_like("text", F.lit(f"(^|[^a-z0-9]){term}([^a-z0-9]|$)"))
        return F.when(F.contains("text", F.lit(term)) & word, F.lit(term))

    found = F.array_compact(F.array(shows("ai"), shows("iot")))
    return texts.select("service_id", F.explode(found).alias("term")).distinct()


def required_terms(query) -> Column:
    """Short technology terms the query asks for explicitly."""
    low = F.lower(query)
    ai = F.regexp_like(low, F.lit("(^|[^a-z0-9])ai([^a-z0-9]|$)")) | F.contains(low, F.lit("artificial intelligence"))
    iot = F.regexp_like(low, F.lit("(^|[^a-z0-9])iot([^a-z0-9]|$)")) | F.contains(low, F.lit("internet of things"))
    return F.array_compact(F.array(F.when(ai, F.lit("ai")), F.when(iot, F.lit("iot"))))


def guard(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Keep ``(query, service_id)`` rows whose service shows every required term."""
    needed = required_terms(F.col("query"))
    free = pairs.where(F.size(needed) == 0)
    bound = pairs.where(F.size(needed) > 0)
    shown = (
        bound.select("query", "service_id", F.explode(needed).alias("term"), F.size(needed).alias("want"))
        .join(by_key(evidence), ["term", "service_id"])
        .groupBy("query", "service_id", "want").agg(F.count(F.lit(1)).alias("have"))
        .where("have = want").select("query", "service_id")
    )
    return free.unionByName(bound.join(by_key(shown), ["query", "service_id"], "left_semi"))


def group_counts(groups: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query, service_id, hits)``: how many groups of a query hit a service."""
    rows = groups.select("query", "grp").join(hits, "grp").select("query", "service_id")
    return gather(rows, "query", "service_id").groupBy("query", "service_id").agg(F.count(F.lit(1)).alias("hits"))


def natural_matches(groups: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query, service_id, hits, n_groups)``: all groups if any service has all, else enough."""
    sizes = groups.groupBy("query").agg(F.count(F.lit(1)).alias("n_groups"))
    counts = group_counts(groups, hits)
    best = counts.groupBy("query").agg(F.max("hits").alias("best"))
    n = F.col("n_groups")
    enough = F.when(n <= 2, n).when(n == 3, 2).otherwise(F.greatest(F.lit(2), n - 1))
    needed = F.when(F.col("best") == n, n).otherwise(enough)
    rule = sizes.join(best, "query").select("query", "n_groups", needed.alias("needed"))
    return counts.join(rule, "query").where("hits >= needed").select("query", "service_id", "hits", "n_groups")


def _group_points(services: DataFrame, groups: DataFrame, hits: DataFrame) -> DataFrame:
    """Points of each non-amount ``(grp, service_id)`` hit, computed once per group."""
    variants = groups.where(~F.col("grp").startswith("amount:")).select("grp", "variants").dropDuplicates(["grp"])
    variants = variants.select("grp", F.transform("variants", text.normalize_query).alias("variants"))
    body = services.select(
        F.col("id").alias("service_id"),
        text.normalize_query("title").alias("t"),
        text.normalize_query(text.join_nonblank(*RANK_TEXT)).alias("core"),
        F.concat_ws(FIELD_BREAK, text.normalize_query("category_name"), text.normalize_query("domain_name")).alias("area"),
    )

    def any_in(column: str) -> Column:
        return F.exists("variants", lambda v: (v != "") & F.contains(column, v))

    points = (
        F.lit(POINTS["group"])
        + F.when(any_in("t"), POINTS["title"]).otherwise(0)
        + F.when(any_in("core"), POINTS["core"]).otherwise(0)
        + F.when(any_in("area"), POINTS["area"]).otherwise(0)
    )
    # little data, much work: dealt over all tasks by the key of the join
    return spread(hits.join(variants, "grp"), "service_id").join(by_key(body), "service_id").select("grp", "service_id", points.alias("points"))


def rank_scores(services: DataFrame, groups: DataFrame, hits: DataFrame) -> DataFrame:
    """Relevance ``(query, service_id, score)`` of every service that hits any group."""
    sizes = groups.groupBy("query").agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("grp").startswith("amount:")).alias("n_amounts")
    )
    points = _group_points(services, groups, hits)
    amount_hits = hits.where(F.col("grp").startswith("amount:")).select("grp", "service_id", F.lit(0).alias("points"))
    base = (
        gather(groups.select("query", "grp").join(points.unionByName(amount_hits), "grp"), "query", "service_id")
        .groupBy("query", "service_id")
        .agg(F.sum("points").alias("points"), F.count_if(~F.col("grp").startswith("amount:")).alias("plain"))
        .join(sizes.withColumn("wanted", amounts_in_lakh(F.col("query"))), "query")
    )
    money = services.select(F.col("id").alias("service_id"), amounts_in_lakh(text.join_nonblank(*RANK_TEXT)).alias("offered"))
    exact = F.arrays_overlap("wanted", "offered")
    enough = F.array_max("offered") >= F.array_min("wanted")
    rows = base.join(by_key(money), "service_id").withColumn(
        "exact", F.coalesce(exact, F.lit(False)) & (F.col("n_amounts") > 0)
    )
    gained = (
        F.when(F.col("exact"), POINTS["amount_exact"]).when(F.coalesce(enough, F.lit(False)), POINTS["amount_enough"]).otherwise(0)
        * F.col("n_amounts")
    )
    true_matches = F.col("plain") + F.when(F.col("exact"), F.col("n_amounts")).otherwise(0)
    n = F.col("n_groups")
    bonus = (
        F.when(true_matches == n, POINTS["all_groups"])
        .when((n >= 3) & (true_matches == n - 1), POINTS["all_but_one"])
        .otherwise(0)
    )
    return rows.select("query", "service_id", (F.col("points") + gained + bonus).cast("bigint").alias("score"))


def title_boost(query, title) -> Column:
    q, t = text.normalize_query(query), text.normalize_query(title)
    return (
        F.when(q == "", 0)
        .when(t == q, POINTS["title_exact"])
        .when(t.startswith(q), POINTS["title_prefix"])
        .when(F.contains(t, q), POINTS["title_inside"])
        .otherwise(0)
    )


def search_candidates(queries: DataFrame, services: DataFrame, texts: DataFrame) -> DataFrame:
    """Every matching ``(query, service_id)`` with its relevance score.

    A service matches when the raw query is found as it stands (in any text or as sector terms),
    or when enough of the query's concept groups are. ``services`` must hold visible rows only.
    """
    queries = queries.select("query").where(F.trim("query") != "").distinct()
    groups = materialize(query_groups(queries))
    raw = queries.select("query", F.concat(F.lit("raw:"), "query").alias("grp"), F.array("query").alias("variants"))
    visible = services.select(F.col("id").alias("service_id"))
    hits = materialize(group_hits(texts, groups.unionByName(raw)).join(by_key(visible), "service_id", "left_semi"))
    natural = natural_matches(groups, hits).select("query", "service_id")
    if not queries.where(F.size(required_terms(F.col("query"))) > 0).isEmpty():
        natural = guard(natural, short_tech_evidence(texts))
    direct = raw.select("query", "grp").join(hits, "grp").select("query", "service_id")
    matched = gather(natural.union(direct), "query", "service_id").distinct()
    scores = rank_scores(services, groups, hits)
    return matched.join(by_key(scores), ["query", "service_id"], "left").fillna(0, ["score"])


#: services of a block, and queries that are answered together; both bound what a task holds
BLOCK_SERVICES, BLOCK_QUERIES = 4_096, 1_000
#: lists that aren't hits of a concept group: offered amounts, and by prefix exact amounts, short terms and titles
OFFERED, PAID, TERM, TITLE, RAW = "offered", "paid:", "term:", "title:", "raw:"


def title_hits(queries: DataFrame, services: DataFrame) -> DataFrame:
    """``(query, service_id, boost)`` of titles that contain a query, met on the query's longest word."""
    asked = queries.select("query", text.normalize_query("query").alias("q")).where("q <> ''").withColumn("anchor", _longest(_words(F.col("q"))))
    titles = services.select(F.col("id").alias("service_id"), "title", text.normalize_query("title").alias("text")).where("text <> ''")
    hits = word_hits(titles, asked)
    rows = titles.select("service_id", F.explode(_words(F.col("text"))).alias("word")).join(hits, "word").select("service_id", "anchor").distinct()
    found = rows.join(asked, "anchor").join(by_key(titles), "service_id").where(F.contains("text", F.col("q")))
    return found.select("query", "service_id", title_boost("query", "title").alias("boost"))


def _placed(services: DataFrame, blocks: int) -> DataFrame:
    """Services dealt over blocks; ``offset`` counts them within their block in the order that decides between equal scores."""
    from pyspark.sql import Window

    rows = services.select(F.col("id").alias("service_id"), "title", "domain_order", text.normalize_query("title").alias("order_title"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("service_id"), F.lit(blocks)).cast("int"))
    w = Window.partitionBy("block").orderBy("domain_order", "order_title", "service_id")
    return rows.withColumn("offset", (F.row_number().over(w) - 1).cast("int"))


def _plans(queries: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """What to look up for each query: its groups, whether they are amounts, wanted amounts, required terms and all its lists."""
    keys = groups.groupBy("query").agg(F.collect_list("grp").alias("groups"))
    wanted = F.transform(amounts_in_lakh(F.col("query")), lambda x: x.cast("string"))
    rows = queries.join(keys, "query", "left").withColumns({"groups": F.coalesce("groups", F.array().cast("array<string>")), "terms": required_terms(F.col("query"))})
    n_amounts = F.size(F.filter("groups", lambda g: g.startswith("amount:")))
    rows = rows.withColumn("n_amounts", n_amounts).withColumn("wanted", F.when(n_amounts > 0, wanted).otherwise(F.array().cast("array<string>")))
    paid = F.transform("wanted", lambda x: F.concat(F.lit(PAID), x))
    lists = F.concat(
        "groups", F.array(F.concat(F.lit(RAW), "query"), F.concat(F.lit(TITLE), "query")), paid, F.transform("terms", lambda t: F.concat(F.lit(TERM), t)),
        F.when(n_amounts > 0, F.array(F.lit(OFFERED))).otherwise(F.array().cast("array<string>")))
    return rows.withColumns({"lists": lists, "part": F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")})


_FOUND = "query string, block int, strict boolean, best int, n bigint, offsets array<int>, scores array<bigint>"


def _answered(k: int):
    """The first ``k`` services of a block for each query of a part, and how many match in all.

    Whether a query's matches must show all its groups is known only when all blocks are done, so both answers are given.
    """
    from bisect import bisect_left
    from decimal import Decimal

    import numpy as np
    import pandas as pd

    def run(lists: pd.DataFrame, plans: pd.DataFrame) -> pd.DataFrame:
        held = {g: (np.asarray(o, np.int64), np.asarray(p, np.int64)) for g, o, p in zip(lists["grp"], lists["offsets"], lists["points"], strict=True)}
        offered = next((list(map(Decimal, a)) for g, a in zip(lists["grp"], lists["amounts"], strict=True) if g == OFFERED), [])
        levels = sorted(set(offered))
        level = np.array([bisect_left(levels, x) for x in offered], np.int64)
        size = 1 + max((int(o.max()) for o, _ in held.values()), default=0)
        block, out = int(lists["block"].iloc[0]) if len(lists) else 0, []

        def mask(keys) -> np.ndarray:
            on = np.zeros(size, bool)
            for key in keys:
                if key in held:
                    on[held[key][0]] = True
            return on

        for plan in (plans["plans"].iloc[0] if len(plans) and len(lists) else ()):
            query, groups, n_amounts, n = plan["query"], list(plan["groups"]), plan["n_amounts"], len(plan["groups"])
            some = [held[g] for g in groups if g in held]
            if not some and RAW + query not in held:
                continue
            plain = [held[g] for g in groups if g in held and not g.startswith("amount:")]
            count = lambda xs: np.bincount(np.concatenate([o for o, _ in xs]), minlength=size) if xs else np.zeros(size, np.int64)
            hits, score = count(some), np.zeros(size, np.int64)
            for offsets, points in plain:
                score[offsets] += points
            matches = count(plain)
            if n_amounts:
                wanted = list(plan["wanted"])
                exact, enough = mask(PAID + x for x in wanted), np.zeros(size, bool)
                if wanted and offered:
                    enough[held[OFFERED][0][level >= bisect_left(levels, min(map(Decimal, wanted)))]] = True
                score += n_amounts * np.where(exact, POINTS["amount_exact"], np.where(enough, POINTS["amount_enough"], 0))
                matches = matches + n_amounts * exact
            score += np.where(matches == n, POINTS["all_groups"], np.where((n >= 3) & (matches == n - 1), POINTS["all_but_one"], 0))
            score[hits == 0] = 0
            if TITLE + query in held:
                offsets, boost = held[TITLE + query]
                score[offsets] += boost
            raw, allowed = mask([RAW + query]), np.ones(size, bool)
            for term in plan["terms"]:
                allowed &= mask([TERM + term])
            enough_groups = n if n <= 2 else 2 if n == 3 else max(2, n - 1)
            for strict, needed in ((True, n), (False, enough_groups)):
                found = np.flatnonzero(raw | (hits >= needed) & allowed & (n > 0))
                first = found[np.lexsort((found, -score[found]))[:k]]
                out.append((query, block, strict, int(hits.max()), len(found), first.astype(np.int32), score[first]))
        return pd.DataFrame(out, columns=["query", "block", "strict", "best", "n", "offsets", "scores"])

    return run


def search(queries: DataFrame, services: DataFrame, texts: DataFrame, k: int = 250) -> DataFrame:
    """Ranked search result per query, at most ``k`` rows each, plus the full match count.

    Hits of a group become a list of places per block of services, with the group's points. A task combines the lists
    that a part of the queries needs within one block and keeps ``k`` places a query, so no row per query and hit is ever made.
    """
    from pyspark.sql import Window

    queries = materialize(queries.select("query").where(F.trim("query") != "").distinct())
    groups = materialize(query_groups(queries))
    raw = queries.select("query", F.concat(F.lit(RAW), "query").alias("grp"), F.array("query").alias("variants"))
    placed = materialize(_placed(services, -(-max(services.count(), 1) // BLOCK_SERVICES)))
    place = placed.select("service_id", "block", "offset")
    hits = materialize(group_hits(texts, groups.unionByName(raw)).join(by_key(place.select("service_id")), "service_id", "left_semi"))
    plans = materialize(_plans(queries, groups, -(-max(queries.count(), 1) // BLOCK_QUERIES)))
    none, post = F.lit(0).cast("bigint").alias("points"), ["grp", "service_id", "points"]
    posts = _group_points(services, groups, hits).select("grp", "service_id", F.col("points").cast("bigint").alias("points"))
    posts = posts.unionByName(hits.where(F.col("grp").startswith("amount:") | F.col("grp").startswith(RAW)).select("grp", "service_id", none))
    posts = posts.unionByName(title_hits(queries, services).select(F.concat(F.lit(TITLE), "query").alias("grp"), "service_id", F.col("boost").cast("bigint").alias("points")))
    if not plans.where(F.size("terms") > 0).limit(1).isEmpty():
        posts = posts.unionByName(short_tech_evidence(texts).select(F.concat(F.lit(TERM), "term").alias("grp"), "service_id", none))
    posts = posts.select(*post, F.lit("").alias("amount"))
    if not plans.where("n_amounts > 0").limit(1).isEmpty():
        written = services.select(F.col("id").alias("service_id"), text.join_nonblank(*RANK_TEXT).alias("written")).where(F.regexp_like("written", F.lit("[0-9]")))
        # read twice; an expression this dear must not be pushed into both uses
        money = materialize(spread(written, "service_id").select("service_id", amounts_in_lakh(F.col("written")).alias("offered"), none)).where(F.size("offered") > 0)
        posts = posts.unionByName(money.select(F.lit(OFFERED).alias("grp"), "service_id", "points", F.array_max("offered").cast("string").alias("amount")))
        paid = money.select("service_id", "points", F.explode("offered").alias("x"))
        posts = posts.unionByName(paid.select(F.concat(F.lit(PAID), F.col("x").cast("string")).alias("grp"), "service_id", "points", F.lit("").alias("amount")))
    # a list lies within one block, so it has a bounded length
    lists = posts.join(by_key(place), "service_id").groupBy("grp", "block").agg(F.collect_set(F.struct("offset", "points", "amount")).alias("x"))
    lists = lists.select("grp", "block", F.col("x.offset").alias("offsets"), F.col("x.points").alias("points"), F.col("x.amount").alias("amounts"))
    sought = plans.select("part", F.explode("lists").alias("grp")).distinct()
    lists = materialize(lists.join(sought, "grp"))
    packed = plans.groupBy("part").agg(F.collect_list(F.struct("query", "groups", "n_amounts", "wanted", "terms")).alias("plans"))
    needed = lists.select("part", "block").distinct().join(packed, "part").select(F.col("part").alias("of_part"), F.col("block").alias("of_block"), "plans")
    both = lists.groupBy("part", "block").cogroup(needed.groupBy("of_part", "of_block")).applyInPandas(_answered(k), _FOUND)
    found = materialize(both)
    n_groups = plans.select("query", F.size("groups").alias("n_groups"))
    rule = found.groupBy("query").agg(F.max("best").alias("best")).join(n_groups, "query")
    chosen = found.join(rule.select("query", (F.col("best") == F.col("n_groups")).alias("strict")), ["query", "strict"])
    totals = chosen.groupBy("query").agg(F.sum("n").alias("result_count"))
    rows = chosen.select("query", "block", F.explode(F.arrays_zip("offsets", "scores")).alias("x")).select("query", "block", F.col("x.offsets").alias("offset"), F.col("x.scores").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "domain_order", "order_title", "service_id")
    top = rows.join(by_key(placed), ["block", "offset"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(totals, "query").select("query", "service_id", "title", "score", F.col("rank").cast("bigint").alias("rank"), "result_count")
