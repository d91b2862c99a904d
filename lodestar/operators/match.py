"""Client profiles against catalogue eligibility: checks, verdicts and ranked buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import eligibility as el
from ..functions import pitch, text
from ..functions.wordlists import GENERIC_WILDCARDS, PRIORITY_RANK, STATE_WILDCARDS
from ..session import BROADCAST_ROWS, materialize, spread

#: (client column, service column, label, extra wildcards)
CATEGORICAL = (
    ("business_type", "business_types", "Business type", ()),
    ("business_stage", "business_stages", "Business stage", ()),
    ("industry", "industries", "Industry", ()),
    ("state", "applicable_states", "State", STATE_WILDCARDS),
    ("founder_category", "founder_categories", "Founder category", ()),
)
BUCKETS = ("HIGH", "POSSIBLE", "NOT_ELIGIBLE")


def _check(state: Column, reason: Column) -> Column:
    return F.when(state.isNotNull(), F.struct(state.alias("state"), reason.alias("reason")))


def prepare_services(services: DataFrame) -> DataFrame:
    """Add the cleaned rule lists once per service, before any pair is made."""
    extra = {}
    for _, allowed, _, wildcards in CATEGORICAL:
        names = F.transform(text.clean_list(allowed), text.normalize_ws)
        extra[f"{allowed}__names"] = names
        wild = F.array(*[F.lit(w) for w in (*GENERIC_WILDCARDS, *wildcards)])
        extra[f"{allowed}__wild"] = F.arrays_overlap(names, wild)
    return services.withColumns(extra)


def prepare_clients(clients: DataFrame) -> DataFrame:
    return clients.withColumns({f"{c}__name": text.normalize_ws(c) for c, *_ in CATEGORICAL})


def categorical_check(client: str, allowed: str, label: str, extra=()) -> Column:
    """NULL without a rule, else match, mismatch or unknown with its reason.

    Works on prepared client and service columns.
    """
    missing = F.col(f"{client}__name") == ""
    wild, names = F.col(f"{allowed}__wild"), F.col(f"{allowed}__names")
    same = F.array_contains(names, F.col(f"{client}__name"))
    state = (
        F.when(F.size(names) == 0, F.lit(None))
        .when(missing, "unknown")
        .when(wild | same, "match")
        .otherwise("mismatch")
    )
    reason = (
        F.when(missing, F.lit(f"{label} is required by this service but was not provided."))
        .when(wild, F.lit(f"{label}: applicable broadly."))
        .when(same, F.concat(F.lit(f"{label} matches: "), client, F.lit(".")))
        .otherwise(F.concat(F.lit(f"{label} mismatch. Allowed: "), F.array_join(allowed, ", "), F.lit(".")))
    )
    return _check(state, reason)


def range_check(client: str, low: str, high: str, label: str, scale: int = 1) -> Column:
    value, lo, hi = F.col(client), F.col(low) * scale, F.col(high) * scale
    state = (
        F.when(F.col(low).isNull() & F.col(high).isNull(), F.lit(None))
        .when(value.isNull(), "unknown")
        .when(value < lo, "mismatch")
        .when(value > hi, "mismatch")
        .otherwise("match")
    )
    reason = (
        F.when(value.isNull(), F.lit(f"{label} criteria exist but the client value was not provided."))
        .when(value < lo, F.concat(F.lit(f"{label} is below the minimum of "), lo.cast("string"), F.lit(".")))
        .when(value > hi, F.concat(F.lit(f"{label} is above the maximum of "), hi.cast("string"), F.lit(".")))
        .otherwise(F.lit(f"{label} is within the eligible range."))
    )
    return _check(state, reason)


def deadline_check(today) -> Column:
    late = F.col("application_deadline") < pitch.day(today)
    return _check(F.when(late, "mismatch"), F.lit("The recorded application deadline has passed."))


def evaluate(pairs: DataFrame, today, limits_in_lakh: bool = False) -> DataFrame:
    """Verdict of ``(client, service)`` pairs that carry both prepared sides' columns.

    ``limits_in_lakh`` converts turnover limits to rupees, the unit of client turnover.
    """
    checks = [categorical_check(*spec) for spec in CATEGORICAL]
    checks.append(range_check("business_age_months", "min_business_age_months", "max_business_age_months", "Business age"))
    checks.append(range_check("annual_turnover", "min_turnover", "max_turnover", "Turnover", 100_000 if limits_in_lakh else 1))
    checks.append(deadline_check(today))
    out = pairs.withColumn("checks", F.array_compact(F.array(*checks)))

    def count(state: str) -> Column:
        return F.size(F.filter("checks", lambda c: c["state"] == state)).cast("bigint")

    out = out.withColumns({"matched_count": count("match"), "mismatch_count": count("mismatch"), "unknown_count": count("unknown")})
    verdict = (
        F.when(F.col("mismatch_count") > 0, "NOT_ELIGIBLE")
        .when((F.col("matched_count") > 0) & (F.col("unknown_count") == 0), "HIGH")
        .otherwise("POSSIBLE")
    )
    return out.withColumn("classification", verdict).withColumn(
        "criteria_count", F.size("checks").cast("bigint")
    )


def priority_rank() -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in PRIORITY_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.col("priority")), F.lit(0))


def bucket_order() -> list[Column]:
    """Order inside a verdict bucket; eligible and ineligible rows use different keys."""
    bad = F.col("classification") == "NOT_ELIGIBLE"
    return [
        F.when(bad, F.col("mismatch_count")).otherwise(-F.col("matched_count")),
        F.when(bad, -F.col("matched_count")).otherwise(F.col("unknown_count")),
        -F.col("relevance"),
        F.when(bad, F.lit(0)).otherwise(-priority_rank()),
        F.lower("title"),
        F.col("service_id"),
    ]


def rank_buckets(evaluated: DataFrame, keys: list[str], k: int = 50) -> DataFrame:
    """First ``k`` rows of each verdict bucket with the bucket's full count."""
    kept = ["classification", "service_id", "title", "priority", "relevance", "matched_count", "mismatch_count", "unknown_count"]
    rows = materialize(evaluated.select(*keys, *kept))  # read twice: counts and ranking
    counts = rows.groupBy(*keys, "classification").agg(F.count(F.lit(1)).alias("bucket_count"))
    w = Window.partitionBy(*keys, "classification").orderBy(*bucket_order())
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(counts, [*keys, "classification"])


def match_need(clients: DataFrame, services: DataFrame, found: DataFrame, today, k: int = 50, limits_in_lakh: bool = False, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Clients with a need: only services their search finds, relevance as tie break.

    ``found`` is ``(query, service_id, score)`` with the title boost already added. Rows of one client rank together.
    """
    asked = clients.where("need_query <> '' AND client_id IS NOT NULL").withColumnRenamed("need_query", "scope")
    svc = services.where(pitch.pitchable(today)).drop("service_id").withColumnRenamed("id", "service_id")
    rules = found.withColumnRenamed("query", "scope").join(svc, "service_id").withColumn("relevance", F.greatest(F.lit(0), F.col("score")))
    tagged, parts, picked = _match(asked, rules, k, block_rows, limits_in_lakh)
    columns = ["entry", "scope", "service_id", "title", "priority", "relevance"]
    merged = _merge(parts.join(picked.select(*columns), ["entry", "scope"]).drop("entry", "scope"), k)
    out = tagged.join(merged, "pid").drop("pid", "rank")
    # each row of a repeated client has its own first k; the first k of them all are among these
    repeated = materialize(asked.groupBy("client_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("client_id"))
    if repeated.isEmpty():
        return tagged.join(merged, "pid").drop("pid")
    many = out.join(repeated, "client_id", "left_semi")
    w = Window.partitionBy("client_id", "classification").orderBy(*bucket_order())
    top = many.drop("bucket_count").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    counts = tagged.join(repeated, "client_id", "left_semi").join(merged.select("pid", "classification", "bucket_count").distinct(), "pid").groupBy(
        "client_id", "classification").agg(F.sum("bucket_count").alias("bucket_count"))
    alone = tagged.join(repeated, "client_id", "left_anti").join(merged, "pid").drop("pid")
    return alone.unionByName(top.join(counts, ["client_id", "classification"]))


# --- every client against every service -------------------------------------------------------
#
# Pairs are never emitted as rows. Clients collapse to classes: the same words, and numbers between the same limits of
# rules, get the same verdicts. Services collapse to their distinct rules, each with its count and its first k services in
# either tie order, since no other can be among a bucket's first k. The rules travel as one size-checked array block; each
# task scores whole blocks with numpy. Blocks of any catalogue size merge exactly.

PROFILE = [c for c, *_ in CATEGORICAL] + ["business_age_months", "annual_turnover"]
LIMITS = {"business_age_months": ("min_business_age_months", "max_business_age_months"), "annual_turnover": ("min_turnover", "max_turnover")}
RULE = [c for _, c, *_ in CATEGORICAL] + [c for both in LIMITS.values() for c in both]


def _code(allowed: list | None, wildcards: frozenset) -> tuple | None:
    names = {" ".join(str(x).lower().split()) for x in (allowed if allowed is not None else []) if x and str(x).strip()}
    if not names:
        return None
    return ("*",) if names & wildcards else tuple(sorted(names))


class RuleBlock:
    """Distinct rules of up to a block of services as arrays, with their services in both tie orders.

    ``picked`` has a row per service: ``rule`` (equal for equal rules), the rule's columns and ``n_services``, ``entry``, and its place
    ``tie_good`` and ``tie_bad`` among all, NULL in the order in which it isn't one of the rule's first.
    """

    def __init__(self, picked: pd.DataFrame):
        rules = picked.drop_duplicates("rule")
        n = len(rules)
        place = pd.Series(np.arange(n), rules["rule"].to_numpy())
        rule = place.reindex(picked["rule"].to_numpy()).to_numpy(np.int64)
        self.count = rules["n_services"].to_numpy(np.int64)
        self.ties = int(np.nanmax(picked[["tie_good", "tie_bad"]].to_numpy(float))) + 1
        self.order = {}
        for name in ("tie_good", "tie_bad"):
            tie = pd.to_numeric(picked[name]).to_numpy(float)
            kept = np.flatnonzero(~np.isnan(tie))
            kept = kept[np.lexsort((tie[kept], rule[kept]))]
            lengths = np.bincount(rule[kept], minlength=n)
            self.order[name] = lengths, np.cumsum(lengths) - lengths, tie[kept].astype(np.int64), picked["entry"].to_numpy(np.int64)[kept]
        self.sets, self.codes = [], []
        for _, column, _, extra in CATEGORICAL:
            wild = frozenset((*GENERIC_WILDCARDS, *extra))
            seen: dict = {}
            codes = np.fromiter((seen.setdefault(_code(v, wild), len(seen)) for v in rules[column]), np.int64, n)
            self.sets.append(list(seen))
            self.codes.append(codes)

        def bounds(low: str, high: str):
            lo, hi = pd.to_numeric(rules[low]).to_numpy(float), pd.to_numeric(rules[high]).to_numpy(float)
            return lo, hi, np.isnan(lo) & np.isnan(hi)

        self.ranges = [bounds(*both) for both in LIMITS.values()]

    def states(self, profile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of matches, mismatches and unknowns per rule for one profile."""
        good = np.zeros(len(self.count), np.int64)
        bad, open_ = good.copy(), good.copy()
        for value, sets, codes in zip(profile[:5], self.sets, self.codes):
            missing = value is None or value == ""
            name = "" if missing else " ".join(str(value).lower().split())
            kind = np.array([0 if s is None else 3 if missing else 1 if s == ("*",) or name in s else 2 for s in sets])[codes]
            good += kind == 1
            bad += kind == 2
            open_ += kind == 3
        for value, (lo, hi, none) in zip(profile[5:], self.ranges):
            if value is None or pd.isna(value):
                open_ += ~none
                continue
            number = float(value)
            off = (number < lo) | (number > hi)
            bad += off
            good += ~off & ~none
        return good, bad, open_

    def buckets(self, profile, k: int):
        good, bad, open_ = self.states(profile)
        out = np.where(bad > 0, 2, np.where((good > 0) & (open_ == 0), 0, 1))
        for b, name in enumerate(BUCKETS):
            where = np.flatnonzero(out == b)
            if not len(where):
                continue
            total = int(self.count[where].sum())
            lengths, starts, ties, entries = self.order["tie_bad" if b == 2 else "tie_good"]
            level = bad[where] * 16 - good[where] + 8 if b == 2 else (8 - good[where]) * 16 + open_[where]
            by = np.argsort(level, kind="stable")
            # best levels until they hold k services
            reach = np.searchsorted(np.cumsum(lengths[where[by]]), k)
            near = level <= level[by[min(reach, len(by) - 1)]]
            where, level = where[near], level[near]
            size = lengths[where]
            rule = np.repeat(np.arange(len(where)), size)
            at = np.arange(len(rule)) - np.repeat(np.cumsum(size) - size, size) + starts[where][rule]
            key = level[rule] * self.ties + ties[at]
            first = np.argpartition(key, k)[:k] if len(key) > k else np.arange(len(key))
            for i in first:
                r = where[rule[i]]
                yield name, total, int(entries[at[i]]), int(good[r]), int(bad[r]), int(open_[r])


MATCH_SCHEMA = (
    "pid bigint, scope string, classification string, bucket_count bigint, entry bigint, "
    "matched_count bigint, mismatch_count bigint, unknown_count bigint"
)


def _score_block(profiles: DataFrame, block: DataFrame, k: int) -> DataFrame:
    rules = block.toPandas()
    blocks = {scope: RuleBlock(rows) for scope, rows in rules.groupby("scope")}
    shared = profiles.sparkSession.sparkContext.broadcast(blocks)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a profile makes up to three times k rows, so few at a time
            for start in range(0, len(batch), 200):
                rows = [
                    (*row[:2], *entry)
                    for row in batch[["pid", "scope", *PROFILE]].iloc[start : start + 200].itertuples(index=False, name=None)
                    if row[1] in shared.value
                    for entry in shared.value[row[1]].buckets(row[2:], k)
                ]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in MATCH_SCHEMA.split(", ")])

    return profiles.mapInPandas(score, MATCH_SCHEMA)


def _between(value: str, limits: DataFrame) -> Column:
    """Which of the sorted limits a number is on or between; above ``BROADCAST_ROWS`` limits the number itself."""
    found = [r[0] for r in limits.limit(BROADCAST_ROWS + 1).collect()]
    number = F.col(value).cast("double")
    if len(found) > BROADCAST_ROWS:
        return number
    edges = np.sort(np.array(found, float))

    @F.pandas_udf("double")
    def place(v: pd.Series) -> pd.Series:
        at = np.searchsorted(edges, v, "left") + np.searchsorted(edges, v, "right")
        return pd.Series(np.where(v.isna(), np.nan, at))

    return F.when(number.isNotNull() & ~F.isnan(number), place(number))


def _match(clients: DataFrame, services: DataFrame, k: int, block_rows: int, limits_in_lakh: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clients ``(client_id, pid)``, the first ``k`` of each block for every ``(pid, classification)`` and the services that can be
    among them by ``entry``. Both sides carry a ``scope``; only equal ones meet."""
    scale = {c: 100_000 if limits_in_lakh and c.endswith("turnover") else 1 for c in RULE[len(CATEGORICAL):]}
    typed = services.select(
        "scope", "service_id", "title", "priority", "relevance", F.lower("title").alias("t"), priority_rank().alias("p"),
        *RULE[:len(CATEGORICAL)], *[(F.col(c) * n).cast("double").alias(c) for c, n in scale.items()])
    as_text = {"ignoreNullFields": "false"}
    typed = materialize(typed.withColumn("rule", F.sha2(F.to_json(F.struct("scope", *RULE), as_text), 256)).withColumn("entry", F.monotonically_increasing_id()))
    good = Window.partitionBy("rule").orderBy(F.desc("relevance"), F.desc("p"), "t", "service_id", "entry")
    bad = Window.partitionBy("rule").orderBy(F.desc("relevance"), "t", "service_id", "entry")
    first = None
    for name, w in (("is_good", good), ("is_bad", bad)):
        part = typed.select("entry", "rule", F.row_number().over(w).alias("k")).where(F.col("k") <= k).select("entry", F.lit(name).alias("order"))
        first = part if first is None else first.unionByName(part)
    orders = first.groupBy("entry").agg(*[F.count_if(F.col("order") == n).alias(n) for n in ("is_good", "is_bad")])
    held = typed.groupBy("rule").agg(F.count(F.lit(1)).alias("n_services"))
    picked = materialize(typed.join(orders, "entry").join(held, "rule"))

    edges = {c: _between(c, typed.select(F.explode(F.array(*both)).alias("x")).where("x IS NOT NULL AND NOT isnan(x)").distinct()) for c, both in LIMITS.items()}
    words = [c for c, *_ in CATEGORICAL]
    tagged = clients.select("client_id", "scope", *words, *LIMITS).withColumns({f"{c}__at": e for c, e in edges.items()})
    profile_id = F.sha2(F.to_json(F.struct("scope", *words, *[f"{c}__at" for c in LIMITS]), as_text), 256)
    tagged = materialize(tagged.withColumn("profile_id", profile_id))
    classes = tagged.groupBy("profile_id").agg(*[F.first(c).alias(c) for c in ("scope", *PROFILE)])
    classes = materialize(classes.withColumn("pid", F.monotonically_increasing_id()))
    profiles = spread(classes.select("pid", "scope", *PROFILE), "pid")

    n_blocks = max(1, -(-picked.count() // block_rows))
    parts = None
    for number in range(n_blocks):
        part = picked if n_blocks == 1 else picked.where(F.pmod(F.xxhash64("rule"), F.lit(n_blocks)) == number)
        one = Window.partitionBy(F.lit(0))  # at most one block of rows
        ranks = {
            "tie_good": F.when(F.col("is_good") > 0, F.row_number().over(one.orderBy(F.desc("relevance"), F.desc("p"), "t", "service_id"))),
            "tie_bad": F.when(F.col("is_bad") > 0, F.row_number().over(one.orderBy(F.desc("relevance"), "t", "service_id"))),
        }
        part = part.withColumns(ranks).select("scope", "rule", "entry", "n_services", *ranks, *RULE)
        scored = _score_block(profiles, part, k).withColumn("block", F.lit(number))
        parts = scored if parts is None else parts.unionByName(scored)
    parts = materialize(parts)
    if n_blocks > 1:
        sums = parts.select("pid", "classification", "block", "bucket_count").distinct().groupBy("pid", "classification").agg(F.sum("bucket_count").alias("bucket_count"))
        parts = parts.drop("bucket_count").join(sums, ["pid", "classification"])
    return tagged.join(classes.select("profile_id", "pid"), "profile_id").select("client_id", "pid"), parts.drop("block"), picked


def _merge(rows: DataFrame, k: int) -> DataFrame:
    """First ``k`` of each class and bucket, of those that came from all blocks."""
    w = Window.partitionBy("pid", "classification").orderBy(*bucket_order())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def match_all(
    clients: DataFrame, services: DataFrame, today, k: int = 50, block_rows: int = BROADCAST_ROWS, limits_in_lakh: bool = False,
) -> DataFrame:
    """Verdict buckets of every client over all pitchable services, first ``k`` of each.

    ``limits_in_lakh`` converts turnover limits to rupees, the unit of client turnover. Catalogues with above ``block_rows`` services
    that can be among a first ``k`` are scored block by block, then merged.
    """
    rules = services.where(pitch.pitchable(today)).drop("service_id").withColumnRenamed("id", "service_id").withColumns({"scope": F.lit(""), "relevance": F.lit(0)})
    tagged, parts, picked = _match(clients.withColumn("scope", F.lit("")), rules, k, block_rows, limits_in_lakh)
    named = services.select(F.col("id").alias("service_id"), "title", "priority")
    rows = parts.join(picked.select("entry", "service_id"), "entry").join(named, "service_id").drop("entry", "scope").withColumn("relevance", F.lit(0))
    return tagged.join(_merge(rows, k), "pid").drop("pid", "relevance")


# --- eligibility extraction -------------------------------------------------------------------
def eligibility_text(services: DataFrame, sections: DataFrame) -> DataFrame:
    """``(id, title, pos, body)``: one row for the own wording, one per visible eligibility section.

    Rows stay tall, so a service with very many sections is never gathered in one place. Labels
    are united per service; numbers take the first pattern, then the first row, that has one.
    """
    own = services.select(
        "id", "title", F.lit(-1).cast("bigint").alias("pos"),
        el.source_text("eligibility_summary", "applicable_for_raw", "restrictions", "important_notes").alias("body"),
    )
    kids = sections.where("visibility = 'BDE' AND section_type = 'ELIGIBILITY'").select(
        F.col("service_id").alias("id"), F.col("id").alias("pos"), el.source_text("content").alias("body")
    )
    return own.unionByName(kids.join(services.select("id", "title"), "id").select("id", "title", "pos", "body"))


def extract_eligibility(services: DataFrame, sections: DataFrame) -> DataFrame:
    """Structured facts per service from its eligibility wording."""
    body = F.col("body")
    facts = eligibility_text(services, sections).select(
        "id", "pos",
        el.business_types(body).alias("business_types"),
        el.business_stages(body).alias("business_stages"),
        el.industries(body).alias("industries"),
        el.states(body).alias("applicable_states"),
        el.founders(F.col("title"), body).alias("founder_categories"),
        el.max_age_months(body).alias("age"),
        el.max_turnover_lakh(body).alias("turnover"),
    )
    lists = ["business_types", "business_stages", "industries", "applicable_states", "founder_categories"]
    out = facts.groupBy("id").agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists],
        *[
            F.min_by(F.col(f"{source}.value"), F.when(F.col(f"{source}.value").isNotNull(), F.struct(F.col(f"{source}.rule"), "pos"))).alias(name)
            for source, name in (("age", "max_business_age_months"), ("turnover", "max_turnover"))
        ],
    )
    pan = F.array(F.lit("Pan India"))
    return out.withColumn(
        "applicable_states", F.when(F.array_contains("applicable_states", "Pan India"), pan).otherwise(F.col("applicable_states"))
    )


def fill_empty(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """Fill structured fields that are empty; report which ones changed."""
    lists = ["business_types", "business_stages", "industries", "applicable_states", "founder_categories"]
    scalars = ["max_business_age_months", "max_turnover"]
    p = proposed.select("id", *[F.col(c).alias(f"p_{c}") for c in [*lists, *scalars]])
    both = current.join(p, "id")
    take = {c: (F.size(text.clean_list(c)) == 0) & (F.size(f"p_{c}") > 0) for c in lists}
    take |= {c: F.col(c).isNull() & F.col(f"p_{c}").isNotNull() for c in scalars}
    return both.select(
        "id",
        *[F.when(take[c], F.col(f"p_{c}")).otherwise(F.col(c)).alias(c) for c in [*lists, *scalars]],
        F.array_compact(F.array(*[F.when(take[c], F.lit(c)) for c in [*lists, *scalars]])).alias("changed_fields"),
    )
