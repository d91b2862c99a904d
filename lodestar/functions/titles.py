"""Title canonicalisation and the fixed values of title matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_alnum, squeeze

# --- fixed values: rewrites in order, all on whole words ------------------------------------
TITLE_REWRITES = (
    (r"\bstart\s+up\b", "startup"),
    (r"\b80\s+iac\b", "80iac"),
    (r"\bpvt\s+ltd\b", "private limited"),
    (r"\bpvt\s+limited\b", "private limited"),
    (r"\bpvt\b", "private"),
    (r"\bltd\b", "limited"),
    (r"\bllp\b", "limited liability partnership"),
    (r"\bincorporation\b", "registration"),
    (r"\bincorporate\b", "registration"),
    (r"\bincorporated\b", "registration"),
    (r"\bseed\s+funding\b", "seed fund"),
    (r"\bgovt\b", "government"),
)
# --- fixed values: words that do not identify a service ---------------------------------------
GENERIC_TITLE_WORDS = frozenset((
    "service", "services", "scheme", "application", "company", "registration", "certificate", "certification",
    "government", "india", "indian", "fund", "funding", "grant", "loan", "programme", "program",
))
# --- fixed values: shared phrases and the least score they give ---------------------------------
PHRASE_FLOORS = (
    ("limited liability partnership", 0.97),
    ("80iac", 0.97),
    ("seed fund", 0.93),
    ("startup india", 0.90),
)
PRIVATE_REGISTRATION = (("private limited", "registration"), 0.95, "private limited registration")
CONTAINED_FLOOR = 0.88
CONTAINMENT_WEIGHT, JACCARD_WEIGHT = 0.55, 0.45
# --- fixed values: decision limits --------------------------------------------------------------
SURE, STRONG, POSSIBLE = 0.90, 0.82, 0.72


def canonical_title(value) -> Column:
    out = norm_alnum(value)
    for pattern, replacement in TITLE_REWRITES:
        out = F.regexp_replace(out, pattern, replacement)
    return squeeze(out)


def title_tokens(canonical) -> Column:
    return F.array_distinct(F.split(canonical, " "))


def decide(exact: Column, score: Column, shared: Column, anchored: Column, blank: Column) -> Column:
    """Struct ``(action, method)`` from the best candidate's figures."""
    sure = (score >= SURE) | ((score >= STRONG) & (shared >= 2))
    action = (
        F.when(blank, "INVALID").when(exact, "UPDATE").when(score.isNull(), "CREATE")
        .when(sure, "UPDATE").when(score >= POSSIBLE, "MERGE_REVIEW").otherwise("CREATE")
    )
    method = (
        F.when(blank, "EMPTY_TITLE").when(exact, "EXACT_NORMALIZED_TITLE").when(score.isNull(), "NO_EXISTING_SERVICES")
        .when(sure & anchored, "BUSINESS_IDENTITY_MATCH").when(sure, "STRONG_TITLE_MATCH")
        .when(score >= POSSIBLE, "POSSIBLE_EXISTING_SERVICE").otherwise("NO_SAFE_EXISTING_MATCH")
    )
    return F.struct(action.alias("action"), method.alias("method"))
