"""Text normalisers, tokenisers and splitters as Column builders (no Python in the hot path).

All builders lower-case with Spark's ``lower``; the only known difference from full Unicode
case folding is letters such as the sharp s.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import (
    MATCH_STOPWORDS,
    SECTOR_STOPWORDS,
    TYPEAHEAD_PHRASE_ALIASES,
    TYPEAHEAD_WORD_ALIASES,
)


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank(value) -> Column:
    """NULL as the empty string."""
    return F.coalesce(_c(value), F.lit(""))


def squeeze(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def strip(value: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def join_nonblank(*values) -> Column:
    """Values that are neither NULL nor empty, joined by one space."""
    return F.array_join(F.filter(F.array(*[_c(v) for v in values]), lambda x: x.isNotNull() & (x != "")), " ")


def normalize_query(value) -> Column:
    """Lower case, ``&`` spelled out, dashes, underscores and slashes as spaces, one space."""
    text = F.regexp_replace(F.lower(blank(value)), "&", " and ")
    return squeeze(F.regexp_replace(text, r"[-_/]+", " "))


def normalize_ws(value) -> Column:
    """Trim, lower case, collapse white space."""
    return squeeze(F.lower(blank(value)))


def norm_alnum(value) -> Column:
    """Lower case with every run of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(blank(value)), "[^a-z0-9]+", " "))


#: all but a-z, 0-9 and % . / : + - in ranges: Java tries a negated list of these against each character some twenty times slower
NOT_COMPARED = r"[\x00-\x24\x26-\x2a\x2c\x3b-\x60\x7b-\x{10ffff}]+"


def normalize_text(value) -> Column:
    """Comparison form of imported text: no rupee signs or commas, plain ASCII, one space."""
    text = F.regexp_replace(F.lower(blank(value)), "[₹,]", "")
    return F.trim(F.regexp_replace(text, NOT_COMPARED, " "))


def clean_text(value) -> Column:
    """Text without tags, lower case, dashes unified, one space."""
    text = F.lower(F.regexp_replace(blank(value), "<[^>]+>", " "))
    return squeeze(F.regexp_replace(text, "[–—]", "-"))


def plain_word(stripped: Column) -> Column:
    """The words none, null and nan mean blank."""
    return F.when(F.lower(stripped).isin("none", "null", "nan"), F.lit("")).otherwise(stripped)


def plain(value) -> Column:
    """Trimmed text; the words none, null and nan mean blank."""
    return plain_word(strip(blank(value)))


def norm_space(value) -> Column:
    return normalize_ws(plain(value))


#: what a pattern's white space stands for, and the other ends of a line that its end of text passes over
SPACE, LINE_ENDS = " \t\n\x0b\f\r", "\u0085\u2028\u2029"


def plain_once(value) -> Column:
    """As ``plain``, computed once; patterns are left out where a text has no white space at its ends."""

    def stripped(v: Column) -> Column:
        return F.when(F.btrim(v, F.lit(SPACE + LINE_ENDS)) == v, v).otherwise(strip(v))

    return bound(bound(blank(value), stripped), plain_word)


def normalise_key(value) -> Column:
    return F.trim(F.regexp_replace(F.lower(plain_once(value)), r"[\s_\-/]+", " "))


def canonicalize(value) -> Column:
    """Typeahead form: letters and digits only, phrase aliases, then word aliases."""
    text = F.trim(F.regexp_replace(F.lower(blank(value)), r"[^\p{L}\p{N}]+", " "))
    for source, target in TYPEAHEAD_PHRASE_ALIASES:
        text = F.replace(text, F.lit(source), F.lit(target))
    aliases = F.create_map(*[F.lit(x) for pair in TYPEAHEAD_WORD_ALIASES.items() for x in pair])
    words = F.transform(F.split(text, " "), lambda t: F.coalesce(F.try_element_at(aliases, t), t))
    return F.array_join(words, " ")


def phrase_present(text, phrase) -> Column:
    """The phrase occurs with no letter or digit directly before or after it.

    ``phrase`` is a string literal or a Column.
    """
    if isinstance(phrase, str):
        phrase = F.lit(phrase)
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), phrase, F.lit(r"\E(?![a-z0-9])"))
    return F.regexp_like(_c(text), quoted)


def tokens(value) -> Column:
    """ASCII word tokens of already lower-cased text."""
    return F.regexp_extract_all(_c(value), F.lit("([a-z0-9]+)"), 1)


def meaningful_terms(value, stopwords=SECTOR_STOPWORDS) -> Column:
    """Tokens over two characters without stopwords; all such tokens if none is left."""
    long_tokens = F.filter(tokens(normalize_ws(value)), lambda t: F.length(t) > 2)
    kept = F.filter(long_tokens, lambda t: ~t.isin(*sorted(stopwords)))
    return F.when(F.size(kept) > 0, kept).otherwise(long_tokens)


def contains_all(text: Column, terms: Column) -> Column:
    """Every term is a substring; no terms means no match."""
    return (F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(text, t))


def sector_text(industries) -> Column:
    kept = F.filter(_c(industries), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_join(F.transform(kept, normalize_ws), " "), F.lit(""))


def sector_matches(industries, query) -> Column:
    """All meaningful terms of the query occur in the joined industries."""
    return _c(industries).isNotNull() & contains_all(sector_text(industries), meaningful_terms(query))


def keyword_matches(searchable: Column, keyword) -> Column:
    """Whole phrase in the text, else every meaningful term; blank keyword matches."""
    query = normalize_ws(keyword)
    return (
        F.when(query == "", F.lit(True))
        .when(F.contains(searchable, query), F.lit(True))
        .otherwise(contains_all(searchable, meaningful_terms(keyword, MATCH_STOPWORDS)))
    )


def clean_list(values) -> Column:
    """Trimmed non-blank entries; a NULL array is an empty list."""
    trimmed = F.transform(_c(values), lambda x: strip(blank(x)))
    return F.coalesce(F.filter(trimmed, lambda x: x != ""), F.array().cast("array<string>"))


def display_values(values) -> Column:
    kept = clean_list(values)
    return F.when(F.size(kept) == 0, F.lit("Not specified")).otherwise(F.array_join(kept, ", "))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: Spark computes it again for each element of a lambda that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unique_strings(values: Column) -> Column:
    """First occurrence of each value, compared without case and spacing."""
    kept = F.filter(F.transform(values, plain), lambda x: x != "")
    by_print = F.array_sort(F.transform(kept, lambda x, i: F.struct(normalize_ws(x).alias("p"), i.alias("i"), x.alias("x"))))

    def firsts(rows: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(rows, lambda r: r["p"]))
        marked = F.zip_with(rows, F.slice(before, F.lit(1), F.size(rows)), lambda r, p: F.when(p.isNull() | (p != r["p"]), F.struct(r["i"].alias("i"), r["x"].alias("x"))))
        return F.transform(F.array_sort(F.array_compact(marked)), lambda r: r["x"])

    return bound(by_print, firsts)


#: fixed pattern of a bullet, number or letter that starts a list line
LIST_PREFIX = r"^\s*(?:[•●▪◦\-–—*]|\d+[.)]|[a-zA-Z][.)])\s+"


def _marked_lines(value: Column) -> Column:
    lines = F.filter(F.transform(F.split(value, r"\R"), strip), lambda x: x != "")
    marked = F.filter(lines, lambda x: F.regexp_like(x, F.lit(LIST_PREFIX)))
    items = F.transform(marked, lambda x: strip(F.regexp_replace(x, LIST_PREFIX, "")))
    return F.filter(items, lambda x: x != "")


def _parts(value: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(value, separator), strip), lambda x: x != "")


def split_items(value) -> Column:
    """List lines if any, else ``|`` parts if there are two, else the whole text."""

    def piped(text: Column, parts: Column) -> Column:
        return F.when(F.size(parts) >= 2, unique_strings(parts)).otherwise(F.array(text))

    def listed(text: Column, marked: Column) -> Column:
        return F.when(F.size(marked) > 0, unique_strings(marked)).otherwise(bound(_parts(text, r"\|"), lambda parts: piped(text, parts)))

    return bound(plain(value), lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(
        bound(_marked_lines(text), lambda marked: listed(text, marked))))


def split_items_strict(value) -> Column:
    """At least two list lines, else at least two ``;`` parts, else nothing."""
    none = F.array().cast("array<string>")
    parted = lambda parts: F.when(F.size(parts) >= 2, parts).otherwise(none)
    return bound(plain(value), lambda text: bound(_marked_lines(text), lambda marked: F.when(F.size(marked) >= 2, marked).otherwise(
        bound(_parts(text, ";"), parted))))


def list_layout(value) -> Column:
    """Line break before inline list markers when a text has at least two of a kind."""
    text = blank(value)
    for marker in (r"(?:\(\d{1,2}\)|\d{1,2}[.)])(?=[ \t])", r"Voucher[ \t]+[A-Z][ \t]*:"):
        broken = F.regexp_replace(text, rf"(?i)[ \t]+(?={marker})", "\n")
        text = F.when(F.regexp_count(text, F.lit(f"(?i){marker}")) >= 2, broken).otherwise(text)
    return text


def slug_base(title, max_length: int = 240) -> Column:
    """URL-safe form of a title, before collision numbering."""
    text = F.lower(blank(title))
    text = F.regexp_replace(text, r"[^a-z0-9_\s-]+", "")
    text = F.regexp_replace(F.trim(text), r"[-\s]+", "-")
    text = F.regexp_replace(text, r"^[-_]+|[-_]+$", "")
    return F.substring(F.when(text == "", F.lit("imported-service")).otherwise(text), 1, max_length)


def numbered(base: Column, number: Column, max_length: int) -> Column:
    """``base`` for number 1, else ``base-number`` cut to the column width."""
    suffix = F.concat(F.lit("-"), number.cast("string"))
    cut = F.substring(base, F.lit(1), F.lit(max_length) - F.length(suffix))
    return F.when(number <= 1, base).otherwise(F.concat(cut, suffix))


def truncate(value, max_length: int) -> Column:
    return F.substring(_c(value), 1, max_length)


def verbatim_join(values: Column) -> Column:
    """Distinct non-blank texts in order, separated by a blank line."""
    kept = F.filter(values, lambda x: x.isNotNull() & (strip(x) != ""))
    return F.array_join(F.array_distinct(kept), "\n\n")


def canonical_json(*columns: str) -> Column:
    """JSON with keys in sorted order, NULLs kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def row_fingerprint(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def json_safe(value, dtype: str) -> Column:
    """ISO text for dates and times, plain digits for decimals, other values unchanged."""
    col = _c(value)
    if dtype == "date":
        return F.date_format(col, "yyyy-MM-dd")
    if dtype.startswith("timestamp"):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    if dtype.startswith("decimal"):
        return col.cast("string")
    return col
