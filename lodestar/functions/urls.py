"""URL extraction and normalisation as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, unique_strings

#: generic URL split of RFC 3986, appendix B, with the authority split further
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normalize_url(value) -> Column:
    """Lower-case scheme and host, no user info, no trailing slash, no fragment."""
    text = F.trim(blank(value))
    scheme = F.lower(F.regexp_extract(text, _SPLIT, 1))
    authority = F.regexp_replace(F.regexp_extract(text, _SPLIT, 2), "^.*@", "")
    host = F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))
    port = F.regexp_extract(authority, r"(:[0-9]+)$", 1)
    path = F.regexp_replace(F.regexp_extract(text, _SPLIT, 3), "/+$", "")
    query = F.regexp_extract(text, _SPLIT, 4)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(host != "", F.concat(F.lit("//"), host, port)).otherwise(F.lit("")),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


#: fixed pattern of a bare domain, optionally followed by a path
BARE_DOMAIN = r"(?s)^(?:www\.)?[a-z0-9][a-z0-9.-]*\.[a-z]{2,}(?:[/:?#].*)?$"


def reference_url(value) -> Column:
    """Normalised URL when the value is one (or a bare domain), else blank."""
    text = F.trim(blank(value))
    lowered = F.lower(text)
    return (
        F.when(lowered.startswith("http://") | lowered.startswith("https://"), normalize_url(text))
        .when(
            ~F.contains(text, F.lit(" ")) & F.regexp_like(lowered, F.lit(BARE_DOMAIN)),
            normalize_url(F.concat(F.lit("https://"), text)),
        )
        .otherwise(F.lit(""))
    )


#: fixed pattern of a URL inside running text
URL_IN_TEXT = r"""(?i)(https?://[^\s"'<>]+)"""


def extract_urls(value) -> Column:
    """Distinct URLs in order of first appearance."""
    return unique_strings(F.regexp_extract_all(blank(value), F.lit(URL_IN_TEXT), 1))
