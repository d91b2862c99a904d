"""Main text of web pages by wrapper inference.

Pages of a host come from few templates. A page is read as a stream of tags and text and becomes a pattern: runs of
siblings with the same label fold into a repeated group, text becomes a slot that remembers a fingerprint. Patterns of
one host are aligned pair by pair (longest common sequence of labels at each level): what only one side has becomes
optional, different text becomes a variable slot. The result, a regular expression without unions, is the host's
wrapper; it is inferred from all its pages, first inside tasks, then by grouped steps, and its size depends on the
templates, not on the number of pages.

The wrapper names the places of the article: all ``article`` and ``main`` elements, else the element below which most
variable text lies and whatever stands beside it or around it and holds variable text too, away from menus, headers,
footers, sidebars, notices, adverts, forms and comments. It also tells fixed text inside those places from the
articles' own. Pages that have none of the places are judged on their own.

Null html and html without text give an empty text; a null URL counts as a host of its own. Markup without any tag
is one text. Rows are extracted one by one, so repeated rows give the same text; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

#: Parts that a host's pages are dealt over before they meet their wrapper, and that partial wrappers are merged in.
SALTS, MERGE_PARTS = 64, 32
#: Different pages on which fixed text must be seen to count as the template's, the different pages that a pattern node
#: remembers (those of smallest fingerprint, an even sample) and the share of its article's pages it must be on.
FIXED_PAGES, SEEN_PAGES, FIXED_SHARE = 8, 16, 0.9
#: Children of a pattern node that are aligned; sequences beyond it are folded to distinct labels first. Elements nested
#: deeper than MAX_DEPTH count as part of the one at that depth.
MAX_CHILDREN, MAX_DEPTH = 60, 100

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|textarea|noscript|template|svg|iframe|title|select|button)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base col embed hr img input link meta param source track".split())
#: What an opening tag closes, as far as it is open in the same parent.
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_ENDS_P = frozenset("p h1 h2 h3 h4 h5 h6 div ul ol li dl table form section article aside header footer nav main blockquote pre figure address fieldset hr".split())
_SCOPES = frozenset("ul ol dl table article section div body".split())
#: Elements and name parts that are never the article's own text.
AWAY_TAGS = frozenset("head nav header footer aside form menu dialog object audio video canvas".split())
AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs header footer notice notices cookie cookies consent popup modal newsletter subscribe subscription comment comments reply replies "
    "respond discussion disqus share sharing social related recommended widget login signup search pagination pager copyright masthead toolbar".split())


def label_of(tag: str, attrs: str) -> str:
    """Tag with its class, id and role, digits taken out."""
    if not attrs:
        return tag
    names = [re.sub(r"\d+", "", a or b or c) for _, a, b, c in _NAME.findall(attrs)]
    return ".".join([tag, *" ".join(names).lower().split()[:3]]) if names else tag


def away(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in AWAY_TAGS or any(part in AWAY_NAMES for n in names for part in re.split(r"[^a-z]+", n))


class Page:
    """Blocks of text in page order, each with its path of (node number, label)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[tuple[int, str], ...], str]] = []
        self._path: list[tuple[int, str]] = []
        self._text: list[str] = []
        self._nodes = 0
        self._deep: list[str] = []
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text.append(source[at : m.start()])
            at = m.end()
            if tag := m["tag"]:
                self._tag(tag.lower(), bool(m["end"]), m["attrs"])
        self._text.append(source[at:])
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            self._text = []
            if text:
                self.blocks.append((tuple(self._path), text))

    def _close(self, tags: frozenset | tuple, stop: frozenset) -> None:
        """Close the innermost element of ``tags`` unless one of ``stop`` lies around it."""
        for k in range(len(self._path) - 1, -1, -1):
            tag = self._path[k][1].split(".", 1)[0]
            if tag in tags:
                del self._path[k:]
                return
            if tag in stop:
                return

    def _tag(self, tag: str, end: bool, attrs: str) -> None:
        if tag in _INLINE:
            return
        self._flush()
        if tag == "br" or tag in _VOID:
            return
        if self._deep or len(self._path) >= MAX_DEPTH and not end:
            if not end:
                self._deep.append(tag)
            elif tag in self._deep:
                while self._deep.pop() != tag:
                    pass
            elif any(label.split(".", 1)[0] == tag for _, label in self._path):
                self._deep.clear()
                self._close((tag,), frozenset())
            return
        if end:
            self._close((tag,), frozenset())
            return
        if tag in _ENDS_P:
            self._close(("p",), _SCOPES)
        if tag in _CLOSES:
            self._close(tuple(_CLOSES[tag].split()), _SCOPES)
        self._nodes += 1
        self._path.append((self._nodes, label_of(tag, attrs)))


# A pattern is a list [label, optional, repeated, pages, chars, slot, children]; pages are the SEEN_PAGES smallest
# fingerprints of the articles of pages with this node, so copies of a page count once; slot is None (no text), a number
# (the fingerprint of text that is the same everywhere) or "*" (text that varies).
LABEL, OPTIONAL, REPEATED, PAGES, CHARS, SLOT, CHILDREN = range(7)


_DIGITS = re.compile(r"\d+")


def fingerprint(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def pattern_of(page: Page) -> list:
    """The pattern of a single page, siblings folded."""
    pages = [0]
    root = ["", False, False, pages, 0, None, []]
    nodes: dict[int, list] = {}
    for path, text in page.blocks:
        node = root
        for number, label in path:
            if number not in nodes:
                nodes[number] = [label, False, False, pages, 0, None, []]
                node[CHILDREN].append(nodes[number])
            node = nodes[number]
        mark = fingerprint(text)
        node[SLOT] = mark if node[SLOT] is None else "*"
        node[CHARS] += len(text)
    folded = fold_repeats(root)
    # every node holds this list
    pages[0] = fingerprint(_DIGITS.sub("", "\n".join(main_blocks(page, places_of(folded)))))
    return folded


def fold_repeats(node: list) -> list:
    """Fold runs of the same label, and of the same two labels in turn, into repeated groups."""
    out: list[list] = []
    for child in map(fold_repeats, node[CHILDREN]):
        if out and out[-1][LABEL] == child[LABEL]:
            out[-1] = joined(out[-1], child)
            out[-1][REPEATED] = True
        elif len(out) > 2 and out[-2][LABEL] == child[LABEL] and out[-3][LABEL] == out[-1][LABEL]:
            last = out.pop()
            out[-2] = joined(out[-2], last)
            out[-1] = joined(out[-1], child)
            out[-2][REPEATED] = out[-1][REPEATED] = True
        else:
            out.append(child)
    if len(out) > MAX_CHILDREN:
        first: dict[str, list] = {}
        for child in out:
            first[child[LABEL]] = joined(first[child[LABEL]], child) if child[LABEL] in first else child
        out = list(first.values())
    node[CHILDREN] = out
    return node


def joined(a: list, b: list) -> list:
    """Two patterns of the same label as one: children are aligned, mismatches become optional."""
    slot = b[SLOT] if a[SLOT] is None else a[SLOT] if b[SLOT] is None or a[SLOT] == b[SLOT] else "*"
    pages = a[PAGES] if a[PAGES] == b[PAGES] else sorted({*a[PAGES], *b[PAGES]})[:SEEN_PAGES]
    return [a[LABEL], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], pages, a[CHARS] + b[CHARS], slot, aligned(a[CHILDREN], b[CHILDREN])]


def aligned(a: list, b: list) -> list:
    if [x[LABEL] for x in a] == [x[LABEL] for x in b]:
        return [joined(x, y) for x, y in zip(a, b, strict=True)]
    # longest common sequence of labels
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][LABEL] == b[j][LABEL] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][LABEL] == b[j][LABEL]:
            out.append(joined(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([*a[i][:OPTIONAL], True, *a[i][REPEATED:]])
            i += 1
        else:
            out.append([*b[j][:OPTIONAL], True, *b[j][REPEATED:]])
            j += 1
    return out


def own_volume(node: list) -> int:
    """Characters of variable text of a node itself."""
    return node[CHARS] if node[SLOT] == "*" or node[REPEATED] or len(node[PAGES]) < FIXED_PAGES else 0


def volume(node: list) -> int:
    """Characters of variable text below a node, without what is away from the article."""
    return 0 if away(node[LABEL]) else own_volume(node) + sum(map(volume, node[CHILDREN]))


def places_of(node: list) -> list[tuple[list[str], bool, list]]:
    """Places of the article: labels on the way from the root, whether all below counts or only the text of the node
    itself, and the node."""
    found: list[tuple[list[str], bool, list]] = []

    def look(x: list, path: list[str]) -> None:
        if away(x[LABEL]):
            return
        path = [*path, x[LABEL]]
        if x[LABEL].split(".")[0] in ("article", "main") or "main" in x[LABEL].split(".")[1:]:
            found.append((path[1:], True, x))
            return
        for child in x[CHILDREN]:
            look(child, path)

    look(node, [])
    if found:
        return [p for p in found if volume(p[2])] or found
    path: list[str] = []
    while node[CHILDREN]:
        total = volume(node)
        child = max(node[CHILDREN], key=volume)
        # a single leaf is a paragraph, not the place of the article
        if not total or volume(child) < 0.7 * total or not child[CHILDREN] and child[LABEL].split(".")[0] not in ("div", "section", "td", "body", "html"):
            break
        # what stands around and beside that child may be the article's title, lead or end
        if own_volume(node):
            found.append((path, False, node))
        found += [([*path, c[LABEL]], True, c) for c in node[CHILDREN] if c is not child and volume(c)]
        node, path = child, [*path, child[LABEL]]
    return [*found, (path, True, node)]


def fixed_of(places: list[tuple[list[str], bool, list]]) -> list[list]:
    """The template's own text below the article's places: labels from the root on, and fingerprint.

    Text counts as the template's if nearly all different pages with the place have it. What a single article has,
    however often that page is stored, stays.
    """
    out: list[list] = []

    def look(x: list, labels: list[str], sample: set[int]) -> None:
        labels = [*labels, x[LABEL]]
        least = max(FIXED_PAGES, FIXED_SHARE * len(sample))
        single = x[SLOT] not in (None, "*") and not x[REPEATED] and len(sample.intersection(x[PAGES])) >= least
        if single and not re.match(r"h[1-6]\b", x[LABEL]):
            out.append([labels, x[SLOT]])
        for child in x[CHILDREN]:
            look(child, labels, sample)

    for path, whole, node in places:
        if whole and volume(node):
            for child in node[CHILDREN]:
                look(child, path, set(node[PAGES]))
    return out


def main_blocks(page: Page, places: list, fixed: list[list] = ()) -> list[str]:
    """Blocks of the article: those at its places that nothing marks as away from it."""
    whole, own = ({tuple(p) for p, w, *_ in places if w == all_below} for all_below in (True, False))
    depths = {len(p) for p in whole}
    known = {(*labels, mark) for labels, mark in fixed}
    out = []
    for path, text in page.blocks:
        labels = tuple(label for _, label in path)
        if (labels in own or any(labels[:n] in whole for n in depths)) and not any(map(_AWAY.__getitem__, labels)):
            if not known or (*labels, fingerprint(text)) not in known:
                out.append(text)
    return out


class _Away(dict):
    def __missing__(self, label: str) -> bool:
        if len(self) > 10_000:
            self.clear()
        self[label] = away(label)
        return self[label]


_AWAY = _Away()


def extract(source: str, rule: str | None) -> str:
    """The article of a page by its host's rule; without one, or where the rule finds nothing, by the page alone."""
    page = Page(source)
    if not page.blocks:
        return ""
    blocks: list[str] = []
    if rule:
        found = json.loads(rule)
        blocks = main_blocks(page, found["places"], found["fixed"])
    if not blocks:
        blocks = main_blocks(page, places_of(pattern_of(page)))
    return "\n".join(blocks)


def _local_wrappers(batches):
    """Wrappers of the pages of one task, by host."""
    found: dict[str, list] = {}
    for batch in batches:
        for part in slices(batch):
            for host, source in zip(part.column("host").to_pylist(), part.column("text").to_pylist(), strict=True):
                pattern = pattern_of(Page(source))
                found[host] = joined(found[host], pattern) if host in found else pattern
            if len(found) > 5_000:
                yield _packed(found)
                found = {}
    if found:
        yield _packed(found)


def _packed(found: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"host": pa.array(list(found), pa.string()), "wrapper": pa.array([json.dumps(w) for w in found.values()], pa.string())})


def _merged(rows: pd.DataFrame) -> list:
    # the same order whatever order the rows arrive in
    whole = None
    for text in sorted(rows["wrapper"]):
        pattern = json.loads(text)
        whole = pattern if whole is None else joined(whole, pattern)
    return whole


def _merge_part(key, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(_merged(rows))]})


def _rule(key, rows: pd.DataFrame) -> pd.DataFrame:
    wrapper = _merged(rows)
    places = places_of(wrapper)
    rule = {"places": [[path, whole] for path, whole, _ in places], "fixed": fixed_of(places)}
    return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(wrapper)], "rule": [json.dumps(rule)]})


def _with_host(pages: DataFrame, url: str, source: str, *keep) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(*keep, host.alias("host"), F.coalesce(F.col(source), F.lit("")).alias("text"))


def wrappers(pages: DataFrame, *, url: str = "url", source: str = "html") -> DataFrame:
    """host, wrapper (JSON) and rule (JSON: places of the article and fixed text) of every host."""
    local = _with_host(pages, url, source).mapInArrow(_local_wrappers, "host string, wrapper string")
    parts = local.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(MERGE_PARTS))).groupBy("host", "part").applyInPandas(_merge_part, "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(_rule, "host string, wrapper string, rule string")


def extract_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key``, ``url`` and ``text`` of every page."""
    rules = wrappers(pages, url=url, source=source).select("host", "rule").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = _with_host(pages, url, source, F.col(key).alias("_key"), F.col(url).alias("_url"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("_key", "_url"), F.lit(SALTS)).cast("int"))
    met = rows.join(rules, ["host", "salt"], "left").select("_key", "_url", "text", "rule")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [extract(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column("rule").to_pylist(), strict=True)]
        return pa.RecordBatch.from_pydict({key: batch.column("_key"), "url": batch.column("_url"), "text": pa.array(found, pa.string())})

    return map_arrow(met, run, f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, text string")
