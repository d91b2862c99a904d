"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, plus signs, schemes and identifier cues; runs of digits anchor
the numbers. A local parser grows each anchor to its left and right and validates what it has: nothing else of the
text is looked at, so the work is linear in the text whatever it holds.

Kinds, in this order: ``email``, ``ip``, ``card``, ``phone`` (the base: leftmost non-overlapping matches of fixed
patterns, failing matches dropped), ``address`` (URL with user information, an e-mail address or a session or
account parameter in it) and ``account`` (the value behind an identifier cue and perhaps words like "number" or "is":
IBAN with its check digits, also written in groups, account numbers, passwords, tokens and keys that hold a digit, of
any length).

Null texts count as empty and have no spans. Rows are independent, so repeated rows and ties have no influence; an
empty table gives an empty table; other columns are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts_of

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE_KINDS = KINDS[:4]

_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DIGITS = frozenset("0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_DIAL = _DIGITS | frozenset(" ().-")
_SECRET = _ALNUM | frozenset("_-.+/=")
_URL_END = frozenset(" \t\n\x0b\x0c\r\"'<>`{}|\\^")

#: Words that announce an identifier.
CUES = (
    "account", "acct", "iban", "ssn", "passport", "password", "passwd", "token", "secret", "bearer",
    "api_key", "apikey", "api-key", "api key", "access_key", "accesskey", "access-key", "access key",
)
_SCHEME, _AT, _PLUS, _CUE = range(4)
_RUN = re.compile("[0-9]+")
#: Places where a parameter with a value starts; a look-ahead, so one within another's value is found too.
_SENSITIVE = re.compile(r"(?=[?&;](?:account|acct|iban|ssn|token|session|sessionid|sid|user|uid|email)=[^&#;])", re.I)
#: What may stand between a cue and its value.
_LINK = re.compile(r"""[_-]?(?:numbers?|num|nr|no|id|key|is|was)(?:(?=[ :=#"'])|\.(?=[ :=#"'0-9]))|[ :=#"']""", re.I)
#: Groups of an IBAN; further ones in the same case.
_IBAN_HEAD, _GROUP, _LOWER_GROUP = re.compile(r"[A-Za-z]{2} ?[0-9]{2}"), re.compile(r" ?[A-Z0-9]+"), re.compile(r" ?[a-z0-9]+")
#: Shortest value behind a cue, and most letters and digits of an IBAN.
VALUE_CHARS, IBAN_CHARS = 6, 34

Span = tuple[int, int]


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word, what in (("://", _SCHEME), ("@", _AT), ("+", _PLUS), *((c, _CUE) for c in CUES)):
        machine.add_word(word, (what, len(word)))
    machine.make_automaton()
    return machine


def _back(text: str, at: int, stop: int, chars: frozenset) -> int:
    while at > stop and text[at - 1] in chars:
        at -= 1
    return at


def _on(text: str, at: int, chars: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email_at(text: str, at: int, free: int) -> Span | None:
    """The address around the at-sign at ``at``; nothing left of ``free`` belongs to it."""
    start = _back(text, at, free, _LOCAL)
    end = _on(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _LABEL:
        end = _on(text, end + 1, _LABEL)
        labels += 1
    return (start, end) if labels else None


def phone_at(text: str, at: int) -> Span | None:
    """The longest dialling string from the plus sign at ``at`` that ends with a digit."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _on(text, at + 2, _DIAL)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return (at, end) if end > at + 3 and text[end - 1] in _DIGITS else None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def chains(text: str, runs: list[Span]) -> tuple[list[list[Span]], list[list[Span]]]:
    """Runs of digits joined by single dots, and by nothing but single spaces or hyphens."""
    dots, gaps = [], []
    for run in runs:
        if dots and dots[-1][-1][1] + 1 == run[0] and text[run[0] - 1] == ".":
            dots[-1].append(run)
        else:
            dots.append([run])
        if gaps and gaps[-1][-1][1] + 1 == run[0] and text[run[0] - 1] in " -":
            gaps[-1].append(run)
        else:
            gaps.append([run])
    return dots, gaps


def ips_of(text: str, dots: list[list[Span]]) -> list[Span]:
    out = []
    for chain in dots:
        for k in range(0, len(chain) - 3, 4):
            quad = chain[k : k + 4]
            if all(b - a < 4 or not text[a:b].lstrip("0")[3:] for a, b in quad) and all(int(text[a:b].lstrip("0")[:4] or 0) <= 255 for a, b in quad):
                out.append((quad[0][0], quad[3][1]))
    return out


def cards_of(text: str, gaps: list[list[Span]]) -> list[Span]:
    out = []
    for chain in gaps:
        n = sum(b - a for a, b in chain)
        if 13 <= n <= 19 and luhn("".join(text[a:b] for a, b in chain)):
            out.append((chain[0][0], chain[-1][1]))
    return out


class Urls:
    """What URLs of one text hold. Those that end together are walked through once, whether they point to a person or not."""

    def __init__(self, text: str):
        self.text = text
        self.known = self.last = self.stop = 0
        self.mark = -1

    def look(self, at: int) -> tuple[int, int]:
        """End of the URL whose rest starts at ``at``, and the last place in it that points to a person."""
        if not self.known <= at < self.last:
            end = at
            while end < len(self.text) and self.text[end] not in _URL_END:
                end += 1
            self.known = at
            self.last = self.stop = end
            while self.stop > at and self.text[self.stop - 1] in ".,;:!?)]":
                self.stop -= 1
            marks = (m.start() for m in _SENSITIVE.finditer(self.text, at, self.stop))
            self.mark = max(self.text.rfind("@", at, self.stop), *marks, -1)
        return max(at, self.stop), self.mark


def url_at(text: str, at: int, free: int, urls: Urls) -> Span | None:
    """The URL around the ``://`` at ``at``, if it points to a person."""
    start = _back(text, at, free, _ALNUM)
    end, mark = urls.look(at + 3)
    return (start, end) if start < at and end > at + 3 and mark >= at + 3 else None


def iban(value: str) -> bool:
    value = value.replace(" ", "").upper()
    if not 15 <= len(value) <= IBAN_CHARS or not value[:2].isalpha() or not value.isalnum() or not value.isascii():
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def spaced_iban(text: str, at: int) -> Span | None:
    """The longest IBAN from ``at`` that is written in groups with single spaces."""
    head = _IBAN_HEAD.match(text, at)
    if not head:
        return None
    group = _LOWER_GROUP if text[at].islower() else _GROUP
    end, size, found = head.end(), 4, None
    while m := group.match(text, end, end + IBAN_CHARS + 2):
        size += len(m[0].lstrip())
        if size > IBAN_CHARS:
            break
        end = m.end()
        if (end == len(text) or not text[end].isalnum()) and iban(text[at:end]):
            found = (at, end)
    return found


class Values:
    """Ends of the values of one text, and the digits in them. Values that end together are walked through once."""

    def __init__(self, text: str, runs: list[Span]):
        self.text, self.starts = text, [a for a, _ in runs]
        self.before = [0, *accumulate(b - a for a, b in runs)]
        self.known = self.last = self.stop = 0

    def end(self, at: int) -> int:
        if not self.known <= at < self.last:
            self.known, self.last = at, _on(self.text, at, _SECRET)
            self.stop = self.last
            while self.stop > at and self.text[self.stop - 1] in ".-=":
                self.stop -= 1
        return max(at, self.stop)

    def digits(self, at: int, stop: int) -> int:
        """Digits from ``at``, which isn't within a run of digits, up to ``stop``, which isn't either."""
        return self.before[bisect_left(self.starts, stop)] - self.before[bisect_left(self.starts, at)]


def account_after(text: str, cue: int, end: int, values: Values) -> Span | None:
    """The identifier behind a cue word: separators and link words, perhaps quotes, then one value with a digit in it."""
    marked = text[cue:end].lower() == "bearer"
    if text[end : end + 1] in ("s", "S"):  # several of them
        end += 1
    if cue and (text[cue - 1].isalnum() or text[cue - 1] == "_") or end < len(text) and text[end].isalnum():
        return None
    at = end
    while m := _LINK.match(text, at):
        marked |= m[0][-1] in ":=#" or m[0].lower() in ("is", "was")
        at = m.end()
    stop, span = values.end(at), spaced_iban(text, at)
    if span and span[1] > stop:
        return span
    digits = values.digits(at, stop)
    if stop - at < VALUE_CHARS or not digits:
        return None
    return (at, stop) if marked or span or digits >= 6 or stop - at <= IBAN_CHARS and iban(text[at:stop]) else None


def spans_of(text: str) -> dict[str, list[Span]]:
    """Spans of every kind, in code points, ends exclusive."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)

    def take(kind: str, span: Span | None, valid: bool = True) -> None:
        if span and span[0] >= free[kind]:
            free[kind] = span[1]
            if valid:
                found[kind].append(span)

    runs = [m.span() for m in _RUN.finditer(text)]
    values, urls = Values(text, runs), Urls(text)
    lowered = text if text.islower() else _ascii_lower(text)
    for last, (what, n) in _anchors().iter(lowered):
        at = last - n + 1
        if what == _AT:
            if at >= free["email"]:
                take("email", email_at(text, at, free["email"]))
        elif what == _PLUS:
            if at >= free["phone"] and (span := phone_at(text, at)):
                take("phone", span, 9 <= sum(c in _DIGITS for c in text[span[0] : span[1]]) <= 15)
        elif what == _SCHEME:
            if at >= free["address"]:
                take("address", url_at(text, at, free["address"], urls))
        elif at >= free["account"]:
            take("account", account_after(text, at, last + 1, values))
    if len(runs) > 3 or runs and runs[-1][1] - runs[0][0] > 12:
        dots, gaps = chains(text, runs)
        found["ip"], found["card"] = ips_of(text, dots), cards_of(text, gaps)
    return found


_LOWER = {c: c + 32 for c in range(65, 91)}


def _ascii_lower(text: str) -> str:
    """Lower case of A-Z only, so that positions stay."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def digest(found: dict[str, list[Span]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def find(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, a count per kind, ``base_sha256`` and ``spans`` (kind:start:end, comma-joined)."""
    counts = [f"n_{k}" for k in KINDS]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans_of(t) for t in texts_of(batch)]
        columns = {key: batch.column(key)}
        for kind, name in zip(KINDS, counts, strict=True):
            columns[name] = pa.array([len(f[kind]) for f in found], pa.int64())
        columns["base_sha256"] = pa.array([hashlib.sha256(digest(f, BASE_KINDS).encode()).hexdigest() for f in found], pa.string())
        columns["spans"] = pa.array([digest(f) for f in found], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} bigint" for c in counts) + ", base_sha256 string, spans string"
    return map_arrow(df.select(F.col(key), F.col(text).alias("text")), run, schema)


def masked(text: str) -> str:
    """Every span replaced by ``<KIND>``; spans that overlap are masked as one, of the kind that starts first (then the longer)."""
    spans = sorted((a, -b, k) for k, found in spans_of(text).items() for a, b in found)
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]]) if spans else text


def mask(df: DataFrame, *, text: str = "text") -> DataFrame:
    """``df`` with personal data masked in ``text``; null texts stay null, all other columns stay."""
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = pa.array([None if t is None else masked(t) for t in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([clean if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_arrow(df, run, df.schema)
