"""Subword ids of texts through the tokenizers library, asked once per distinct word of a task."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Entries of the young half of the cache. A full half becomes the old one, from which words that come back are taken
#: over; this changes time only.
CACHE_WORDS = 80_000
#: Longer words are encoded each time.
CACHE_CHARS = 48

#: Full stops and commas that touch anything but white space and plain letters and digits, so may belong to a run of marks.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_PLAIN = f"{_LATIN}0-9 \\t\\n\\r"
_TOUCH = re.compile(f"[.,](?=[^{_PLAIN}])|(?<=[^{_PLAIN}])[.,]")
_WORD = re.compile(f"[{_LATIN}]+")
_RUN = re.compile(r"\s ")
_SPLIT = re.compile(r"(?<!\s) ")


@lru_cache(maxsize=1)
def byte_symbols() -> tuple[str, ...]:
    """Character that stands for each byte: itself if it prints in Latin-1, else the next free one from 256."""
    shows = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    hidden = [b for b in range(256) if not shows[b]]
    return tuple(chr(b) if shows[b] else chr(256 + hidden.index(b)) for b in range(256))


class CachedEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A text is cut before each space that follows no white space. Neither vocabulary joins symbols over such a
    cut, so the ids of a text are the joined ids of its parts; ``lead`` puts the space back before all parts
    but the first, for vocabularies whose symbols hold it. Vocabularies without a lead drop white space, so there
    full stops and commas become parts of their own too, in texts where none touches another mark. A part of plain
    letters is one match of either vocabulary's pattern and goes to the library's merges directly; all other parts
    go through its whole chain.
    """

    def __init__(self, tokenizer, lead: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.lead = tokenizer, lead
        self.symbols = dict(enumerate(byte_symbols()))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ask(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _ask_letters(self, words: list[str]) -> list[bytes]:
        merge, shown = self.tokenizer.model.tokenize, self.symbols
        written = words if self.lead else [w.lower() for w in words]
        return [array("I", [t.id for t in merge((self.lead + w).encode().decode("latin-1").translate(shown))]).tobytes() for w in written]

    def _parts(self, text: str) -> list[str]:
        if not self.lead and not _TOUCH.search(text):
            text = text.replace(".", " . ").replace(",", " , ").replace("\n", " ")
            return ["", *text.split(" ")]
        return _SPLIT.split(text) if _RUN.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._parts(t) for t in texts]
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        young, old, rest = self.young, self.old, {}
        new = set().union(*(p[1:] for p in split)).difference(young)
        known = new.intersection(old)
        young.update((w, old[w]) for w in known)
        new = list(new.difference(known))
        letters = [w for w in new if len(w) <= CACHE_CHARS and _WORD.fullmatch(w)]
        young.update(zip(letters, self._ask_letters(letters), strict=True))
        new = list(set(new).difference(letters))
        for word, ids in zip(new, self._ask([self.lead + w for w in new]), strict=True):
            (young if len(word) <= CACHE_CHARS else rest)[word] = ids
        heads = self._ask([p[0] for p in split])
        if not rest:
            get = young.__getitem__
            return [h + b"".join(map(get, p[1:])) for h, p in zip(heads, split, strict=True)]
        return [h + b"".join(young[w] if w in young else rest[w] for w in p[1:]) for h, p in zip(heads, split, strict=True)]
