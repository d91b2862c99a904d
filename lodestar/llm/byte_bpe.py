"""Byte-level BPE: encoding with offsets, and decoding.

The rank file becomes a model of the tokenizers library: each byte is written as one printable character,
and the two parts that a symbol was merged from are found by replaying the lower ranks. Texts are encoded
over Arrow batches. Offsets come from the byte lengths of the ids and a map from bytes to characters, so a
character that is split over ids belongs to each of them.

Null texts count as empty and give no ids. Any text is encoded whole; rows are independent, so repeated ids,
ties and other columns have no influence. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array_column, map_arrow, texts_of
from .word_cache import CachedEncoder, byte_symbols


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(symbol): int(rank) for symbol, rank in map(bytes.split, lines)}


def origin(symbol: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging by rank leaves of ``symbol`` just before it is complete."""
    parts = [symbol[i : i + 1] for i in range(len(symbol))]
    while len(parts) > 2:
        scored = [(ranks.get(a + b, ranks[symbol]), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, at = min(scored)
        if rank >= ranks[symbol]:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=2)
def build_tokenizer(path: str, pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, shown = read_ranks(path), byte_symbols()
    name = {s: "".join(shown[b] for b in s) for s in ranks}
    pairs = (origin(s, ranks) for s in sorted(ranks, key=ranks.get) if len(s) > 1)
    model = models.BPE(vocab={name[s]: r for s, r in ranks.items()}, merges=[(name[p[0]], name[p[1]]) for p in pairs if p], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> CachedEncoder:
    return CachedEncoder(build_tokenizer(path, pattern), lead=" ")


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for symbol, rank in ranks.items():
        table[rank] = symbol
    return table, np.array([len(s) for s in table], np.int64)


def char_offsets(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of every id, in code points."""
    leads = (np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80
    char_of = np.cumsum(leads) - 1
    ends = np.cumsum(lengths[ids])
    return char_of[ends - lengths[ids]], char_of[ends - 1] + 1


def encode(df: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text", offsets: bool = True) -> DataFrame:
    """Ids of every text: ``key``, ``ids`` (packed, little-endian unsigned 32 bit) and, with ``offsets``,
    ``starts`` and ``ends`` (arrays of code points, end exclusive)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        packed = _encoder(path, pattern).encode(texts)
        columns = {key: batch.column(key), "ids": pa.array(packed, pa.binary())}
        if offsets:
            spans = [char_offsets(t, np.frombuffer(p, "<u4"), _pieces(path)[1]) for t, p in zip(texts, packed, strict=True)]
            sizes = [len(s) for s, _ in spans]
            for name, k in (("starts", 0), ("ends", 1)):
                columns[name] = array_column(np.concatenate([s[k] for s in spans] or [np.zeros(0)]).astype(np.int32), sizes, pa.int32())
        return pa.RecordBatch.from_pydict(columns)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids binary" + (", starts array<int>, ends array<int>" if offsets else "")
    return map_arrow(df.select(F.col(key), F.col(text).alias("text")), run, schema)


def decode(df: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids", as_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bytes behind packed ids: ``key``, ``ids``, the columns of ``keep``, ``decoded`` (binary) and, with ``as_text``, ``text``, in which bytes
    that form no character, as ids that stop within one leave them, become U+FFFD."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = _pieces(path)[0].__getitem__
        raw = [b"".join(map(get, np.frombuffer(p or b"", "<u4").tolist())) for p in batch.column("ids").to_pylist()]
        columns = {**{c: batch.column(c) for c in (key, "ids", *keep)}, "decoded": pa.array(raw, pa.binary())}
        if as_text:
            columns["text"] = pa.array([r.decode("utf-8", errors="replace") for r in raw], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    kind = df.schema[key].dataType.simpleString()
    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(df.select(F.col(key), F.col(ids).alias("ids"), *keep), run, f"`{key}` {kind}, ids binary{kept}, decoded binary" + (", text string" if as_text else ""))
