"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers cut the bytes of a space and the text. Token-byte incidence matrices A and B are built as CSR by hand,
for all texts of a slice at once (block diagonal). The row-wise product A * B^T (Gustavson) has an entry, the number of
shared bytes, for every pair of tokens that overlap: the overlap links. Bytes on which tokens of both sides end
cut the tokens into groups; the group-token incidence matrices G_A and G_B give the shared-group links as
G_A^T * G_B. Its rows all have the size of their group's other side, so links are counted without being formed and
stay factored (a group with its tokens), however long a group is.

Texts are cut once; ids are kept as packed numbers and links formed again where they are needed. Counts of linked id
pairs over the corpus are summed in every task before they are shuffled. The pairs seen most often, at most ``HEAD_PAIRS``,
travel to the tasks as one array; all others of a text are looked up by a join, so no link is left out.

Null and empty texts have no tokens; nor have texts whose tokens' bytes aren't those of the space and the text (a tokenizer
that changes characters). Their counts are 0 and the digest is empty. Every text is cut whole; rows are independent but
for the pair counts, in which repeated rows count as often as they are given. Ties for a best pair all count.
An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, array_column, map_arrow, slices, texts_of
from .word_cache import byte_symbols

#: Pairs whose counts travel to the tasks, and pairs that a task gathers before it passes them on.
HEAD_PAIRS, FLUSH_PAIRS = 1 << 18, 400_000
#: Bytes of ids whose links are formed at once (a single longer text is still taken whole).
LINK_BYTES = 400_000
#: Entries that a product may form before equal ones are summed.
PRODUCT_ENTRIES = 1 << 22


@dataclass
class Csr:
    """Compressed sparse rows: the entries of row ``i`` are ``indptr[i]:indptr[i + 1]``; all values are 1 unless given."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int
    values: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        sizes = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.concatenate([[0], np.cumsum(sizes)]), self.row_of()[order], self.rows, None if self.values is None else self.values[order])

    def work(self, other: Csr) -> np.ndarray:
        """Entries that each row of the product forms before equal ones are summed."""
        sizes = np.concatenate([[0], np.cumsum(np.diff(other.indptr)[self.indices])])
        return sizes[self.indptr[1:]] - sizes[self.indptr[:-1]]

    def times(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, value) of the product, row by row, in blocks of rows that form a bounded number of entries."""
        ends = np.cumsum(self.work(other))
        at = 0
        while at < self.rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PRODUCT_ENTRIES, side="right")))
            yield self._block(other, at, to)
            at = to

    def _block(self, other: Csr, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = self.indices[self.indptr[at] : self.indptr[to]]
        row = np.repeat(np.arange(at, to, dtype=np.int32), np.diff(self.indptr[at : to + 1]))
        value = None if self.values is None else self.values[self.indptr[at] : self.indptr[to]]
        sizes = np.diff(other.indptr)[mine]
        if (sizes == 1).all():
            place = other.indptr[mine]
        else:  # the entries of the other matrix's rows, one row after another
            place = np.arange(sizes.sum()) + np.repeat(other.indptr[mine] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            row = np.repeat(row, sizes)
            value = None if value is None else np.repeat(value, sizes)
        column = other.indices[place]
        if other.values is not None:
            value = other.values[place] if value is None else value * other.values[place]
        same_row, step = row[1:] == row[:-1], np.diff(column)
        if (same_row & (step < 0)).any():
            order = np.lexsort((column, row))
            row, column, value = row[order], column[order], None if value is None else value[order]
            same_row, step = row[1:] == row[:-1], np.diff(column)
        starts = np.flatnonzero(np.concatenate([[True], ~same_row | (step != 0)])) if len(row) else np.zeros(0, np.int64)
        if value is None:
            summed = np.diff(np.concatenate([starts, [len(row)]]))
        else:
            summed = np.add.reduceat(value, starts) if len(starts) else value
        return row[starts], column[starts], summed


def incidence(lengths: np.ndarray) -> Csr:
    """Token-byte matrix of tokens that stand one after another."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(ends, np.arange(ends[-1], dtype=np.int32), int(ends[-1]))


class Aligned:
    """Links and groups of the tokens of several texts, from their ids and the texts' token numbers."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        self.first_a, self.first_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        self.A, self.B = incidence(a_lengths[self.a]), incidence(b_lengths[self.b])
        blocks = list(self.A.times(self.B.transposed()))
        self.row, self.column, self.shared = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in blocks)]) for k in range(3))
        ends = np.zeros((2, self.A.columns + 1), bool)
        ends[0, self.A.indptr[1:]] = ends[1, self.B.indptr[1:]] = True
        cut = np.cumsum(ends[0] & ends[1])
        # groups that end before a token's first byte
        self.group_a, self.group_b = cut[self.A.indptr[:-1]], cut[self.B.indptr[:-1]]
        self.groups = int(cut[-1]) if len(self.a) else 0

    def text_of_links(self) -> np.ndarray:
        return np.searchsorted(self.first_a, self.row, side="right") - 1

    def groups_of_texts(self) -> np.ndarray:
        """Number of groups up to each text's end, from 0 on."""
        upto = np.concatenate([self.group_a, [self.groups]])
        return upto[self.first_a]

    def group_matrices(self) -> tuple[Csr, Csr]:
        """Group-token matrices of both sides."""
        sides = []
        for group in (self.group_a, self.group_b):
            sizes = np.bincount(group, minlength=self.groups)
            sides.append(Csr(np.concatenate([[0], np.cumsum(sizes)]), np.arange(len(group)), len(group)))
        return sides[0], sides[1]

    def shared_group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) of all pairs of one group, in bounded blocks."""
        g_a, g_b = self.group_matrices()
        yield from g_a.transposed().times(g_b)

    def shared_group_counts(self) -> np.ndarray:
        """Shared-group links of each A token, without forming them."""
        g_a, g_b = self.group_matrices()
        return g_a.transposed().work(g_b)

    def written(self, names: Names) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        n_a, n_b = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        last_a = np.zeros(len(self.a), bool)
        last_a[upto_a - 1] = True
        last_b = np.zeros(len(self.b), bool)
        last_b[upto_b - 1] = True
        code[np.arange(len(self.a)) + (upto_b - n_b)[self.group_a]] = self.a + np.where(last_a, names.size, 0)
        code[np.arange(len(self.b)) + upto_a[self.group_b]] = self.b + np.where(last_b, 2 * names.size, 0)
        bounds = (self.first_a + self.first_b).tolist()
        codes, get = code.tolist(), names.table.__getitem__
        return ["".join(map(get, codes[s:e]))[:-1] for s, e in zip(bounds, bounds[1:], strict=False)]


class Names:
    """Decimal ids followed by a comma, a bar or a semicolon."""

    def __init__(self, size: int):
        self.size = size
        self.table = [f"{i}{mark}" for mark in ",|;" for i in range(size)]


@lru_cache(maxsize=2)
def _names(size: int) -> Names:
    return Names(size)


class PieceEncoder:
    """Ids of whole texts by a sentencepiece model, which puts the first space there by itself."""

    lossless = False

    def __init__(self, model):
        self.model = model

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in spaced], num_threads=1)


# Fixed value: the words that byte-level vocabularies of this kind are trained and applied on.
BYTE_LEVEL_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with a longer run of white space go to the tokenizers library, for the other one's pattern matching can't hold it.
LONG_RUN = re.compile(r"\s{2000}")


class ByteLevelEncoder:
    """Ids of whole texts by a byte-level vocabulary. Where its merges stand in the order of their ids, and its words are the usual ones,
    it is the same as a rank table, which the tiktoken library applies several times faster."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        vocabulary = about["model"]["vocab"]
        self.table = [b""] * (max([*vocabulary.values(), *(t["id"] for t in about["added_tokens"])]) + 1)
        for written, i in vocabulary.items():
            self.table[i] = bytes(byte_of[c] for c in written) if all(c in byte_of for c in written) else written.encode()
        self.ranks = self._ranks(about, {self.table[i]: i for i in vocabulary.values()})
        #: a rank table holds all bytes, so its ids always have the bytes of the text
        self.lossless = self.ranks is not None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def _ranks(self, about: dict, ids: dict[bytes, int]):
        cut, merges = about["pre_tokenizer"], about["model"]["merges"]
        usual = about["normalizer"] is None and cut == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": cut.get("trim_offsets"), "use_regex": True}
        made = [about["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if not usual or made != sorted(set(made)) or len(set(ids)) < 256 + len(made):
            return None
        import tiktoken

        kept = {s: ids[s] for s in ids if len(s) == 1} | {self.table[i]: i for i in made}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=kept, special_tokens={})

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return [self._ids(t) for t in spaced]

    def _ids(self, text: str) -> list[int]:
        if self.ranks is None or LONG_RUN.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


@lru_cache(maxsize=2)
def byte_level(path: str) -> tuple[ByteLevelEncoder, list[bytes]]:
    """Encoder of a byte-level vocabulary and the bytes of its ids; strings of special tokens are ordinary text."""
    encoder = ByteLevelEncoder(path)
    return encoder, encoder.table


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[PieceEncoder, list[bytes]]:
    """Encoder of a sentencepiece model and the bytes of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return PieceEncoder(model), table


def id_type(table) -> str:
    """Packed ids are little-endian unsigned numbers of 16 bits (``H``) where the vocabulary fits in them, else of 32 bits (``I``)."""
    return "H" if len(table) <= 1 << 16 else "I"


@lru_cache(maxsize=4)
def _lengths(load, path: str) -> np.ndarray:
    return np.array([len(x) for x in load(path)[1]], np.int64)


def tokens(docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``a`` and ``b``: ids of every text by both vocabularies (packed, see ``id_type``); empty where the text has no tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spaced = [" " + t if t else "" for t in texts_of(batch)]
        sides = []
        for load, path in ((byte_level, a_path), (pieces, b_path)):
            encoder, table = load(path)
            get, kind = table.__getitem__, id_type(table)
            ids = encoder.encode(spaced)
            whole = [encoder.lossless or b"".join(map(get, i)) == t.encode() for i, t in zip(ids, spaced, strict=True)]
            sides.append(([array(kind, i).tobytes() for i in ids], whole))
        (a, a_whole), (b, b_whole) = sides
        both = [x and y and t != "" for x, y, t in zip(a_whole, b_whole, spaced, strict=True)]
        return pa.RecordBatch.from_pydict({
            key: batch.column(key), **{name: pa.array([i if ok else b"" for i, ok in zip(ids, both, strict=True)], pa.binary()) for name, ids in (("a", a), ("b", b))},
        })

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key), F.col(text).alias("text")), run, f"`{key}` {kind}, a binary, b binary")


def _aligned(batch: pa.RecordBatch, a_path: str, b_path: str) -> Aligned:
    rows = [batch.column(c).to_pylist() for c in ("a", "b")]
    lengths = [_lengths(byte_level, a_path), _lengths(pieces, b_path)]
    ids = [np.frombuffer(b"".join(r), id_type(n)) for r, n in zip(rows, lengths, strict=True)]
    sizes = [np.array([len(x) for x in r], np.int64) // i.itemsize for r, i in zip(rows, ids, strict=True)]
    return Aligned(*ids, *sizes, *lengths)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "a", LINK_BYTES)


def links(cut: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id") -> DataFrame:
    """Overlap links of every row of ``tokens``: ``key``, arrays a_at, b_at (places of the tokens) and n_bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _aligned(batch, a_path, b_path)
        text = found.text_of_links()
        sizes = np.bincount(text, minlength=batch.num_rows)
        columns = (("a_at", found.row - found.first_a[text]), ("b_at", found.column - found.first_b[text]), ("n_bytes", found.shared))
        return pa.RecordBatch.from_pydict({key: batch.column(key), **{c: array_column(v.astype(np.int32), sizes, pa.int32()) for c, v in columns}})

    kind = cut.schema[key].dataType.simpleString()
    return cut.select(key, "a", "b").mapInArrow(lambda batches: map(run, _parts(batches)), f"`{key}` {kind}, a_at array<int>, b_at array<int>, n_bytes array<int>")


def groups(cut: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id") -> DataFrame:
    """Groups of every row of ``tokens``: ``key``, arrays a_group and b_group, the group of each token, counted from 0. Two tokens are
    linked by their group where the numbers are equal."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _aligned(batch, a_path, b_path)
        start = found.groups_of_texts()[:-1]
        columns = {key: batch.column(key)}
        for name, group, first in (("a_group", found.group_a, found.first_a), ("b_group", found.group_b, found.first_b)):
            sizes = np.diff(first)
            columns[name] = array_column((group - np.repeat(start, sizes)).astype(np.int32), sizes, pa.int32())
        return pa.RecordBatch.from_pydict(columns)

    kind = cut.schema[key].dataType.simpleString()
    return cut.select(key, "a", "b").mapInArrow(lambda batches: map(run, _parts(batches)), f"`{key}` {kind}, a_group array<int>, b_group array<int>")


def pair_counts(cut: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n): how many overlap links of the corpus hold the ids ``pair // n_b`` and ``pair % n_b``, n_b the size of B's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_b = len(_lengths(pieces, b_path))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pair, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, back = np.unique(pair, return_inverse=True)
            return u, np.bincount(back, weights=n, minlength=len(u)).astype(np.int64)

        def rows(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(n)})

        for part in _parts(batches):
            found = _aligned(part, a_path, b_path)
            held.append(np.unique(found.a[found.row] * n_b + found.b[found.column], return_counts=True))
            if sum(len(x[0]) for x in held) > FLUSH_PAIRS:
                held = [merged()]
                if len(held[0][0]) > FLUSH_PAIRS // 2:
                    yield rows(*held.pop())
        if held:
            yield rows(*merged())

    return cut.select("a", "b").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _head(judged: DataFrame) -> tuple[dict[str, np.ndarray], int]:
    """The pairs that occur at least ``2 ** k`` times, for the smallest k that leaves few enough, and that bound."""
    steps = {r["k"]: r["v"] for r in judged.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("v")).collect()}
    k = 64
    while k > 0 and sum(v for step, v in steps.items() if step >= k - 1) <= HEAD_PAIRS:
        k -= 1
    rows = judged.filter(F.floor(F.log2("n")) >= k).toPandas().sort_values("pair")
    return {"pair": rows["pair"].to_numpy(np.int64), "n": rows["n"].to_numpy(np.int64), "best": rows["best"].to_numpy(bool)}, k


def _summed(head, a_path: str, b_path: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_b = len(_lengths(pieces, b_path))
        names = _names(max(len(_lengths(byte_level, a_path)), n_b))
        known = head.value
        for part in _parts(batches):
            found = _aligned(part, a_path, b_path)
            n_rows = part.num_rows
            text = found.text_of_links()
            pair = found.a[found.row] * n_b + found.b[found.column]
            place = np.minimum(np.searchsorted(known["pair"], pair), max(len(known["pair"]) - 1, 0))
            seen = known["pair"][place] == pair if len(known["pair"]) else np.zeros(len(pair), bool)
            rest = np.flatnonzero(~seen)
            # distinct (row, pair) of the others, with their number
            order = rest[np.lexsort((pair[rest], text[rest]))]
            p, r = pair[order], text[order]
            starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (r[1:] != r[:-1])])) if len(order) else order
            repeats = np.diff(np.concatenate([starts, [len(order)]]))
            sizes = np.bincount(r[starts], minlength=n_rows)
            shared = np.concatenate([[0], np.cumsum(found.shared_group_counts())])
            digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in found.written(names)]
            in_head, bounds = place[seen], np.searchsorted(text[seen], np.arange(n_rows + 1))
            upto = [np.concatenate([[0], np.cumsum(known[c][in_head], dtype=np.int64)])[bounds] for c in ("best", "n")]
            yield pa.RecordBatch.from_pydict({
                key: part.column(key), "n_a": pa.array(np.diff(found.first_a)), "n_b": pa.array(np.diff(found.first_b)),
                "n_groups": pa.array(np.diff(found.groups_of_texts())), "n_links": pa.array(np.bincount(text, minlength=n_rows)),
                "n_shared": pa.array(np.diff(shared[found.first_a])),
                "head_best": pa.array(np.diff(upto[0])), "head_sum": pa.array(np.diff(upto[1])),
                "groups_sha256": pa.array(digests, pa.string()),
                "rest": array_column(p[starts], sizes, pa.int64()), "times": array_column(repeats.astype(np.int32), sizes, pa.int32()),
            })

    return run


def align(docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``key``, n_a, n_b, n_groups, n_links, n_shared (shared-group links), n_best (links whose pair is its B id's most
    frequent), count_sum (pair counts over links) and groups_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    cut = scratch.keep(tokens(docs, a_path, b_path, key=key, text=text), "tokens")
    n_b = len(pieces(b_path)[1])
    counts = scratch.keep(pair_counts(cut, a_path, b_path).withColumn("b", (F.col("pair") % n_b).cast("int")), "counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # at most one row per id of B
    judged = counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    head, k = _head(judged)
    kind = docs.schema[key].dataType.simpleString()
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_shared", "head_best", "head_sum")
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} bigint" for c in numbers) + ", groups_sha256 string, rest array<bigint>, times array<int>"
    summed = cut.mapInArrow(_summed(spark.sparkContext.broadcast(head), a_path, b_path, key), schema)
    part = scratch.keep(summed.withColumn("_row", F.monotonically_increasing_id()), "summed")
    scratch.drop("tokens")
    rest = part.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("t")).select("_row", F.col("t.rest").alias("pair"), F.col("t.times").alias("times"))
    tail = judged.filter(F.floor(F.log2("n")) < k)
    found = rest.join(tail, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rest_best"), F.sum(F.col("times") * F.col("n")).alias("rest_sum"))
    return part.drop("rest", "times").join(found, "_row", "left").select(
        key, "n_a", "n_b", "n_groups", "n_links", "n_shared",
        (F.col("head_best") + F.coalesce("rest_best", F.lit(0))).alias("n_best"),
        (F.col("head_sum") + F.coalesce("rest_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
