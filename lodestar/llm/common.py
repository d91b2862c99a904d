"""Helpers shared by the operators: written intermediates, Arrow batches, words as numbers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Rows handled at once inside a task; long texts make a slice smaller, see ``slices``.
SLICE_ROWS = 1024
#: Characters handled at once inside a task (a single longer text is still taken whole).
SLICE_CHARS = 4_000_000


class Scratch:
    """Tables of one run in a folder of its own below ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: computed once, lineage cut, safe against lost executors."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.names.discard(name)

    def release(self, *needed: str) -> None:
        """Delete all tables but those that the result still reads."""
        for name in sorted(self.names.difference(needed)):
            self.drop(name)


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn`` applied to bounded slices of every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                yield from (out.to_batches() if isinstance(out, pa.Table) else [out])

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice has many rows or, unless it is a single row, very much text."""
    if column not in batch.schema.names:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (total + size > chars or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def string_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values joined, n + 1 offsets) of a string column; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


_STEP = np.uint64(0x9E3779B97F4A7C15)
_POLY = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, np.uint64(base))
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


_INVERSE = pow(int(_POLY), -1, 1 << 64)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every byte: 0 for white space, else 1; or 1 for letters (and all beyond ASCII), 2 for digits, 3 for marks."""
    byte = np.arange(256)
    space = (byte == 32) | ((byte >= 9) & (byte <= 13))
    letter = ((byte | 32) >= 97) & ((byte | 32) <= 122) | (byte >= 128)
    runs = np.where(space, 0, np.where(letter, 1, np.where((byte >= 48) & (byte <= 57), 2, 3)))
    return (~space).astype(np.uint8), runs.astype(np.uint8)


_WORD_KIND, _RUN_KIND = (kinds.tobytes() for kinds in _kinds())
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Bytes whose words are hashed at once; a longer word is still taken whole.
HASH_BYTES = 1 << 18


def _translated(raw: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(raw.tobytes().translate(table), np.uint8)


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``raw``. A hash is free of the word's place, so words are taken block by block: powers and
    sums need eight bytes a byte of a block, not of all texts."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            begin = int(starts[at])
            upto = max(at + 1, int(np.searchsorted(ends, begin + HASH_BYTES, side="right")))
            first, last = starts[at:upto] - begin, ends[at:upto] - begin
            size = int(last[-1])
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((raw[begin : begin + size].astype(np.uint64) + np.uint64(1)) * _powers(int(_POLY), size), out=sums[1:])
            local = (sums[last] - sums[first]) * _powers(_INVERSE, size + 1)[first]
            out[at:upto] = mix(local ^ ((last - first).astype(np.uint64) << np.uint64(48)))
            at = upto
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column, A-Z lower-cased, as 64-bit hashes.

    ``hashes``, ``starts``, ``ends`` (bytes) have one entry per word; ``first[i]:first[i + 1]`` are the words
    of row ``i``. With ``runs`` words are cut further, where letters, digits and marks meet. Everything is computed on the joined bytes of the batch, without a loop over texts.
    """

    def __init__(self, array: pa.Array, lower: bool = True, runs: bool = False):
        raw, bounds = string_bytes(array)
        if lower:
            raw = _translated(raw, _LOWER)
        kind = _translated(raw, _RUN_KIND if runs else _WORD_KIND)
        cuts = bounds[1:-1]
        inner = cuts[(cuts > 0) & (cuts < len(raw))]
        change = np.ones(len(raw) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[inner] = True
        solid = kind > 0
        begins, finish = solid & change[:-1], solid & change[1:]
        self.raw, self.bounds = raw, bounds
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.hashes = _word_hashes(raw, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def array_column(values: np.ndarray, lengths: Iterable[int], kind: pa.DataType) -> pa.Array:
    """A list column from joined values and the number of values in each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(np.asarray(lengths), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
