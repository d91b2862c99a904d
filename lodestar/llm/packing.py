"""Best-fit packing with certified bin counts.

Texts become subword ids plus an end id; documents longer than a sequence are cut into pieces. Pieces are dealt
over partitions by hash and each partition packs its own by best-fit decreasing. Dual feasible functions give a
lower bound of its bin count. A partition that meets its bound keeps all bins but its emptiest one; a partition
with a gap to the bound gives up its emptiest bins, as many as have the room to close the gap. What was given up is
dealt over as many partitions as its number of pieces needs and packed again. Rounds end with one partition or when a
round saves next to nothing; a round that needs no fewer bins is dropped and the bins given up before it stay.

Null texts count as empty (the end id alone). Repeated rows are packed as separate rows. Ties in length are broken
by id and piece. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, texts_of
from .word_cache import CachedEncoder

#: Tokens of a sequence.
SEQUENCE = 4096
#: Id that ends every document.
END_ID = 1
#: Pieces packed by one task.
PIECES_PER_TASK = 40_000
#: A round that saves fewer of its bins than one in this many is the last.
WORTH = 500

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
PACK_SCHEMA = "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, given_up boolean"


@lru_cache(maxsize=2)
def _encoder(path: str) -> CachedEncoder:
    from tokenizers import Tokenizer

    return CachedEncoder(Tokenizer.from_file(path), lead="")


def pieces(df: DataFrame, path: str, *, size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Cut every text into pieces of at most ``size`` ids: doc_id, piece, start, length, ids_crc32, ids (packed)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, ids in zip(batch.column("doc_id").to_pylist(), _encoder(path).encode(texts_of(batch)), strict=True):
            ids += end
            for at in range(0, len(ids), 4 * size):
                part = ids[at : at + 4 * size]
                for name, value in zip(rows, (doc, at // (4 * size), at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                    rows[name].append(value)
        kinds = dict(zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))
        return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    out = map_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), run, PIECE_SCHEMA)
    return out if with_ids else out.drop("ids")


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that ``lengths`` need at least: the best of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    items, tokens = np.cumsum(count), np.cumsum(count * x)
    cut = np.arange(0, size // 2 + 1)
    # sizes over size - cut count as whole bins, sizes under cut as nothing, the rest as they are
    whole = items[-1] - items[size - cut]
    middle = tokens[size - cut] - np.where(cut > 0, tokens[cut - 1], 0)
    best = int(np.max(-(-(whole * size + middle) // size)))
    for k in range(1, 33):
        # sizes are rounded to k-ths of a bin unless (k + 1) of them fill bins exactly; in units of size * k
        scaled = (k + 1) * x
        value = np.where(scaled % size == 0, x * k, scaled // size * size)
        best = max(best, int(-(-int(np.dot(count, value)) // (size * k))))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of lengths in the order given: bin and offset of each item, room left in each bin.

    ``open_bins[g]`` holds the bins with room ``g``; bit ``g`` of ``mask`` says whether there is one.
    """
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    mask, room, where, at = 0, [], np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = open_bins[gap].pop()
            if not open_bins[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b = size, len(room)
            room.append(size)
        where[i], at[i] = b, size - gap
        room[b] = gap - n
        if gap > n:
            open_bins[gap - n].append(b)
            mask |= 1 << (gap - n)
    return where, at, np.array(room, np.int64)


def given_up(room: np.ndarray, bound: int, size: int) -> np.ndarray:
    """Which bins to pack again: the emptiest one, and with a gap to the bound the emptiest ones that have room to close it."""
    give = np.zeros(len(room), bool)
    order = np.argsort(-room, kind="stable")
    order = order[room[order] > 0]
    gap = len(room) - bound
    if gap > 0:
        free = np.cumsum(room[order])
        give[order[: int(np.searchsorted(free, (gap + 1) * size)) + 1]] = True
    else:
        give[order[:1]] = True
    return give


def _pack_partition(size: int, last: bool, base: int):
    def run(frames):
        frames = list(frames)
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        if rows.empty:
            return
        lengths = rows["length"].to_numpy()
        where, at, room = best_fit(lengths, size)
        give = np.zeros(len(room), bool) if last else given_up(room, lower_bound(lengths, size), size)
        rows["sequence_id"] = base + rows.pop("task").to_numpy() * (1 << 24) + where
        rows["offset"], rows["given_up"] = at, give[where]
        yield rows

    return run


def pack(rows: DataFrame, *, size: int = SEQUENCE, per_task: int = PIECES_PER_TASK, scratch: Scratch | None = None) -> DataFrame:
    """Assign pieces (doc_id, piece, start, length, ids_crc32) to sequences: adds sequence_id and offset.

    Pieces that carry their ``ids`` get them back by a join on a row number; the rounds move lengths only.
    """
    scratch = scratch or Scratch(rows.sparkSession, "packing")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = ["ids"] if "ids" in rows.columns else []
    stored = scratch.keep(rows.select(F.monotonically_increasing_id().alias("row"), *columns, *ids), "pieces")
    pool = stored.drop("ids")
    left, bins, level, done, before = pool.count(), None, 0, [], None
    while True:
        tasks = max(1, -(-left // per_task))
        dealt = pool.repartition(1) if tasks == 1 else pool.repartition(tasks, F.xxhash64("row", F.lit(level)))
        dealt = dealt.withColumn("task", F.spark_partition_id().cast("long"))
        dealt = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
        packed = scratch.keep(dealt.mapInPandas(_pack_partition(size, tasks == 1, level << 56), PACK_SCHEMA), f"round{level}")
        # every bin has one piece at its start
        now = packed.agg(F.count_if(F.expr("offset = 0")).alias("used"), F.count_if(F.expr("offset = 0 and given_up")).alias("bins"), F.count_if("given_up").alias("left")).first()
        if bins is not None and now["used"] >= bins:
            done.append(before.filter("given_up"))
            scratch.drop(f"round{level}")
            break
        small = bins is not None and (bins - now["used"]) * WORTH < bins
        if not now["left"] or small:
            done.append(packed)
            break
        done.append(packed.filter("not given_up"))
        pool = packed.filter("given_up").drop("sequence_id", "offset", "given_up")
        left, bins, before, level = now["left"], now["bins"], packed, level + 1
    out = done[0].drop("given_up")
    for part in done[1:]:
        out = out.unionByName(part.drop("given_up"))
    if ids:
        return out.join(stored.select("row", "ids"), "row").drop("row")
    scratch.drop("pieces")
    return out.drop("row")
