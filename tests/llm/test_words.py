"""Words as hashes: what a task holds for them, and that blocks don't show."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lodestar.llm import common


def test_memory_stays_near_the_texts():
    column = pa.array(["some words of nine letters or so " * 1000] * 60)
    size = sum(len(t) for t in column.to_pylist())
    common._POWERS.clear()
    common.Words(column.slice(0, 1))  # what is kept for good: powers of a block
    tracemalloc.start()
    words = common.Words(column)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(words.hashes) == 60 * 7000
    assert peak < 24 * size  # eight-byte sums, powers and products of all bytes at once took 43 times
    assert sum(p.nbytes for p in common._POWERS.values()) <= 2 * 8 * (common.HASH_BYTES + 1)


def test_blocks_do_not_show(monkeypatch):
    texts = ["Aa bb  aa", None, "", "x" * 700 + " aa", "bb", " \t", "é aa " * 50]
    whole = common.Words(pa.array(texts))
    for size in (1, 7, 64):
        monkeypatch.setattr(common, "HASH_BYTES", size)
        parts = common.Words(pa.array(texts))
        assert np.array_equal(whole.hashes, parts.hashes)
        assert np.array_equal(whole.first, parts.first)
    aa, bb, again, long, *more = whole.hashes.tolist()
    assert aa == again == more[0] and bb == more[1] and len({aa, bb, long}) == 3
