import random
import re
from collections import Counter, defaultdict

import pytest

from lodestar.llm import jaccard_join

from .hard import TEXTS, by_id, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    """(n_shingles, component) of every row, from all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for h in s:
            holders[h].append(i)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in enumerate(sets):
        for j, common in Counter(j for h in s for j in holders[h] if j < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def answer(spark, rows, size=5, percent=80):
    got = jaccard_join.near_duplicates(documents(spark, rows), words=size, percent=percent).collect()
    return sorted((tuple(r) for r in got), key=repr)


def family(rng, n, words, edits, start):
    """Near copies of one text, some of them copies of copies."""
    texts = [[f"w{rng.randrange(50_000)}" for _ in range(words)]]
    while len(texts) < n:
        copy = list(rng.choice(texts))
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"w{rng.randrange(50_000)}"
        texts.append(copy)
    return [(start + i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("lists", [4_096, 8])
def test_equals_brute_force(spark, monkeypatch, lists):
    monkeypatch.setattr(jaccard_join, "LIST_ENTRIES", lists)
    monkeypatch.setattr(jaccard_join, "MEMBERS_PER_COPY", 7)
    rng = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = family(rng, 60, 120, 3, 0) + family(rng, 60, 40, 2, 1_000) + family(rng, 60, 200, 12, 2_000)
    rows += [(3_000 + i, f"{shared} " + " ".join(f"t{rng.randrange(9_999)}" for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(4_000 + i, f"a b c d e f{i % 3}") for i in range(9)] + [(5_000, "one"), (5_001, "One"), (5_002, "one two")]
    rng.shuffle(rows)
    assert answer(spark, rows) == sorted(brute(rows, 5, 80), key=repr)


def test_hard_rows(spark):
    rows = TEXTS + [(None, "NO id  here"), (12, "\n")]
    assert answer(spark, rows) == sorted(brute(rows, 5, 80), key=repr)
    assert answer(spark, rows[:0]) == []
    kept = by_id(jaccard_join.keep_one(documents(spark, rows)))
    assert {i: len(r) for i, r in kept.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 1, 8: 1, 9: 1, 12: 1}


def test_supplied_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert answer(spark, rows, 4, 85) == sorted(brute(rows, 4, 85), key=repr)
