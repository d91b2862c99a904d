import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestar.llm import importance_sampling as sampling
from lodestar.llm import token_alignment as alignment
from tests import oracle

from .hard import TEXTS, by_id, documents
from .test_tokens import fuzz

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


# -- alignment -------------------------------------------------------------------------------------------------------


def whole_ids(texts):
    """Ids of both libraries for whole texts, and the bytes of every token."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(alignment.byte_symbols())}
    for text in texts:
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        yield a, [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a], b, [
            bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]


def brute(texts):
    """Expected rows, by loops over bytes."""
    rows, links, seen = [], [], Counter()
    for text, (a, a_bytes, b, b_bytes) in zip(texts, whole_ids([t or "" for t in texts]), strict=True):
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            rows.append({"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_shared": 0, "groups_sha256": ""})
            links.append([])
            continue
        own_a = [i for i, x in enumerate(a_bytes) for _ in x]
        own_b = [i for i, x in enumerate(b_bytes) for _ in x]
        pairs = sorted(set(zip(own_a, own_b, strict=True)))
        links.append([(a[i], b[j]) for i, j in pairs])
        seen.update(links[-1])
        ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            mine, theirs = [], []
            while i < len(a) and ends_a[i] <= end:
                mine.append(a[i])
                i += 1
            while j < len(b) and ends_b[j] <= end:
                theirs.append(b[j])
                j += 1
            groups.append((mine, theirs))
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append({
            "n_a": len(a), "n_b": len(b), "n_groups": len(groups), "n_links": len(pairs), "n_shared": sum(len(x) * len(y) for x, y in groups),
            "groups_sha256": hashlib.sha256(written.encode()).hexdigest()})
    most = Counter()
    for (_, y), n in seen.items():
        most[y] = max(most[y], n)
    for row, found in zip(rows, links, strict=True):
        row["n_best"] = sum(seen[p] == most[p[1]] for p in found)
        row["count_sum"] = sum(seen[p] for p in found)
    return rows


def odd(n):
    """Texts with characters that the tokenizers cut or change: marks, runs of spaces, special tokens, the space sign, control characters."""
    rng = random.Random(5)
    parts = ["▁", " ▁", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "   ", " \n ", " ", "﻿", "\x00", "ﬁ", "é", "日本語", "🙂", "don't", "x" * 30, " the", "\t", "0123", "\r\n", "ʼn", "Å"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("head", [0, 500, 1 << 18])
def test_alignment_equals_loops(spark, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD_PAIRS", head)
    monkeypatch.setattr(alignment, "FLUSH_PAIRS", 700)
    texts = [None, "", " ", "  ", "a ", *fuzz(300), *odd(500), "the same", "the same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = by_id(alignment.align(docs, A, B))
    for i, want in enumerate(brute(texts)):
        assert {c: got[i][0][c] for c in want} == want, (i, texts[i])


def test_whole_ids_are_those_of_the_libraries():
    texts = [t for t in [*fuzz(2_000), *odd(3_000)] if t and "▁" not in t]
    for load, path, k in ((alignment.byte_level, A, 0), (alignment.pieces, B, 2)):
        got = load(path)[0].encode([" " + t for t in texts])
        want = [row[k] for row in whole_ids(texts)]
        assert got == want


def test_long_runs_and_other_orders_go_to_the_library(tmp_path, monkeypatch):
    encoder, library = alignment.ByteLevelEncoder(A), Tokenizer.from_file(A)
    assert encoder.ranks is not None
    for text in (" " * 300_000 + "a", " \n" * 100_000, "x" * 100_000, "!?" * 50_000, "a" + " " * 1_999 + "b"):
        assert encoder.encode([text])[0] == library.encode(text, add_special_tokens=False).ids
    about = json.load(open(A, encoding="utf-8"))
    about["model"]["merges"][:2] = about["model"]["merges"][1::-1]
    (tmp_path / "other.json").write_text(json.dumps(about), encoding="utf-8")
    other = alignment.ByteLevelEncoder(str(tmp_path / "other.json"))
    assert other.ranks is None and not other.lossless and len(other.encode(["the theatre"])[0]) > 0


def test_links_and_groups(spark):
    texts = [t for t in [*fuzz(60), *odd(60)] if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    cut = alignment.tokens(docs, A, B)
    links, groups = by_id(alignment.links(cut, A, B)), by_id(alignment.groups(cut, A, B))
    ids = by_id(cut)
    for i, (_, a_bytes, _, b_bytes) in enumerate(whole_ids(texts)):
        if not bytes(ids[i][0]["a"]):
            assert links[i][0]["a_at"] == groups[i][0]["a_group"] == []
            continue
        own = list(zip([k for k, x in enumerate(a_bytes) for _ in x], [k for k, x in enumerate(b_bytes) for _ in x], strict=True))
        want = sorted(Counter(own).items())
        row = links[i][0]
        assert list(zip(zip(row["a_at"], row["b_at"], strict=True), row["n_bytes"], strict=True)) == want
        row = groups[i][0]
        assert len(row["a_group"]) == len(a_bytes) and len(row["b_group"]) == len(b_bytes)
        assert all(row["a_group"][x] == row["b_group"][y] for x, y in own)


def test_products_equal_dense_matrices(monkeypatch):
    rng = np.random.default_rng(2)
    for entries in (1, 7, 1 << 20):
        monkeypatch.setattr(alignment, "PRODUCT_ENTRIES", entries)
        for _ in range(20):
            shapes = rng.integers(1, 9, 3)
            dense = [rng.integers(0, 3, (shapes[k], shapes[k + 1])) for k in (0, 1)]
            sparse = []
            for d in dense:
                r, c = np.nonzero(d)
                sparse.append(alignment.Csr(np.concatenate([[0], np.cumsum((d > 0).sum(axis=1))]), c, d.shape[1], d[r, c]))
            got = np.zeros((shapes[0], shapes[2]), int)
            for r, c, v in sparse[0].times(sparse[1]):
                got[r, c] += v
            assert (got == dense[0] @ dense[1]).all()
            back = sparse[0].transposed()
            assert (back.indptr[-1], back.rows) == (sparse[0].indptr[-1], shapes[1])


def test_shared_group_links_are_formed_in_blocks(monkeypatch):
    monkeypatch.setattr(alignment, "PRODUCT_ENTRIES", 10)
    n = 40  # tokens of 2 bytes against tokens of 1, 2, 2, .. 1: one group
    lengths = np.array([0, 1, 2])
    found = alignment.Aligned(np.full(n, 2), np.array([1, *[2] * (n - 1), 1]), np.array([n]), np.array([n + 1]), lengths, lengths)
    assert found.groups == 1 and len(found.row) == 2 * n
    blocks = list(found.shared_group_links())
    assert sum(len(b[0]) for b in blocks) == n * (n + 1) == found.shared_group_counts().sum()
    assert max(len(b[0]) for b in blocks) <= n + 1


def test_hard_rows(spark):
    docs = documents(spark)
    got = by_id(alignment.align(docs, A, B))
    for i, want in zip([i for i, _ in TEXTS], brute([t for _, t in TEXTS]), strict=True):
        assert {c: got[i][0][c] for c in want} == want
    assert len(got[6]) == 2 and alignment.align(docs.limit(0), A, B).count() == 0


# -- resampling ------------------------------------------------------------------------------------------------------


def drawn(docs, target, ngram=2, buckets=10_000, least=20, percent=25):
    """Expected (id, n_features, weight, score, rank), by counting."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def cut(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, ngram + 1) for i in range(len(words) - k + 1)]

    source, wanted = Counter(), Counter()
    for _, t in docs:
        source.update(cut(t)[1])
    for t in target:
        wanted.update(cut(t)[1])
    s, t = source.total(), wanted.total()
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, feats = cut(text)
        weight = sum(gain[f] for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words), None])
    best = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(best[: len(best) * percent // 100]):
        r[5] = k + 1
    return sorted((tuple(r[:4] + r[5:]) for r in rows), key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ngram", [1, 2, 3])
def test_resampling_equals_counting(spark, ngram):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(80)] + ["Ä", "don't", "x-y", "É", "٣"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(500)]
    docs += [(None, "the null id " * 12)] * 3 + [(7, docs[7][1])] * 40 + TEXTS
    target = [" ".join(rng.choices(words[:20], k=30)) for _ in range(20)]
    frame = documents(spark, docs).repartition(6)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate([*target, None, ""])], "item_id bigint, text string")
    assert rows_of(sampling.resample(frame, wanted, ngram=ngram)) == drawn(docs, target, ngram=ngram)


def test_equal_scores_are_drawn_by_id(spark):
    rows = [(i, 5 if i % 3 else 6, i % 7 != 0) for i in range(1_000)] + [(None, 5, True)] * 5 + [(3, 5, None)] * 300
    scored = spark.createDataFrame(rows, "doc_id bigint, score bigint, ok boolean").repartition(7)
    from pyspark.sql import functions as F

    got = sampling.draw(scored, F.col("ok"), 60).collect()
    may = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], -1 if r[0] is None else r[0]))
    want = may[: len(may) * 60 // 100]
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(r["doc_id"], r["score"]) for r in ranked] == [r[:2] for r in want]
    assert [r["rank"] for r in ranked] == list(range(1, len(want) + 1)) and len(got) == len(rows)


def test_offsets_of_windows(spark):
    text = "Über die-Brücke,  GEHEN wir 3x"
    row = sampling.features(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    windows = [text[s:e] for s, e in zip(row["starts"], row["ends"], strict=True)]
    assert windows == ["Über", "die", "Brücke", "GEHEN", "wir", "3x", "Über die", "die-Brücke", "Brücke,  GEHEN", "GEHEN wir", "wir 3x"]
    crcs = np.frombuffer(row["buckets"], "<u2").tolist()
    assert crcs[6:9] == [zlib.crc32(w.encode()) % 10_000 for w in ("Über die", "die brücke", "brücke gehen")]
    assert row["n_words"] == 6 and row["covered"] == 23


def test_empty_tables(spark):
    docs, target = documents(spark), spark.createDataFrame([], "item_id bigint, text string")
    assert sampling.resample(docs.limit(0), target).count() == 0
    assert rows_of(sampling.resample(docs, target)) == drawn(TEXTS, [])


@pytest.mark.parametrize("key", ["op11_zipped_warc", "op12_importance_sampling"])
def test_queries_equal_sql(spark, key):
    from lodestar.llm import queries

    _, _, verdict = oracle.compare(spark, oracle.connect(SMALL), key, queries.QUERIES[key], queries.SQL[key], SMALL)
    assert verdict.startswith("ok"), verdict
