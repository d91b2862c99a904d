import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from lodestar.llm import byte_bpe, packing
from lodestar.llm.common import Words

from .hard import TEXTS, by_id, documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "a", "b's", "'s", "\n", "\x01", "é", "é", "1", "23", "!", "\x1c", " ", "　", "Σ", "İ", "😀", "<|endoftext|>", "the", "\t", ".", ",", "...", "_"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(n):
    rng = random.Random(11)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_words_of_bytes():
    texts = [None, *fuzz(2_000)]
    for runs, pattern in ((False, rb"[^\x20\x09-\x0D]+"), (True, rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9\x80-\xff]+")):
        words = Words(pa.array(texts), runs=runs)
        seen = {}
        for i, text in enumerate(texts):
            want = [w.lower() for w in regex.findall(pattern, (text or "").encode())]
            at = slice(words.first[i], words.first[i + 1])
            assert [bytes(words.raw[a:b]) for a, b in zip(words.starts[at], words.ends[at], strict=True)] == want
            for word, h in zip(want, words.hashes[at].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_encoding_equals_tiktoken():
    texts, encoding = fuzz(5_000), reference()
    got = byte_bpe._encoder(RANKS, public_tokenizers.PATTERN).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [encoding.encode_ordinary(t) for t in texts]


def test_offsets_and_decoding(spark):
    docs = documents(spark)
    ids = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    encoding = reference()
    rows = by_id(ids)
    back = by_id(byte_bpe.decode(ids, RANKS))
    assert len(rows[6]) == 2
    for i, text in TEXTS:
        row, text = rows[i][0], text or ""
        want = encoding.encode_ordinary(text)
        assert np.frombuffer(row["ids"], "<u4").tolist() == want
        assert bytes(back[i][0]["decoded"]) == text.encode() and back[i][0]["text"] == text
        at = 0
        for one, start, end in zip(want, row["starts"], row["ends"], strict=True):
            piece = encoding.decode_single_token_bytes(one)
            assert text[start:end].encode().find(piece) >= 0 and start <= at <= end
            at = end
    halves = spark.createDataFrame([(1, np.array(encoding.encode_ordinary("😀")[:1], "<u4").tobytes())], "doc_id bigint, ids binary")
    assert "�" in byte_bpe.decode(halves, RANKS).first()["text"]
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_equal_the_library(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = by_id(packing.pieces(documents(spark), WORDS))
    for i, text in TEXTS:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted(rows[i], key=lambda r: r["piece"])[:: 2 if i == 6 else 1]
        assert [r["start"] for r in mine] == list(range(0, len(want), 4096))
        for r in mine:
            part = np.array(want[r["start"] : r["start"] + 4096], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part) and r["length"] == len(part) // 4 and bytes(r["ids"]) == part
    texts = fuzz(5_000)
    assert [np.frombuffer(g, "<u4").tolist() for g in packing._encoder(WORDS).encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def optimum(lengths, size):
    """Fewest bins, by trying all placements."""
    best = [len(lengths)]

    def place(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for b in range(len(room)):
            if room[b] >= lengths[i] and room[b] not in room[:b]:
                place(i + 1, [*room[:b], room[b] - lengths[i], *room[b + 1 :]])
        place(i + 1, [*room, size - lengths[i]])

    place(0, [])
    return best[0]


def test_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 21, 8))[::-1]
        where, at, room = packing.best_fit(lengths, 20)
        assert packing.lower_bound(lengths, 20) <= optimum(lengths.tolist(), 20) <= len(room)
        for b in range(len(room)):
            mine = where == b
            assert lengths[mine].sum() + room[b] == 20
            assert np.array_equal(np.sort(at[mine]), np.concatenate([[0], np.cumsum(lengths[mine])[:-1]]))


def test_packing_in_many_partitions(spark):
    rng = np.random.default_rng(5)
    sizes = np.minimum(rng.geometric(1 / 900, 4_000), 4096)
    rows = spark.createDataFrame([(i, 0, 0, int(n), 7) for i, n in enumerate(sizes)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    packed = packing.pack(rows, per_task=300).toPandas()
    assert sorted(packed["doc_id"]) == list(range(4_000))
    for _, bin_rows in packed.sort_values("offset").groupby("sequence_id"):
        assert bin_rows["length"].sum() <= 4096
        assert bin_rows["offset"].tolist() == [0, *bin_rows["length"].cumsum()[:-1]]
    assert packed["sequence_id"].nunique() <= -(-int(sizes.sum()) // 4096) + 2
    assert packing.pack(rows.limit(0)).count() == 0


@pytest.mark.parametrize("low,high", [(1_200, 1_900), (300, 4_000)])
def test_no_task_packs_more_than_its_share(spark, low, high):
    sizes = np.random.default_rng(9).integers(low, high, 6_000)
    rows = spark.createDataFrame([(i, 0, 0, int(n), 7) for i, n in enumerate(sizes)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    packed = packing.pack(rows, per_task=500).toPandas()
    assert sorted(packed["doc_id"]) == list(range(6_000))
    assert packed.groupby(packed["sequence_id"] // (1 << 24)).size().max() <= 1.3 * 500
    room = 4096 - packed.groupby("sequence_id")["length"].sum().to_numpy()
    assert (room >= 0).all() and packed.groupby("sequence_id")["offset"].nunique().sum() == 6_000
    alone, _, _ = packing.best_fit(np.sort(sizes)[::-1], 4096)
    assert len(room) <= 1.02 * (alone.max() + 1)  # what dealing lengths at random over small tasks may cost


def test_bins_given_up_have_room_for_the_gap():
    room = np.array([0, 5, 20, 10, 0, 15])
    assert packing.given_up(room, 6, 20).tolist() == [False, False, True, False, False, False]
    assert packing.given_up(room, 5, 20).tolist() == [False, False, True, True, False, True]
    assert packing.given_up(room, 1, 20).tolist() == [False, True, True, True, False, True]
    assert not packing.given_up(np.zeros(3, int), 3, 20).any()


def test_packed_ids_are_the_documents_ids(spark):
    docs = documents(spark)
    packed = packing.pack(packing.pieces(docs, WORDS, size=64), size=64, per_task=20).toPandas()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in packed.itertuples())
    tokenizer = Tokenizer.from_file(WORDS)
    want = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in TEXTS)
    got = packed.sort_values("piece").groupby("doc_id", dropna=False)["ids"].sum()
    once = {i for i, n in Counter(i for i, _ in TEXTS).items() if n == 1 and i is not None}
    by_doc = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in TEXTS}
    assert once and all(np.frombuffer(got[i], "<u4").tolist() == by_doc[i] for i in once)
    assert sum(len(r) for r in packed["ids"]) == 4 * sum(map(len, want))


def test_digests(spark):
    from lodestar.llm import queries

    row = queries.op5_byte_bpe(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id = {row['doc_id']}").first()["text"]
    ids = reference().encode_ordinary(text)
    assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_query_covers_offsets_and_text(spark):
    from lodestar.llm import queries
    from pyspark.sql import functions as F

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    encoding, spans = reference(), []
    for i, text in docs.items():
        char_of = [k for k, c in enumerate(text) for _ in c.encode()]
        ends = np.cumsum([0, *(len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(text))]).tolist()
        spans.append((i, [char_of[a] for a in ends[:-1]], [char_of[b - 1] + 1 for b in ends[1:]]))
    want = spark.createDataFrame(spans, "doc_id bigint, starts array<int>, ends array<int>").select("doc_id", F.xxhash64("starts", "ends").alias("h"))
    rows = queries.op5_byte_bpe(spark, "/root/testdata/sf0.001").join(want, "doc_id").collect()
    assert len(rows) >= len(docs) and all(r["offsets_xxhash64"] == r["h"] and r["n_chars"] == len(docs[r["doc_id"]]) for r in rows)
