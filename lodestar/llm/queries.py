"""Queries ``opN_<name>`` over the supplied tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, html_wrappers, importance_sampling, jaccard_join, language_id, maxent_lm, packing, pii, quality_classifier, quality_rules,
    token_alignment, topk, zipped_warc,
)
from .common import Scratch, fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents")
    ids = byte_bpe.encode(docs, path, public_tokenizers.PATTERN).withColumn("offsets_xxhash64", F.xxhash64("starts", "ends"))
    back = byte_bpe.decode(ids, path, keep=("offsets_xxhash64",))
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        "offsets_xxhash64", F.length("text").cast("long").alias("n_chars"),
    )


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_corpus(_table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 3) == 1
    scored = quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False))


def op9_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_pages(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op11_zipped_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    archives = zipped_warc.write_pages(_table(spark, sf_dir, "pages"), scratch)
    read = zipped_warc.read_records(archives)
    return read.select(
        F.col("row_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_key").cast("long").alias("refers_to"), "target_uri", "date",
    )


def op12_importance_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_sampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words", "covered")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_topk": op4_topk,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_maxent_lm": op6_maxent_lm,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_html_wrappers": op9_html_wrappers,
    "op10_language_id": op10_language_id,
    "op11_zipped_warc": op11_zipped_warc,
    "op12_importance_sampling": op12_importance_sampling,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op4_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
            from v q join v c on q.vec_id <> c.vec_id
            where q.vec_id % 50 = 0
        )
        select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
        from scored
        qualify rank <= 5
    """,
    # equal payloads are met by their SHA-256; rows without an id are always responses
    "op11_zipped_warc": """
        with p as (
            select page_id, url, coalesce(html, '') as html from pages
        ), d as (
            select page_id, url, octet_length(encode(html)) as n, sha1(html) as digest, sha256(html) as same from p
        ), m as (
            select *, max(page_id) over (partition by same) as keeper from d
        )
        select page_id, n::bigint as payload_bytes, digest as payload_digest,
               case when n >= 1000 and page_id < keeper then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and page_id < keeper then keeper end as refers_to,
               url as target_uri, '1970-01-01T00:00:00Z' as date
        from m
    """,
    "op12_importance_sampling": """
        with crc_table as (
            select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t
        ), texts as (
            select 'd' as side, row_number() over () as rid, text from documents
            union all select 'b', row_number() over (), text from benchmark
        ), cut as (
            select side, rid, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from texts
        ), seen as (
            select side, rid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from cut
        ), counted as (
            select side, rid, f, count(*) as n from seen group by all
        ), bytes as (
            select f, hex(encode(f)) as h from (select distinct f from counted)
        ), crcs as (
            select f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 as bucket
            from bytes, crc_table
        ), hist as (
            select k.bucket, coalesce(sum(n) filter (side = 'd'), 0) as s, coalesce(sum(n) filter (side = 'b'), 0) as t
            from (select unnest(range(10000)) as bucket) k
            left join (select side, bucket, sum(n) as n from counted join crcs using (f) group by all) using (bucket)
            group by k.bucket
        ), totals as (
            select sum(s)::double as big_s, sum(t)::double as big_t from hist
        ), gains as (
            select bucket, floor(1000 * ln((t + 1)::double * (big_s + 10000) / ((s + 1)::double * (big_t + 10000))))::bigint as gain from hist, totals
        ), sums as (
            select rid, sum(n) as n_features, sum(n * gain) as gain from counted join crcs using (f) join gains using (bucket) where side = 'd' group by rid
        ), docs as (
            select row_number() over () as rid, doc_id from documents
        ), weighed as (
            select d.doc_id, d.rid, len(c.w) as n_words, coalesce(list_sum(list_transform(c.w, lambda x: length(x))), 0) as covered,
                   coalesce(n_features, 0) as n_features, coalesce(floor(gain::double / n_features), 0)::bigint as weight
            from docs d join cut c on c.side = 'd' and c.rid = d.rid left join sums on sums.rid = d.rid
        ), scored as (
            select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
            from weighed
        ), placed as (
            select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls first) end as place,
                   sum((n_words >= 20)::bigint) over () as eligible
            from scored
        )
        select doc_id, n_features::bigint as n_features, weight, score, case when place <= 25 * eligible // 100 then place end::bigint as rank,
               n_words::bigint as n_words, covered::bigint as covered
        from placed
    """,
}
