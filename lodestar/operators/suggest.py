"""Typeahead: suggestions for many short queries from an inverted index of canonical words.

The index is written once per catalogue version and brought up to date for the services that changed; a call reads
buckets of letter grams, words and titles, never catalogue text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.wordlists import KIND_LABELS
from ..session import gather, materialize
from ..sources.snapshots import SnapshotStore
from .search import _grams, _literal_map, _words

DIRECT_TEXT = [
    "bde_summary", "overview", "benefits", "eligibility_summary", "applicable_for_raw", "funding_organisation",
    "funding_type", "subsidy_details", "sales_pitch", "application_deadline_raw",
]
#: places a word may stand in; a posting holds one bit for each
FIELDS = ["title", "code", "category", "domain", "kind", "industries", "direct", "content"]
BIT = {f: 1 << i for i, f in enumerate(FIELDS)}
#: shorter terms must be whole words
WHOLE, GRAM = 3, 3
POSTING_SCHEMA = "word string, service_id bigint, fields int"


def canonical_text(services: DataFrame, sections: DataFrame) -> DataFrame:
    """Canonical texts ``(service_id, bit, text)``."""
    labels = _literal_map(KIND_LABELS)
    values = {
        "title": F.col("title"), "code": F.col("service_id"), "category": F.col("category_name"), "domain": F.col("domain_name"),
        "kind": F.coalesce(F.try_element_at(labels, F.col("service_kind")), F.col("service_kind")),
        "industries": F.array_join(F.coalesce("industries", F.array().cast("array<string>")), " "),
        "direct": F.concat_ws(" ", *DIRECT_TEXT),
    }
    own = F.explode(F.array(*[F.struct(F.lit(BIT[f]).alias("bit"), text.canonicalize(c).alias("text")) for f, c in values.items()]))
    tall = services.select(F.col("id").alias("service_id"), own.alias("x")).select("service_id", "x.bit", "x.text")
    pieces = sections.select("service_id", F.lit(BIT["content"]).alias("bit"), text.canonicalize("content").alias("text"))
    return tall.unionByName(pieces).where("text <> ''")


def postings(services: DataFrame, sections: DataFrame) -> DataFrame:
    """``(word, service_id, fields)``: all words of a service, with the fields that show them as bits."""
    words = canonical_text(services, sections).select("service_id", "bit", F.explode(_words(F.col("text"))).alias("word"))
    return gather(words, "word", "service_id").groupBy("word", "service_id").agg(F.bit_or("bit").cast("int").alias("fields"))


def titles(services: DataFrame) -> DataFrame:
    return services.select(F.col("id").alias("service_id"), "title", text.canonicalize("title").alias("title_c"))


def word_grams(words: DataFrame) -> DataFrame:
    """``(gram, word)`` of words that may hold a longer term without being it."""
    rows = words.select("word").distinct().where(F.length("word") > WHOLE)
    return rows.select(F.explode(_grams(F.col("word"), [GRAM])).alias("gram"), "word")


def asked_terms(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical queries of two letters or more ``(query, qc)``, and their distinct terms ``(query, anchor)``."""
    asked = queries.select("query").distinct().select("query", text.canonicalize("query").alias("qc")).where((F.length(F.trim("query")) >= 2) & (F.col("qc") != ""))
    return asked, asked.select("query", F.explode(F.array_distinct(F.split("qc", " "))).alias("anchor"))


def term_words(terms: DataFrame, grams: DataFrame) -> DataFrame:
    """``(anchor, word)``: short terms as they are, longer ones in all words that contain them."""
    anchors = terms.select("anchor").distinct()
    short = anchors.where(F.length("anchor") <= WHOLE).select("anchor", F.col("anchor").alias("word"))
    long = anchors.where(F.length("anchor") > WHOLE).withColumn("gram", F.substring("anchor", 1, GRAM))
    return short.unionByName(long.join(grams, "gram").where(F.contains("word", F.col("anchor"))).select("anchor", "word").distinct())


def ranked(asked: DataFrame, terms: DataFrame, words: DataFrame, posting: DataFrame, title: DataFrame, k: int) -> DataFrame:
    """Top suggestions per query: tier by the best place where all its terms occur. Terms are looked up once, whatever the
    number of queries that use them."""
    found = gather(words.join(posting, "word").select("anchor", "service_id", "fields"), "anchor", "service_id").groupBy("anchor", "service_id").agg(F.bit_or("fields").alias("fields"))
    want = terms.groupBy("query").agg(F.count(F.lit(1)).alias("want"))
    per_query = gather(terms.join(found, "anchor").select("query", "service_id", "fields"), "query", "service_id").groupBy("query", "service_id").agg(F.count(F.lit(1)).alias("have"), F.bit_and("fields").alias("fields"))
    rows = per_query.join(want, "query").where("have = want").join(asked, "query").join(title, "service_id")

    def all_in(*fields: str) -> Column:
        return F.col("fields").bitwiseAND(F.lit(sum(BIT[f] for f in fields))) != 0

    tier = (
        F.when(F.col("title_c") == F.col("qc"), 0)
        .when((F.length("qc") > WHOLE) & F.col("title_c").startswith(F.col("qc")), 1)
        .when(all_in("title"), 2)
        .when(all_in("category", "domain"), 3)
        .when(all_in("industries"), 4)
        .when(all_in("direct"), 5)
        .when(all_in("content"), 6)
        .otherwise(7)
    )
    w = Window.partitionBy("query").orderBy("tier", F.lower("title"), "service_id")
    return (
        rows.withColumn("tier", tier).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select("query", "service_id", "title", F.col("tier").cast("bigint").alias("tier"), F.col("rank").cast("bigint").alias("rank"))
    )


def typeahead(queries: DataFrame, services: DataFrame, sections: DataFrame, k: int = 8) -> DataFrame:
    """Suggestions straight from a catalogue, without a stored index; its text is canonicalised once."""
    asked, terms = asked_terms(queries)
    posting = materialize(postings(services, sections))
    words = materialize(term_words(terms, word_grams(posting)))
    return ranked(asked, terms, words, posting, titles(services), k)


class SuggestIndex:
    """The stored index, in versions of its own: postings by word, letter grams, titles, and the words of each service."""

    KEYS = {"posting": "word", "gram": "gram", "title": "service_id", "word_of": "service_id"}

    def __init__(self, spark: SparkSession, root: str, rows_per_bucket: int = 1_000_000):
        self.store = SnapshotStore(spark, root, self.KEYS, rows_per_bucket)

    def build(self, services: DataFrame, sections: DataFrame, catalogue_version: int = 0) -> int:
        """Index a whole catalogue."""
        posting = materialize(postings(services, sections))
        tables = {"posting": posting, "word_of": posting.select("service_id", "word"), "gram": word_grams(posting), "title": titles(services)}
        return self.store.commit(tables, catalogue_version, "INDEX")

    def update(self, services: DataFrame, sections: DataFrame, ids: DataFrame, catalogue_version: int = 0) -> int:
        """Bring the services in ``ids`` (service_id) up to date: those that ``services`` lacks disappear. Only buckets of words that these
        services show or showed are written."""
        with self.store.begin() as change:
            ids = materialize(ids.select("service_id").distinct())
            mine = services.join(ids.withColumnRenamed("service_id", "id"), "id", "left_semi").select(services.columns)
            # ``service_id`` of a service is its code, of a section the service's id
            new = materialize(postings(mine, sections.join(ids, "service_id", "left_semi").select(sections.columns)))
            new = new.join(mine.select(F.col("id").alias("service_id")), "service_id", "left_semi").select("word", "service_id", "fields")
            by_service = change.buckets("word_of", ids)
            old = materialize(change.read("word_of", by_service).join(ids, "service_id", "left_semi").select("service_id", "word"))
            words = old.select("word").union(new.select("word")).distinct()
            change.rewrite("posting", ["word", "service_id"], change.buckets("posting", words), new, old.select("word", "service_id"))
            change.rewrite("word_of", ["service_id"], by_service, new.select("service_id", "word"), ids)
            change.rewrite("title", ["service_id"], change.buckets("title", ids), titles(mine), ids)
            grams = materialize(word_grams(new))
            change.rewrite("gram", ["gram", "word"], change.buckets("gram", grams.select("gram")), grams, grams)
            return change.commit(catalogue_version, "INDEX")

    def suggest(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """Top suggestions per query from the buckets that its terms need."""
        asked, terms = asked_terms(queries)
        terms = materialize(terms)
        now = self.store.begin()
        wanted = terms.where(F.length("anchor") > WHOLE).select(F.substring("anchor", 1, GRAM).alias("gram")).distinct()
        words = materialize(term_words(terms, now.read("gram", now.buckets("gram", wanted))))
        posting = now.read("posting", now.buckets("posting", words.select("word")))
        return ranked(asked, terms, words, posting, now.read("title"), k)
