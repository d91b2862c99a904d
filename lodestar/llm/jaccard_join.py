"""N-gram Jaccard join by set-relation skipping.

A text is the set of its word shingles. Two sets link when their Jaccard similarity reaches the threshold; the result
is the components of these links, so links inside a component need not all be listed but none between components
is missed.

1. *Order.* A count table of fixed width, summed over all documents, gives each shingle an upper bound of its
   frequency. Every set is sorted by (bound, hash): any fixed order is right, this one puts rare shingles first.
2. *Index.* The first ``n - ceil(t * n) + 1`` shingles of a set are its postings: sets that link share one. Postings
   carry set size and position; a pair is only looked at if what is left behind both positions can still reach the
   needed overlap, so entries at late positions of an index list are skipped.
3. *Index lists* are not paired out. Each list is led by its entry of lowest position, and every entry is compared
   with the leader alone. Very frequent shingles are dealt over sub-lists with leaders of their own, which meet in a
   second step.
4. *Answers from answers.* A comparison with a leader stores what a set lacks and what it adds, if the two are much
   alike. Sets that link with the same leader are in one component, so their pairs are never formed. Pairs of one list
   that are still in different components follow. The numbers of differences to a common leader bound their overlap
   from both sides, which settles most; what is left is derived from the stored differences without the texts, and
   from the texts only where there are none.

Sets, not rows, are the nodes: equal sets share a 64-bit signature. Texts without words have an empty set and link with
nothing. Null ids keep their row; a component's id is its smallest id that isn't null. Repeated rows come back as they
are. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, array_column, mix, slices
from .components import components

#: Width of the count table and of its blocks in bits.
TABLE_BITS, BLOCK_BITS = 20, 12
#: Entries of an index list above the mean that open a further sub-list, and copies of one set, as a share of all rows, that are
#: reduced to one before lists are made: at most this many sets.
LIST_ENTRIES, HOT_SHARE = 4_096, 1_000
#: Bits of a shingle that an index key holds; keys that meet by chance are told apart by the comparison.
KEY_BITS = 40
#: Members that are compared with one copy of a leader's text.
MEMBERS_PER_COPY = 500
#: Width of the filter that texts pass before they are shuffled: this many hash values at most are broadcast.
FILTER_BITS = 20

_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the column, and n + 1 bounds; a shorter text is one shingle."""
    words = Words(column)
    n = words.counts
    with np.errstate(over="ignore"):
        whole = words.hashes.copy()
        for k in range(1, size):
            if len(whole) > k:
                whole[:-k] = whole[:-k] * _P + words.hashes[k:]
        whole = mix(whole)
        keep = np.maximum(n - size + 1, (n > 0).astype(n.dtype))
        bounds = np.concatenate([[0], np.cumsum(keep)])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], keep) + np.repeat(words.first[:-1], keep)
        out = whole[at]
        for i in np.flatnonzero((n > 0) & (n < size)):
            h = np.uint64(n[i])
            for w in words.hashes[words.first[i] : words.first[i + 1]]:
                h = h * _P + w
            out[bounds[i]] = mix(np.array([h ^ np.uint64(0x5555)]))[0]
    return out, bounds


def sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of every text, sorted."""
    hashes, bounds = shingle_hashes(column, size)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def signature(found: np.ndarray) -> int:
    """A signed 64-bit number of a set."""
    with np.errstate(over="ignore"):
        s = mix(mix(found) + np.uint64(len(found))).sum(dtype=np.uint64)
        return int(mix(np.array([s ^ np.uint64(len(found))]))[0].astype(np.int64))


def needed(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of linked sets of these sizes: 100 i >= percent * (n + m - i)."""
    return F.ceil((percent * (n + m)) / F.lit(100.0 + percent) - 1e-9)


def _counts(size: int):
    def run(batches):
        table = np.zeros(1 << TABLE_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                found = np.concatenate([*sets_of(part.column("text"), size), np.zeros(0, np.uint64)])
                table += np.bincount((found >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(table))
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(some, pa.int32()), "n": pa.array(table[some], pa.int64())})

    return run


def _blocks(batches):
    """Sums of cells, packed by blocks; a block lies in one task."""
    table = np.zeros(1 << TABLE_BITS, np.int64)
    for batch in batches:
        np.add.at(table, batch.column("cell").to_numpy(), batch.column("n").to_numpy())
    blocks = table.reshape(-1, 1 << BLOCK_BITS)
    some = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_pydict({"block": pa.array(some, pa.int32()), "counts": pa.array([blocks[i].tobytes() for i in some], pa.binary())})


def count_table(texts: DataFrame, size: int) -> np.ndarray:
    """Shingle occurrences per cell over all texts; its width doesn't depend on the corpus."""
    cells = texts.select("text").mapInArrow(_counts(size), "cell int, n bigint")
    summed = cells.repartition(F.shiftright("cell", BLOCK_BITS)).mapInArrow(_blocks, "block int, counts binary")
    table = np.zeros((1 << (TABLE_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int64)
    for r in summed.collect():
        table[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return table.ravel()


def _indexed(table, size: int, percent: int):
    def run(batches):
        counts = table.value
        extra = np.maximum(counts - int(counts.mean()), 0) // LIST_ENTRIES + 1
        for batch in batches:
            for part in slices(batch):
                sets = sets_of(part.column("text"), size)
                keys, lists = [], []
                for found in sets:
                    n = len(found)
                    cell = (found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                    first = np.argsort(counts[cell], kind="stable")[: n - (percent * n + 99) // 100 + 1] if n else cell
                    keys.append((found[first] >> np.uint64(64 - KEY_BITS)).astype(np.int64))
                    lists.append(extra[cell[first]])
                sizes = [len(k) for k in keys]
                none = [np.zeros(0, np.int64)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"),
                    "set": pa.array([signature(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "keys": array_column(np.concatenate(keys + none), sizes, pa.int64()),
                    "lists": array_column(np.concatenate(lists + none).astype(np.int32), sizes, pa.int32()),
                })

    return run


def _compared(size: int, differences: bool):
    """Rows (leader, copy, member, text) sorted so that the leader's text comes before its members."""

    def run(batches):
        key = mine = None
        for batch in batches:
            for part in slices(batch):
                rows = {k: [] for k in ("a", "b", "n_a", "n_b", "overlap", "lacks", "adds")}
                sets = sets_of(part.column("text"), size)
                for a, copy, b, found in zip(*(part.column(c).to_pylist() for c in ("a", "copy", "b")), sets, strict=True):
                    if a == b:
                        key, mine = (a, copy), found
                        continue
                    if key != (a, copy):
                        raise ValueError("a leader's text is missing")
                    lacks, adds = np.setdiff1d(mine, found, True), np.setdiff1d(found, mine, True)
                    overlap = len(mine) - len(lacks)
                    alike = differences and 3 * overlap >= len(mine) + len(found)  # half of the union or more
                    values = (a, b, len(mine), len(found), overlap, lacks.tobytes() if alike else None, adds.tobytes() if alike else None)
                    for name, value in zip(rows, values, strict=True):
                        rows[name].append(value)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k in ("lacks", "adds") else pa.int64()) for k, v in rows.items()})

    return run


def _derived(batches):
    """Overlap of two sets from what each lacks and adds against the same leader."""
    for batch in batches:
        col = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        out = []
        for n, *four in zip(col["n_lead"], col["lacks_a"], col["adds_a"], col["lacks_b"], col["adds_b"], strict=True):
            la, aa, lb, ab = (np.frombuffer(x, np.uint64) for x in four)
            out.append(n - len(la) - len(lb) + len(np.intersect1d(la, lb, True)) + len(np.intersect1d(aa, ab, True)))
        yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("a", "b", "n_a", "n_b")}, "overlap": pa.array(out, pa.int64())})


def linked(percent: int) -> Column:
    return 100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int, key: str, text: str):
        self.size, self.percent = size, percent
        self.scratch = Scratch(docs.sparkSession, "jaccard")
        self.texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        self.texts = self.texts.withColumn("text_hash", F.xxhash64("text"))

    def index(self) -> DataFrame:
        table = self.texts.sparkSession.sparkContext.broadcast(count_table(self.texts, self.size))
        schema = "doc_id bigint, text_hash bigint, set bigint, n bigint, keys array<bigint>, lists array<int>"
        sets = self.texts.mapInArrow(_indexed(table, self.size, self.percent), schema)
        return self.scratch.keep(sets.withColumn("row", F.monotonically_increasing_id()), "sets")

    def once(self, sets: DataFrame) -> DataFrame:
        """``sets`` with a single row for those of very many copies; all copies of a set would meet in the same lists."""
        copies = sets.groupBy("set").agg(F.count("*").alias("copies"), F.min("row").alias("kept"))
        many = copies.filter((F.col("copies") > 1) & (F.col("copies") * HOT_SHARE >= sets.count())).select("set", "kept")
        return sets.join(F.broadcast(many), "set", "left").filter("kept is null or row = kept")

    def lists(self, sets: DataFrame) -> DataFrame:
        """Entries of index lists that a link can come from, with the leader of their list.

        By its position an entry reaches partners up to a size (``most``). The smaller set of a pair must reach its own
        size, it is *early*. So a list needs two sets and an early entry, and an entry that isn't early needs an early
        one of a size that both reach.
        """
        entry = self.once(sets).select("set", "n", "lists", F.posexplode("keys").alias("pos", "h")).withColumn("lists", F.get("lists", F.col("pos")))
        entry = entry.select("h", F.pmod(F.xxhash64("set"), "lists").cast("int").alias("part"), "lists", "set", F.col("n").cast("int").alias("n"), "pos")
        # dealt before anything is derived, so that only the entries themselves are shuffled
        entry = entry.repartition("h", "part")
        of = Window.partitionBy("h", "part")
        entry = entry.withColumn("most", F.floor((F.col("n") - F.col("pos")) * (100.0 + self.percent) / self.percent - F.col("n") + 1e-6)).withColumn("early", F.col("most") >= F.col("n"))
        led = entry.select("*", F.min(F.struct("pos", "n", "set")).over(of).alias("lead"), F.max("set").over(of).alias("last"), F.min("set").over(of).alias("first"),
                           F.max(F.when(F.col("early"), F.col("most"))).over(of).alias("far"), F.min(F.when(F.col("early"), F.col("n"))).over(of).alias("small"))
        met = (F.col("first") != F.col("last")) & F.col("far").isNotNull() & (F.col("early") | (F.col("small") <= F.col("most")) & (F.col("n") <= F.col("far")))
        return self.scratch.keep(led.filter(met | (F.col("lists") > 1)).select("h", "lists", "set", "n", "pos", "lead"), "lists")

    def reach(self, n, pos, m, pos_m) -> Column:
        """Whether what follows both positions can still make a link."""
        need = needed(n, m, self.percent)
        return (n - pos >= need) & (m - pos_m >= need)

    def first_pairs(self, lists: DataFrame) -> DataFrame:
        """(a, b) with a the leader of a list that b is in."""
        def with_leader(rows: DataFrame) -> DataFrame:
            lead = F.col("lead")
            return rows.filter((lead["set"] != F.col("set")) & self.reach(F.col("n"), F.col("pos"), lead["n"], lead["pos"])).select(lead["set"].alias("a"), F.col("set").alias("b"))

        heads = lists.filter((F.col("lists") > 1) & (F.col("lead.set") == F.col("set"))).select("h", "set", "n", "pos").distinct()
        heads = heads.withColumn("lead", F.min(F.struct("pos", "n", "set")).over(Window.partitionBy("h")))
        return self.scratch.keep(with_leader(lists).unionByName(with_leader(heads)).distinct(), "pairs1")

    def compare(self, pairs: DataFrame, sets: DataFrame, name: str, differences: bool) -> DataFrame:
        """Overlap (and differences) of pairs (a, b) from the texts, each leader's text beside its members' texts."""
        copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_PER_COPY).cast("int").alias("copies"))
        members = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("copy"))
        leaders = copies.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        reps = sets.groupBy("set").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"))
        roles = members.unionByName(leaders).join(reps.withColumnRenamed("set", "b"), "b").groupBy("rep").agg(F.collect_list(F.struct("a", "copy", "b")).alias("roles"))
        roles = self.scratch.keep(roles.select(F.col("rep.doc_id").alias("r_id"), F.col("rep.text_hash").alias("r_hash"), "roles"), f"{name}_roles")
        short = lambda c: F.col(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        asked = F.broadcast(roles.select(short("r_hash").alias("short")).distinct())
        texts = self.texts.join(asked, short("text_hash") == F.col("short"), "left_semi")
        texts = texts.join(roles, (F.col("text_hash") == F.col("r_hash")) & F.col("doc_id").eqNullSafe(F.col("r_id")))
        rows = texts.select(F.explode("roles").alias("r"), "text").select("r.a", "r.copy", "r.b", "text")
        rows = rows.repartition("a", "copy").sortWithinPartitions("a", "copy", (F.col("a") != F.col("b")), "b")
        schema = "a bigint, b bigint, n_a bigint, n_b bigint, overlap bigint, lacks binary, adds binary"
        return self.scratch.keep(rows.mapInArrow(_compared(self.size, differences), schema), name)

    def second_pairs(self, lists: DataFrame, labels: DataFrame, seen: DataFrame) -> DataFrame:
        """Pairs of one list that are in different components and weren't compared yet."""
        entry = lists.select("h", "set", "n", "pos").distinct().join(labels.withColumnRenamed("node", "set"), "set", "left")
        entry = entry.withColumn("label", F.coalesce("label", "set"))
        open_lists = entry.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("h")
        entry = self.scratch.keep(entry.join(open_lists, "h", "left_semi"), "open")
        x, y = entry.alias("x"), entry.alias("y")
        pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.label") < F.col("y.label")) & self.reach(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
        pairs = pairs.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()
        done = seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return self.scratch.keep(pairs.join(done, ["a", "b"], "left_anti"), "pairs2")

    def derive(self, pairs: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What comparisons with common leaders tell of ``pairs``: links (a, b), and pairs that stay open.

        With l lacking and a added against a leader of size n, the overlap of two sets is
        n - l1 - l2 + (common to what they lack) + (common to what they add).
        """
        def side(s: str, *more: str) -> DataFrame:
            cols = [F.col("a").alias("lead"), F.col("b").alias(s), F.col("n_a").alias(f"n_lead_{s}"), F.col("n_b").alias(f"n_{s}"), (F.col("n_a") - F.col("overlap")).alias(f"l_{s}"), (F.col("n_b") - F.col("overlap")).alias(f"p_{s}")]
            return seen.select(*cols, F.col("lacks").isNotNull().alias(f"kept_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in more))

        n, least = F.col("n_lead_a"), F.col("n_lead_a") - F.col("l_a") - F.col("l_b")
        most = n - F.greatest("l_a", "l_b") + F.least("p_a", "p_b")
        met = pairs.join(side("a"), "a").join(side("b"), ["b", "lead"])
        alike = lambda x: 100 * x >= self.percent * (F.col("n_a") + F.col("n_b") - x)
        told = met.groupBy("a", "b").agg(
            F.bool_or(alike(least)).alias("sure"), F.bool_and(alike(most)).alias("may"), F.min(F.when(F.col("kept_a") & F.col("kept_b"), F.col("lead"))).alias("lead"))
        told = self.scratch.keep(told, "told")
        ask = told.filter("not sure and may and lead is not null").select("a", "b", "lead")
        known = ask.join(side("a", "lacks", "adds"), ["lead", "a"]).join(side("b", "lacks", "adds"), ["lead", "b"])
        known = known.select("a", "b", "n_a", "n_b", n.alias("n_lead"), "lacks_a", "adds_a", "lacks_b", "adds_b")
        derived = known.mapInArrow(_derived, "a bigint, b bigint, n_a bigint, n_b bigint, overlap bigint")
        links = told.filter("sure").select("a", "b").unionByName(derived.filter(linked(self.percent)).select("a", "b"))
        settled = told.filter("sure or not may or lead is not null")
        return links, pairs.join(settled, ["a", "b"], "left_anti")

    def placed(self) -> DataFrame:
        """doc_id, text_hash, n_shingles and label (a set of the component) of every document."""
        sets = self.index()
        lists = self.lists(sets)
        seen = self.compare(self.first_pairs(lists), sets, "compared1", differences=True)
        links = seen.filter(linked(self.percent)).select("a", "b")
        labels = components(links, self.scratch, "round1")
        derived, rest = self.derive(self.second_pairs(lists, labels, seen), seen)
        compared = self.compare(self.scratch.keep(rest, "rest"), sets, "compared2", differences=False)
        more = derived.unionByName(compared.filter(linked(self.percent)).select("a", "b"))
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), self.scratch, "round2")
        placed = sets.select("doc_id", "text_hash", "n", "set").join(labels.withColumnRenamed("node", "set"), "set", "left").select(
            "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("label", "set").alias("label"))
        placed = self.scratch.keep(placed, "placed")
        self.scratch.release("placed")
        return placed

    def run(self) -> DataFrame:
        placed = self.placed()
        first = placed.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("first"))
        return placed.join(first, "label", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document; sets link from ``percent`` hundredths of similarity on."""
    return _Join(docs, words, percent, key, text).run()


def keep_one(docs: DataFrame, *, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of smallest id (nulls last), with all
    its columns. Texts without words stay; of rows that repeat both id and text one stays."""
    placed = _Join(docs, words, percent, key, text).placed()
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = placed.filter("n_shingles > 0").groupBy("label").agg(F.min(row).alias("r")).select("r.doc_id", "r.text_hash")
    stay = first.unionByName(placed.filter("n_shingles = 0").select("doc_id", "text_hash")).select(F.xxhash64("doc_id", "text_hash").alias("_stays")).distinct()
    mine = F.xxhash64(F.col(key).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return docs.withColumn("_stays", mine).join(stay, "_stays", "left_semi").dropDuplicates(["_stays"]).drop("_stays")
