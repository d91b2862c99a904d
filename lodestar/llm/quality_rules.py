"""Quality rules: text statistics in SQL functions, and a learned ordered list of threshold rules.

Statistics are Spark expressions over the whole text. The decision list is learned by sequential covering: a rule
is a conjunction of ``feature > threshold`` and ``feature <= threshold``, grown by the condition with the highest
FOIL gain until it hits no good rows, pruned on rows held back from growing, then its rows are taken away and the
next rule is grown. All counting is grouped aggregation of binned features, so only (feature, bin) cells reach the
driver. The list becomes one ordered CASE expression; rows that no rule hits are kept.

Null and empty texts have zero words, fail the base test and aren't kept. Repeated rows are judged alike. Labels
that are null are ignored; several labels of one id count once, as the lowest. Without labels of both classes the
list is empty and only the base test decides. Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold

#: White space that separates words.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window, and the base limits.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Cut points tried per feature and class.
CUTS = 16
#: Limits of the list: rules, conditions of a rule, and what a rule must show on the held-back rows.
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_SUPPORT = 8, 3, 0.95, 4

FEATURES = ("symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share", "word_length", "n_words")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    trimmed = F.regexp_replace(text, f"^{SPACE}|{SPACE}\\z", "")
    return bind(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def _repeated(words: Column) -> Column:
    """Words inside windows that occur at least twice."""

    def covered(windows: Column) -> Column:
        def positions(order: Column) -> Column:
            def same(i: Column) -> Column:
                return F.coalesce(F.get(order, i)["h"] == F.get(order, i + 1)["h"], F.lit(False))

            hit = F.filter(order, lambda x, i: same(i) | same(i - 1))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("upto"))
        add = lambda a, x: F.struct((a["total"] + x + WINDOW - F.greatest(x, a["upto"])).alias("total"), (x + WINDOW).alias("upto"))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            F.aggregate(bind(order, positions), start, add, lambda a: a["total"]))

    def windows(hashes: Column) -> Column:
        slots = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(slots, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(
        F.size(h) < 2, F.lit(0).cast("long")).when(F.size(h) <= WINDOW, F.lit(0).cast("long")).otherwise(bind(windows(h), covered)))


def _left_out(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the contract's counts, the shares that rules use, and the columns of ``keep``."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = _words(body)

    def all_of(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), _repeated(ws).alias("n_repeat_words"), F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"))

    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    base = docs.select(
        F.col(key), *keep, bind(words, all_of).alias("w"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _left_out(body, SYMBOLS).alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        _left_out(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), _left_out(body, "!?").alias("n_marks"),
    )
    chars, n = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    return base.select(key, *keep, F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"),
                       F.col("w.n_repeat_words").alias("n_repeat_words"), F.col("w.n_distinct").alias("n_distinct"), F.col("l.n").alias("n_lines"), "n_upper", "n_marks").select(
        "*",
        (F.col("n_symbols") / chars).alias("symbol_share"), (F.col("n_upper") / chars).alias("upper_share"), (F.col("n_marks") / chars).alias("mark_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"), (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("n_distinct") / n).alias("distinct_share"), (F.col("word_chars") / n).alias("word_length"),
    )


@dataclass
class Condition:
    feature: str
    bin: int  # bins below it are "not above"
    above: bool
    threshold: float

    def on_bins(self) -> Column:
        return F.col(f"b_{self.feature}") >= self.bin if self.above else F.col(f"b_{self.feature}") < self.bin

    def on_values(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.4g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects a row, no rule keeps it."""

    rules: list[list[Condition]] = field(default_factory=list)

    def fired(self) -> Column:
        """Number of the first rule that holds, null if none does."""
        out = None
        for i, rule in enumerate(self.rules):
            test = _all(c.on_values() for c in rule)
            out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
        return F.lit(None).cast("int") if out is None else out

    def __str__(self) -> str:
        return "; ".join(" and ".join(map(str, r)) for r in self.rules)


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many cut points the value has reached."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut <= F.col(feature)))


def _cells(rows: DataFrame, features) -> dict[str, dict[int, tuple[int, int]]]:
    """(bad, good) rows in every bin of every feature."""
    pairs = ", ".join(f"'{f}', b_{f}" for f in features)
    counted = rows.select("bad", F.expr(f"stack({len(features)}, {pairs}) as (feature, bin)")).groupBy("feature", "bin").agg(
        F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in features}
    for r in counted.collect():
        out[r["feature"]][r["bin"]] = (r["p"], r["n"])
    return out


def _best(cells, cuts) -> tuple[Condition | None, int, int]:
    """The condition of highest FOIL gain, and the (bad, good) rows it leaves."""
    best, found = 0.0, (None, 0, 0)
    for feature, bins in cells.items():
        p_all, n_all = sum(p for p, _ in bins.values()), sum(n for _, n in bins.values())
        if not p_all:
            continue
        before = math.log2(p_all / (p_all + n_all))
        for k, threshold in enumerate(cuts[feature], start=1):
            p_up, n_up = (sum(bins[b][j] for b in bins if b >= k) for j in (0, 1))
            for above, p, n in ((True, p_up, n_up), (False, p_all - p_up, n_all - n_up)):
                if p and p + n < p_all + n_all:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > best + 1e-9:
                        best, found = gain, (Condition(feature, k, above, threshold), p, n)
    return found


def learn(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", scratch: Scratch | None = None) -> DecisionList:
    """Sequential covering of the rows labelled 0."""
    scratch = scratch or Scratch(stats.sparkSession, "rules")
    marks = labels.select(F.col(key), F.col(label).alias("label")).filter("label is not null").groupBy(key).agg(F.min("label").alias("label"))
    seen = scratch.keep(stats.join(marks, key).filter(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words").select(
        key, (F.col("label") == 0).cast("int").alias("bad"), *(F.col(f).cast("double").alias(f) for f in FEATURES)), "labelled")
    steps = F.array(*(F.lit(i / CUTS) for i in range(1, CUTS)))
    found = seen.groupBy("bad").agg(*(F.percentile_approx(f, steps, 1000).alias(f) for f in FEATURES)).collect()
    if len(found) < 2:
        return DecisionList()
    cuts = {f: sorted({v for r in found for v in r[f] or ()}) for f in FEATURES}
    binned = scratch.keep(seen.select("bad", (fold(key, 3) == 0).alias("held"), *(
        _bin(f, cuts[f]).alias(f"b_{f}") for f in FEATURES)), "binned")
    grow, prune, rules = binned.filter("not held"), binned.filter("held"), DecisionList()
    while len(rules.rules) < MAX_RULES:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            condition, p, n = _best(_cells(grow.filter(_all(c.on_bins() for c in rule)), FEATURES), cuts)
            if condition is None:
                break
            rule.append(condition)
            if not n:
                break
        if not rule:
            break
        # held-back rows that every prefix of the rule hits
        sums = [F.sum(F.when(_all(c.on_bins() for c in rule[:i]), v).otherwise(0)) for i in range(1, len(rule) + 1) for v in (F.col("bad"), F.lit(1))]
        hits = [x or 0 for x in prune.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
        worth = [(2 * hits[2 * i] - hits[2 * i + 1]) / hits[2 * i + 1] if hits[2 * i + 1] else -1.0 for i in range(len(rule))]
        keep = max(range(len(rule)), key=lambda i: (round(worth[i], 6), -i))
        rule = rule[: keep + 1]
        if hits[2 * keep + 1] < MIN_SUPPORT or hits[2 * keep] < MIN_PRECISION * hits[2 * keep + 1]:
            break
        rules.rules.append(rule)
        rest = ~_all(c.on_bins() for c in rule)
        grow, prune = grow.filter(rest), prune.filter(rest)
    scratch.drop("labelled")
    scratch.drop("binned")
    return rules


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds base_failed, rule (number of the rule that rejects, if any) and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", F.when(~F.col("base_failed"), rules.fired())).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Rows are judged in place, so texts aren't shuffled."""
    scratch = Scratch(docs.sparkSession, "rules")
    rules = learn(scratch.keep(statistics(docs, key=key, text=text), "statistics"), labels, key=key, scratch=scratch)
    scratch.release()
    whole = docs.select(F.col(key), F.col(text), F.struct("*").alias("_row"))
    return judge(statistics(whole, key=key, text=text, keep=("_row",)), rules).filter("kept").select("_row.*")


def quality_rules(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id") -> tuple[DataFrame, DecisionList]:
    """Judged statistics of every document, and the list that was learned."""
    scratch = Scratch(docs.sparkSession, "rules")
    stats = scratch.keep(statistics(docs, key=key), "statistics")
    rules = learn(stats, labels, key=key, scratch=scratch)
    return judge(stats, rules), rules
