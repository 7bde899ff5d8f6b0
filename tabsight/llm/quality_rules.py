"""Quality rules as a learned decision list [native].

Statistics of every whole text are one projection.  Rules that reject are learned by sequential
covering: a conjunction of thresholds is grown by FOIL gain, pruned on held-back rows, kept if it
is precise enough there, and the rows it covers leave before the next one is grown.  All counts
behind those choices are Spark aggregates over a staged sample of labelled statistics; the driver
sees one count per (statistic, bin, label) and step.  The list is emitted as ordered Spark
conditional expressions.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_staged, stage
from .common import code_points_of, let, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
MAX_LABELLED = 20_000
BINS = 32


def repeat_words(w: Column) -> Column:
    """Words of the array ``w`` that lie in a 3-word window found twice or more in it.

    Windows are hashed and sorted with their positions: n log n steps for n words.
    """
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                          lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))

    def same(s, x, j):
        return F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))

    at = let(F.sort_array(windows), lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["p"])))
    none = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(at, none, lambda a, p: F.struct(
        p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]


def _counts(text: Column) -> Column:
    """All counts of one text as a struct of longs."""
    def of_words(w, t):
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            code_points_of(t, SYMBOLS).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                          (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            code_points_of(t, UPPER).cast("long").alias("n_upper"),
            code_points_of(t, "0123456789").cast("long").alias("n_digits"),
            code_points_of(t, "!?").cast("long").alias("n_marks"),
            code_points_of(t, ".,;:").cast("long").alias("n_stops"))

    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: of_words(w, t)))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
          "n_upper", "n_digits", "n_marks", "n_stops"]


def text_counts(text: Column) -> list[Column]:
    """The columns ``COUNTS`` of a text; a null or blank text has zero of everything."""
    c = _counts(text)
    return [c["lines"]["n"].alias(n) if n == "n_lines" else c["lines"]["dup"].alias(n) if n == "n_dup_lines"
            else c[n].alias(n) for n in COUNTS]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _per(count: str, of: str) -> Column:
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


def statistics() -> dict[str, Column]:
    """The statistics that a rule may test, over the columns COUNTS."""
    return {
        "words": F.col("n_words").cast("double"),
        "word length": _per("word_chars", "n_words"),
        "symbols per word": _per("n_symbols", "n_words"),
        "duplicate line share": _per("n_dup_lines", "n_lines"),
        "repeated word share": _per("n_repeat_words", "n_words"),
        "distinct word share": _per("n_distinct_words", "n_words"),
        "upper case share": _per("n_upper", "word_chars"),
        "digit share": _per("n_digits", "word_chars"),
        "marks per word": _per("n_marks", "n_words"),
        "stops per word": _per("n_stops", "n_words"),
        "words per line": _per("n_words", "n_lines"),
    }


class Test(NamedTuple):
    statistic: str
    above: bool      # above: value > threshold; else value <= threshold
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.statistic] > self.threshold if self.above else of[self.statistic] <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


class Rule(NamedTuple):
    tests: tuple[Test, ...]
    rejected: int    # held-back rows that it covers, by label
    kept: int

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column(of)
        return out

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.tests))}  [{self.rejected} rejected, {self.kept} kept]"


def _sums(sample: DataFrame, names: list[str]) -> list[tuple]:
    """(statistic, bin, bad, good, least, most) of the rows of ``sample``; bins are columns b0, b1, ..."""
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(f"b{i}").alias("b"), F.col(f"`{n}`").alias("v"))
                                  for i, n in enumerate(names)]))
    return [tuple(r) for r in (
        sample.select(stacked.alias("x"), "bad").groupBy("x.s", "x.b")
        .agg(F.sum(F.col("bad").cast("int")).alias("bad"), F.sum((~F.col("bad")).cast("int")).alias("good"),
             F.min("x.v").alias("least"), F.max("x.v").alias("most")).collect())]


def _best(sums: list[tuple], names: list[str], cuts: list[list[float]]) -> tuple[float, Test | None, int, int]:
    """The test of the greatest FOIL gain; ties go to the earlier statistic and threshold.

    Its threshold lies halfway between the values found on both sides of the cut.
    """
    bad = sum(x[2] for x in sums if x[0] == 0)
    good = sum(x[3] for x in sums if x[0] == 0)
    if not bad or not good:
        return 0.0, None, bad, good
    before, best = math.log2(bad / (bad + good)), (1e-9, None, bad, good)
    for s, name in enumerate(names):
        hist = {x[1]: x[2:] for x in sums if x[0] == s}
        p = n = 0
        for b in range(len(cuts[s])):
            if b not in hist:
                continue
            p, n = p + hist[b][0], n + hist[b][1]
            over = [x[2] for i, x in hist.items() if i > b]
            if not over:
                break
            cut = (hist[b][3] + min(over)) / 2
            for above, x, y in ((False, p, n), (True, bad - p, good - n)):
                gain = x * (math.log2(x / (x + y)) - before) if x else 0.0
                if gain > best[0]:
                    best = (gain, Test(name, above, cut), x, y)
    return best


def labelled_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, quality`` of at most ``max_labelled`` ids, the first by the hash of the id.

    Null labels, and those of one id that disagree, are left out.
    """
    return (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))


def learn(labelled: DataFrame, max_rules: int = 12, max_tests: int = 4, precision: float = 0.9,
          min_covered: int = 5) -> list[Rule]:
    """An ordered list of rejecting rules from rows of COUNTS, ``doc_id`` and ``quality`` (0: reject).

    Two thirds of the rows, by the hash of their id, grow rules and one third prunes them.  A rule enters if, on held-back rows, it covers ``min_covered`` rejected ones
    and at least ``precision`` of what it covers is rejected.  No labelled rows, or one label only: no rules.
    """
    stats = statistics()
    names = list(stats)
    sample = stage(labelled.where(~base_failed()).select(
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), (F.col("quality") == 0).alias("bad"),
        *[c.alias(f"v{i}") for i, c in enumerate(stats.values())]).coalesce(4), "labelledstats")
    at = [i / BINS for i in range(1, BINS)]
    bounds = sample.agg(*[F.percentile_approx(f"v{i}", at, 10_000).alias(f"q{i}") for i in range(len(names))]).first()
    if bounds["q0"] is None:
        return []
    cuts = [sorted({float(x) for x in bounds[f"q{i}"]}) for i in range(len(names))]
    bins = [sum([(F.col(f"v{i}") > c).cast("int") for c in cuts[i]], F.lit(0)).alias(f"b{i}") for i in range(len(names))]
    binned = stage(sample.select("bad", "held", *[F.col(f"v{i}").alias(n) for i, n in enumerate(names)], *bins), "labelledbins")
    of = {n: F.col(f"`{n}`") for n in names}
    rules: list[Rule] = []
    left = binned
    while len(rules) < max_rules:
        tests: list[Test] = []
        grown = left.where(~F.col("held"))
        while len(tests) < max_tests:
            _, test, _, good = _best(_sums(grown, names), names, cuts)
            if test is None:
                break
            tests.append(test)
            grown = grown.where(test.column(of))
            if not good:
                break
        if not tests:
            break
        # prune: the shortest beginning of the conjunction that is worth most on held-back rows
        cover, sums = F.lit(True), []
        for i, test in enumerate(tests):
            cover = cover & test.column(of)
            sums += [F.count_if(cover & F.col("bad")).alias(f"p{i}"), F.count_if(cover & ~F.col("bad")).alias(f"n{i}")]
        r = left.where("held").agg(*sums).first()
        worth = lambda i: (r[f"p{i}"] - r[f"n{i}"]) / max(1, r[f"p{i}"] + r[f"n{i}"])
        k = max(range(len(tests)), key=lambda i: (worth(i), -i))
        rule = Rule(tuple(tests[:k + 1]), r[f"p{k}"], r[f"n{k}"])
        if rule.rejected < min_covered or rule.rejected < precision * (rule.rejected + rule.kept):
            break
        rules.append(rule)
        left = left.where(~rule.column(of))
    drop_staged(sample, binned)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as ordered conditional expressions over COUNTS: the number of the first rule that
    rejects (from 1), 0 where none does, -1 for the base rules."""
    of = statistics()
    out = F.when(base_failed(), F.lit(-1))
    for i, r in enumerate(rules):
        out = out.when(r.column(of), F.lit(i + 1))
    return out.otherwise(F.lit(0))


def apply_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_labelled: int = MAX_LABELLED, **limits) -> tuple[DataFrame, list[Rule]]:
    """``id_col``, COUNTS, ``base_failed``, ``rule`` and ``kept`` of every row, and the rules learned.

    A null or blank text has zero words and fails the base rules.  Ids may be null or repeat: every row
    gets the verdict of its own text.  Other columns are not read.  The text is read once; what is staged
    are the counts.
    """
    counts = stage(df.select(F.col(id_col).alias("doc_id"), *text_counts(F.col(text_col))), "textcounts")
    rules = learn(counts.join(F.broadcast(labelled_sample(labels, max_labelled)), "doc_id"), **limits)
    out = counts.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", F.col("rule") == 0).withColumnRenamed("doc_id", id_col), rules


def filter_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_labelled: int = MAX_LABELLED, **limits) -> DataFrame:
    """The rows of ``df`` that the rules of ``apply_rules`` keep, with all their columns and in one narrow pass.

    Learning reads the texts of the labelled sample only (its ids, at most ``max_labelled``, are broadcast).
    """
    ids = F.broadcast(labelled_sample(labels, max_labelled))
    sample = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id")
    # staged before anything filters by them: the counts would go below the join, to every document, with the filter
    counts = stage(sample.select("doc_id", "quality", *text_counts(F.col("text"))), "samplecounts")
    rules = learn(counts, **limits)
    drop_staged(counts)
    packed = df.select(F.struct("*").alias("row"))
    return packed.select("row", *text_counts(F.col("row")[text_col])).where(verdict(rules) == 0).select("row.*")
