"""Quality rules as learned decision lists, DataFrame operations only.

Text statistics are JVM expressions.  Rules are learned by sequential covering: grow a
conjunction of thresholds by information gain on two thirds of the labelled documents, prune it
from the end on the rest, drop what it covers, and go on while rules stay precise.  Every step
is one aggregation over the labelled statistics (a histogram for each statistic), so all labels
count and only histograms reach the driver.  The list is applied as one ordered conditional
expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, column, cut, text_or_empty, without_spaces, words

#: FIXED VALUES of the base filter: fewest words, largest share (percent) of repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "[#*$%&|<>]"


def _repeat_words() -> Column:
    """Words inside three-word windows that occur twice or more, from ``_w`` (words) and ``_h``
    (window hashes).  Most texts repeat nothing, which a set of the hashes tells; only the rest
    sort their windows and mark equal neighbours."""
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    # Let s be the sorted windows: a window repeats if the one before or after has its hash.
    dup = F.transform(F.array(ordered), lambda s: F.transform(
        F.filter(F.transform(s, lambda x, i: F.struct(
            x["p"].alias("p"),
            (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
             | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("r"))), lambda x: x["r"]),
        lambda x: x["p"]))[0]
    covered = F.size(F.array_distinct(F.flatten(F.transform(dup, lambda p: F.array(p, p + 1, p + 2)))))
    return F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0)).otherwise(covered).cast("long")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """``id`` and counts of each text (null: empty): words, their code points, symbols, lines
    with a word and repeats among them, words in repeated three-word windows, capitals, digits,
    exclamation marks and distinct words.  With ``row`` also the whole row as a struct."""
    text, w = F.col("_t"), F.col("_w")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit("".join(SPACES))) != "")
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    whole = [F.struct(*[column(c) for c in docs.columns]).alias("row")] if row else []
    base = docs.select(column(id_col).alias("id"), text_or_empty(text_col).alias("_t"), *whole).withColumns(
        {"_w": words(text)}).withColumns({"_l": lines, "_n": F.size("_w")}).withColumn(
        "_h", F.when(F.col("_n") >= 3, F.slice(hashes, F.lit(1), F.greatest(F.col("_n") - 2, F.lit(0)))).otherwise(
            F.array().cast("array<bigint>")))
    return base.select(
        "id", *["row"] * row, F.col("_n").cast("long").alias("n_words"),
        F.length(without_spaces(text)).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("[0-9]")).cast("long").alias("n_digits"),
        (F.length(text) - F.length(F.replace(text, F.lit("!")))).cast("long").alias("n_exclaim"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """Rates that rules may test; all are 0 for a text without words."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"), "digit_share": per("n_digits", "word_chars"),
        "exclaim_per_word": per("n_exclaim", "n_words"), "distinct_share": per("n_distinct", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float
    bin: int

    def on(self, value: Column) -> Column:
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def on_bins(self) -> Column:
        b = F.col("b_" + self.feature)
        return b >= self.bin if self.at_least else b < self.bin

    def __str__(self):
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


def _gain(p1, n1, p0, n0):
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def learn_rules(labelled: DataFrame, names: list[str], n_bins: int = 64, max_rules: int = 12,
                max_conditions: int = 4, precision: float = 0.9, min_cover: int = 3) -> list[list[Condition]]:
    """Ordered rules for ``bad`` documents from ``(id, bad, feature...)``; each a conjunction.

    A rule is kept if at least ``precision`` of what it covers, in either part, is bad and it
    covers ``min_cover`` bad documents; otherwise learning stops.  No labels or no bad document:
    no rules.
    """
    share = [i / n_bins for i in range(1, n_bins)]
    if not labelled.take(1):
        return []
    # Thresholds: quantiles over all documents and over the bad ones, which are rarer.
    picked = labelled.agg(*[F.percentile_approx(f, share, 10_000).alias(f) for f in names],
                          *[F.percentile_approx(F.when(F.col("bad"), F.col(f)), share, 10_000).alias("x_" + f)
                            for f in names]).first().asDict()
    cuts = {f: sorted({*(picked[f] or []), *(picked["x_" + f] or [])}) for f in names}
    names = [f for f in names if cuts[f]]

    def bin_of(f):
        return F.size(F.filter(F.array(*[F.lit(t) for t in cuts[f]]), lambda t: t <= F.col(f)))

    binned = cut(labelled.select("bad", (F.pmod(F.xxhash64("id"), F.lit(3)) < 2).alias("grow"),
                                 *[bin_of(f).alias("b_" + f) for f in names]))
    rules: list[list[Condition]] = []
    rest = F.lit(True)
    while len(rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            inside = reduce(lambda a, c: a & c.on_bins(), rule, rest & F.col("grow"))
            rows = (binned.where(inside)
                    .select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col("b_" + f).alias("b"))
                                                       for f in names])).alias("x"))
                    .groupBy("x.f", "x.b", "bad").count().collect())  # at most features x bins x 2 rows
            hist = {f: {} for f in names}
            for f, b, bad, n in rows:
                hist[f].setdefault(b, [0, 0])[0 if bad else 1] += n
            p0, n0 = (sum(v[k] for v in hist[names[0]].values()) for k in (0, 1))
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for f in names:
                p, n = 0, 0
                for b in sorted(hist[f])[:-1]:
                    p, n = p + hist[f][b][0], n + hist[f][b][1]
                    after = min(x for x in hist[f] if x > b)
                    for c, p1, n1 in ((Condition(f, False, cuts[f][after - 1], after), p, n),
                                      (Condition(f, True, cuts[f][after - 1], after), p0 - p, n0 - n)):
                        if p1 >= min_cover and (g := _gain(p1, n1, p0, n0)) > best[0]:
                            best = (g, c)
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # Prune: the prefix with the best (p - n) / (p + n) on the held-out third, shorter on ties.
        heads = [reduce(lambda a, c: a & c.on_bins(), rule[:k], F.lit(True)) for k in range(1, len(rule) + 1)]
        tally = binned.where(rest).agg(*[
            F.count_if(h & (F.col("bad") == b) & (F.col("grow") == g)).alias(f"c{k}_{int(g)}_{int(b)}")
            for k, h in enumerate(heads) for g in (True, False) for b in (True, False)]).first().asDict()
        of = lambda k, g: (tally[f"c{k}_{g}_1"], tally[f"c{k}_{g}_0"])
        worth = lambda k: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*of(k, 0))
        k = max(range(len(rule)), key=lambda k: (worth(k), -k))
        (pg, ng), (ph, nh) = of(k, 1), of(k, 0)
        if pg + ph < min_cover or pg < precision * (pg + ng) or ph < precision * (ph + nh):
            k = len(rule) - 1  # the whole rule may still be precise enough
            (pg, ng), (ph, nh) = of(k, 1), of(k, 0)
            if pg + ph < min_cover or pg < precision * (pg + ng) or ph < precision * (ph + nh):
                break
        rules.append(rule[:k + 1])
        rest = rest & ~heads[k]
    return rules


def verdict(rules: list[list[Condition]], columns: dict[str, Column]) -> Column:
    """Number of the first rule that rejects, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = reduce(lambda a, b: a & b, [c.on(columns[c.feature]) for c in rule])
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_rates(stats: DataFrame, labels: DataFrame, id_col: str, quality_col: str) -> DataFrame:
    """``(id, bad, rate...)`` of the labelled documents that pass the base filter."""
    marks = (labels.where(column(quality_col).isNotNull()).groupBy(column(id_col).alias("id"))
             .agg((F.min(quality_col) == 0).alias("bad")))
    return cut(stats.where(~base_failed()).join(marks, "id").select(
        "id", "bad", *[c.alias(f) for f, c in features().items()]))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   quality_col: str = "quality", **options) -> DataFrame:
    """The rows of ``docs`` that neither the base filter nor the learned list rejects, same
    columns.  The list is applied to each row where it stands, so texts do not move."""
    rules = learn_rules(labelled_rates(cut(text_statistics(docs, id_col, text_col)), labels, id_col, quality_col),
                        list(features()), **options)
    # The row number keeps the optimiser from moving the filter below the statistics, where each
    # mention of one would compute it again.
    judged = text_statistics(docs, id_col, text_col, row=True).withColumn("_here", F.monotonically_increasing_id())
    return judged.where((F.col("_here") >= 0) & ~base_failed() & (verdict(rules, features()) == 0)).select("row.*")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  quality_col: str = "quality", **options) -> DataFrame:
    """One row per input row: ``id``, the statistics, ``base_failed``, ``rule`` and ``kept``.

    Learns from the labelled documents that pass the base filter; of several labels of an id the
    lowest quality counts, null labels and ids are ignored.  Repeated rows are judged alike.
    Without labels only the base filter rejects.  An empty table gives an empty result.
    """
    stats = cut(text_statistics(docs, id_col, text_col))
    rules = learn_rules(labelled_rates(stats, labels, id_col, quality_col), list(features()), **options)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules, features()))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
