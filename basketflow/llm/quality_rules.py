"""Learned quality rules: an ordered list of threshold conjunctions, applied as one Spark conditional expression.

Every text is reduced once to a few numbers, with built-in functions only. The rules that reject a document are learned by
sequential covering from the labelled rows: thresholds come from their quantiles, a rule grows by the condition that gains
most, is pruned on a held-out third, and what it covers is set aside before the next. Learning needs only counts by
(feature, bin), so what reaches the driver does not grow with the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import text_of, written

_SPACE = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: What rules may test. All are per word or per character, so they mean the same in short and long texts.
FEATURES = ("symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "marks_per_word", "word_length", "distinct_share")

#: Candidate thresholds of each feature.
BINS = 32
#: A rule must cover this many labelled rows, and this share of those it covers must be bad.
LEAST_ROWS = 8
LEAST_PRECISION = 0.95
MOST_RULES = 12
MOST_CONDITIONS = 3


def _without(text: Column, chars: str) -> Column:
    """How many of `chars` the text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(docs: DataFrame) -> DataFrame:
    """Counts and shares of each row of `docs` (doc_id, text; other columns are ignored).

    NULL and empty texts have no words. Repeated rows stay repeated.
    """
    n = F.col("n_words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    rows = rows.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        _without(F.col("text"), _SYMBOLS).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE_CHARS))) > 0).alias("lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _without(F.col("text"), "0123456789").cast("long").alias("n_digits"),
        _without(F.col("text"), "!?").cast("long").alias("n_marks"),
    )
    # Three-word windows as hashes with their places, sorted: equal windows are neighbours.
    windows = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")),
    )
    rows = rows.withColumn("windows", windows)
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct(F.col("windows.h"))) < F.size("windows"), F.sort_array("windows")).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter(
        "sorted",
        lambda x, i: (F.get("sorted", i - 1)["h"].eqNullSafe(x["h"])) | (F.get("sorted", i + 1)["h"].eqNullSafe(x["h"])),
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    rows = rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        "n_distinct",
        "n_upper",
        "n_digits",
        "n_marks",
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_digits", "word_chars").alias("digit_share"),
        share("n_marks", "n_words").alias("marks_per_word"),
        share("word_chars", "n_words").alias("word_length"),
        share("n_distinct", "n_words").alias("distinct_share"),
    )


@dataclass(frozen=True)
class Condition:
    """`feature` above `threshold` (or not above it)."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule], F.lit(True))


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: value > c))


def _tally(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], list[int]]:
    """Good and bad rows per feature and bin, of the growing part: one job over the labelled rows, pre-aggregated."""
    bins = F.array(*[F.struct(F.lit(f).alias("f"), _bin(F.col(f), at).alias("bin")) for f, at in cuts.items()])
    counted = rows.select(F.explode(bins).alias("x"), "bad").groupBy("x.f", "x.bin").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    return {(r["f"], r["bin"]): [r["n"] - r["bad"], r["bad"]] for r in counted.collect()}


def _gain(good: int, bad: int, all_good: int, all_bad: int) -> float:
    """Bits that the covered bad rows gain over the rows the rule covered before."""
    if not bad:
        return -1.0
    return bad * (math.log2(bad / (good + bad)) - math.log2(all_bad / (all_good + all_bad)))


def _best(tally: dict[tuple[str, int], list[int]], cuts: dict[str, list[float]], least_rows: int) -> tuple[float, Condition] | None:
    found = []
    for f, at in cuts.items():
        counts = [tally.get((f, b), [0, 0]) for b in range(len(at) + 1)]
        all_good, all_bad = sum(c[0] for c in counts), sum(c[1] for c in counts)
        good = bad = 0
        for b, threshold in enumerate(at):
            good, bad = good + counts[b][0], bad + counts[b][1]
            for above, g, x in ((False, good, bad), (True, all_good - good, all_bad - bad)):
                if g + x >= least_rows:
                    found.append((_gain(g, x, all_good, all_bad), Condition(f, above, threshold)))
    best = max(found, key=lambda x: x[0], default=None)
    return best if best and best[0] > 0 else None


def _counted(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    """(rows, bad rows) that each of the rules covers, in one job."""
    sums = [F.coalesce(F.sum(F.when(_all(r), v)), F.lit(0)).alias(f"{k}_{j}") for k, r in enumerate(rules) for j, v in enumerate((F.lit(1), F.col("bad")))]
    got = rows.agg(*sums).first()
    return [(got[f"{k}_0"], got[f"{k}_1"]) for k in range(len(rules))]


def learn(
    labelled: DataFrame,
    bins: int = BINS,
    least_rows: int = LEAST_ROWS,
    least_precision: float = LEAST_PRECISION,
    most_rules: int = MOST_RULES,
    most_conditions: int = MOST_CONDITIONS,
) -> list[Rule]:
    """Rules that reject, in order, from rows with the features, `doc_id` and `quality` (0 is bad, NULL is left out).

    All labelled rows are counted. Rows of one class only, or none, give no rule.
    """
    rows = written(
        labelled.where(F.col("quality").isNotNull()).select("doc_id", *FEATURES, (F.col("quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held")),
        "quality-labels",
    )
    steps = [k / bins for k in range(1, bins)]
    # Quantiles of either class by itself, so that a rare class has thresholds within its own range too.
    found = {r["bad"]: r for r in rows.groupBy("bad").agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).collect()}
    if len(found) < 2:
        return []
    # Midway between them, so that what a rule covers keeps a margin to what it does not.
    values = {f: sorted({*found[0][f], *found[1][f]}) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in values.items()}
    rules: list[Rule] = []
    left = rows
    while len(rules) < most_rules:
        rule: Rule = ()
        while len(rule) < most_conditions:
            best = _best(_tally(left.where(~F.col("held") & _all(rule)), cuts), cuts, least_rows)
            if best is None:
                break
            rule = (*rule, best[1])
            n, bad = _counted(left.where(~F.col("held")), [rule])[0]
            if bad == n:
                break
        if not rule:
            break
        # Pruning: the shortest start of the rule that does as well on the held-out rows.
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        grown, held = _counted(left.where(~F.col("held")), prefixes), _counted(left.where(F.col("held")), prefixes)
        value = [(min(b / n if n else 0.0, (hb + 1) / (hn + 1)), -k) for k, ((n, b), (hn, hb)) in enumerate(zip(grown, held, strict=True))]
        worth, k = max(value)
        if worth < least_precision:
            break
        rules.append(rule[: 1 - k])
        left = left.where(~_all(rules[-1]))
    return rules


def rejected(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: the number of the first rule that rejects, else 0."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(_all(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def scan(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row of `docs` (doc_id, text) with its counts, whether the base rules fail it, and the learned verdict.

    The rules are learned from rows of `labels` (doc_id, quality) whose documents pass the base. `rule` is the number of the
    rule that rejects, 0 for none. Extra columns of either table are ignored; without labels only the base decides.
    """
    found = written(features(docs), "quality-features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rules = learn(found.where(~F.col("base_failed")).join(known, "doc_id"))
    return found.withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(rejected(rules))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule"
    )
