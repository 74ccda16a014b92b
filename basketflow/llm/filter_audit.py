"""Filter interaction audit: what each of five text filters removes, in every order in which they may be applied.

A document fails a set of filters; how many documents fail which set is counted once per part. Everything else follows from
these counts on the lattice of filter subsets: state S stands for "the filters of S have been applied", and an edge from S to
S + f removes the documents that fail f and nothing in S. Forward path counting gives the orders that reach a state, backward
counting those that lead from it to the end; an edge is passed by forward(S) * backward(S + f) orders, which weights its
removals for the Shapley sums. The steps of a single order are read from the same edges.

Defined cases: NULL texts are empty; a NULL part is the empty string; of repeated label rows of a document one with 1 decides;
repeated rows of a document count each, and are not copies of each other (only a smaller doc_id makes a copy); rows without
doc_id have no labels, are no copies and make none. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import text_of, written

FILTERS = "ABCDE"

#: The conditions' numbers.
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
SYMBOLS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"

COUNTS = ("n", "good", "toxic")


def paths(k: int) -> tuple[list[int], list[int]]:
    """For each subset of k filters (as bits): the orders that reach it from the empty set, and those that lead to the full one."""
    forward, backward = [0] * (1 << k), [0] * (1 << k)
    forward[0] = backward[-1] = 1
    for s in range(1, 1 << k):
        forward[s] = sum(forward[s ^ (1 << f)] for f in range(k) if s >> f & 1)
    for s in range((1 << k) - 2, -1, -1):
        backward[s] = sum(backward[s | (1 << f)] for f in range(k) if not s >> f & 1)
    return forward, backward


def edges_of(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders that pass) of every edge of the lattice of k filters."""
    forward, backward = paths(k)
    return [(s, f, forward[s] * backward[s | (1 << f)]) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def failing(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask, text_key) of each document: bit i of mask is set if the text alone fails filter i. Only built-in functions."""
    words = F.array_remove(F.split(F.col("text"), SPACE), "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    rows = rows.withColumn("words", words)
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    checks = (
        n < LEAST_WORDS,
        100 * distinct.cast("long") < LEAST_DISTINCT_PERCENT * n.cast("long"),
        100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.length("text").cast("long"),
        F.col("text").rlike(SYMBOLS),
    )
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks)), F.lit(0))
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.md5("text")).alias("text_key"))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """`rows` of `failing`, with the bit set where a smaller doc_id has the same text.

    The smallest id of each text is found with partial minima and joined by id, not by text, so a group of copies that holds a
    third of all rows meets nowhere.
    """
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    joined = rows.join(first, ["doc_id", "text_key"], "left")
    return joined.select("doc_id", "part", F.when(copied, F.col("mask").bitwiseOR(F.lit(1 << bit))).otherwise(F.col("mask")).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    return rows.join(marks, "doc_id", "left")


def mask_counts(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part, counted where the rows are before they are shuffled."""
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def lattice(counts: DataFrame, k: int = len(FILTERS)) -> DataFrame:
    """One row per part. `left` has by state the documents that survive it; `edge` has at state * k + filter the counts of those
    among them that fail the filter, which the edge removes; `alone` has by filter the documents that fail it only.

    Each mask is spread to the states that it survives: a part has 3**k such rows at most, whatever its size.
    """
    failed = [F.col("mask").bitwiseAND(F.lit(1 << f)) != 0 for f in range(k)]
    survived = counts.select("part", "mask", *COUNTS, F.explode(F.expr(f"filter(sequence(0, {(1 << k) - 1}), s -> (s & mask) = 0)")).alias("state"))
    sums = survived.groupBy("part", "state").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(failed[f], F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(k) for c in COUNTS],
        *[F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0)).alias(f"alone{f}") for f in range(k)],
    )
    removed = F.array(*[F.struct(*[F.col(f"{c}{f}").alias(c) for c in COUNTS]) for f in range(k)])
    alone = F.array(*[F.col(f"alone{f}") for f in range(k)])
    held = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("n", removed.alias("removed"), alone.alias("alone"))))).alias("held"))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    states = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    return held.select(
        "part",
        F.transform(states, lambda s: F.coalesce(F.col("held")[s]["n"], F.lit(0).cast("long"))).alias("left"),
        F.flatten(F.transform(states, lambda s: F.coalesce(F.col("held")[s]["removed"], F.array(*[zero] * k)))).alias("edge"),
        F.col("held")[0]["alone"].alias("alone"),
    )


def orders(parts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order and step, from the part's row of `lattice`."""
    k = len(names)
    weights = edges_of(k)
    shapley = F.array(*[sum((F.col("edge")[s * k + f]["n"] * w for s, g, w in weights if g == f), F.lit(0)) for f in range(k)])
    steps = []
    for order in permutations(range(k)):
        state = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(names[g] for g in order), step, state, f))
            state |= 1 << f
    # A fixed number of rows (600 for five filters), whatever the input.
    table = parts.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, f int")
    picked = table.groupBy("state", "f").agg(F.collect_list(F.struct("filter_order", "step")).alias("uses"))
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("f")) for s, f, _ in weights])).alias("at")
    wide = parts.withColumn("shapley", shapley).select("part", "left", "edge", "alone", "shapley", edge)
    removed = F.col("edge")[F.col("at.state") * k + F.col("at.f")]
    per_edge = wide.select(
        "part",
        F.col("at.state").alias("state"),
        F.col("at.f").alias("f"),
        F.col("left")[F.col("at.state").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("at.f")))].alias("kept"),
        removed["n"].alias("removed"),
        (F.col("edge")[F.col("at.f")]["n"] - removed["n"]).alias("redundant"),
        F.col("alone")[F.col("at.f")].alias("unique_fails"),
        removed["good"].alias("good_lost"),
        removed["toxic"].alias("toxic_lost"),
        F.col("shapley")[F.col("at.f")].alias("shapley"),
    )
    used = per_edge.join(F.broadcast(picked), ["state", "f"]).withColumn("use", F.explode("uses"))
    return used.select("part", F.col("use.filter_order").alias("filter_order"), F.col("use.step").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def scan(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the
    five filters. Texts are read once; what is shuffled is a narrow row per document, by doc_id."""
    rows = written(failing(docs, part), "failing")
    return orders(lattice(mask_counts(with_labels(with_copies(rows, FILTERS.index("E")), labels))))
