"""Conversation prefix trie: how conversations share their first turns, for training that computes a shared prefix once.

A conversation becomes rows of `BLOCK` positional turn-id columns. One ROLLUP over these columns counts every prefix of the
block at once, grouping_id telling how many columns of a row are in its group. A longer conversation continues in a further
row, which is keyed by the node that its prior block ended in, so conversations that part stay apart in all later blocks.

A turn's id is its 128-bit digest. A node's key is its depth and two 64-bit lanes, each the XOR of a hash of (position, turn
id) over the path: it needs no row of the block before, and a parent's key is the node's own without its last turn.

Subtree values come from a second ROLLUP. Let a node's owner be its smallest member. Below the first node that it owns, a
conversation owns its whole path; so a subtree's saved tokens are, summed over its members but the owner of its top, the words
of the turns that the member does not own and that lie within the subtree. Leaves are counted by their owners.

Defined cases: turns are ordered by number, NULL first, equal numbers by the digest of (role, text), so repeated rows are turns
of their own in any order; NULL role and text are empty; rows without conv_id take no part; other columns are ignored. A table
without conversations gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketflow.llm.common import written

#: Turns in a row of the ROLLUP.
BLOCK = 8
#: Turns of a conversation are numbered, and its blocks chained, in runs of this many, so that a long one is not one task.
RUN = 4096
#: Conversation ids of a node in one piece of its member list.
PIECE = 4096

WORD = r"[^\x20\x09-\x0D]+"
LANES = ("key_a", "key_b")
NODE = ("depth", *LANES)


def _lane(which: int, pos: Column, turn_id: Column) -> Column:
    # The lane's number leads: lanes of equal ids must not share the hash's first state.
    return F.xxhash64(F.lit(which), turn_id, pos.cast("long"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, turn_id, words) of every row with a conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        digest.alias("turn_id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def numbered(turns: DataFrame, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """`turns` with `pos` (1, 2, ... within the conversation), and (conv_id, n) of every conversation.

    Positions are counted within runs of turn numbers first, then the runs' sizes are added up.
    """
    runs = turns.withColumn("run", F.coalesce(F.floor(F.col("turn") / run), F.lit(-(1 << 62))).cast("long"))
    inner = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "turn_id")
    held = written(runs.withColumn("at", F.row_number().over(inner)), "turns")
    sizes = held.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("conv_id", "run", F.coalesce(before, F.lit(0)).alias("start"))
    placed = held.join(starts, ["conv_id", "run"]).select("conv_id", (F.col("start") + F.col("at")).alias("pos"), "turn_id", "words")
    return placed, sizes.groupBy("conv_id").agg(F.sum("size").alias("n"))


def rebuilt(placed: DataFrame, sizes: DataFrame, group: int, shared: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, turn_id, words) of the conversations built anew, and their (conv_id).

    A conversation takes its first h turns from the one whose id is its own rounded down to a multiple of `group`, and goes on
    with its own turns after its first h; h is crc32(conv_id) modulo `shared`.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    plan = sizes.select("conv_id", base.alias("base"), h.alias("h"))
    heads = placed.where((F.col("conv_id") % group == 0) & (F.col("pos") < shared)).withColumnRenamed("conv_id", "base")
    taken = plan.join(heads, "base").where("pos <= h").select("conv_id", "pos", "turn_id", "words")
    of_base = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shift = plan.join(of_base, "base", "left").select("conv_id", "h", (F.least("h", F.coalesce("base_n", F.lit(0))) - F.col("h")).alias("shift"))
    # One row per conversation is joined to its turns: Spark splits a conversation that is far longer than others.
    own = placed.join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "turn_id", "words")
    return taken.unionByName(own), sizes.select("conv_id")


def blocks(turns: DataFrame, convs: DataFrame, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """One row per conversation and block: `block`, the prior node's lanes and words, and a column per position with (id, words).

    Every conversation has a first row, even without turns.
    """
    rows = turns.select("conv_id", "pos", F.struct(F.col("turn_id").alias("id"), "words").alias("turn"), *[_lane(i, F.col("pos"), F.col("turn_id")).alias(k) for i, k in enumerate(LANES)], "words")
    nothing = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), *[F.lit(0).cast("long").alias(k) for k in LANES], F.lit(0).cast("long").alias("words"))
    wide = (
        rows.unionByName(nothing)
        .withColumn("block", F.floor((F.greatest("pos", F.lit(1)) - 1) / block).cast("long"))
        .groupBy("conv_id", "block")
        .agg(
            *[F.max(F.when((F.col("pos") > 0) & ((F.col("pos") - 1) % block == i), F.col("turn"))).alias(f"t{i}") for i in range(block)],
            *[F.bit_xor(k).alias(f"own_{k}") for k in LANES],
            F.sum("words").alias("own_words"),
        )
        .withColumn("run", F.floor(F.col("block") / run))
    )

    def chained(by: list[str], order: str, prefix: str, out: str) -> dict[str, Column]:
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        sums = {f"{out}_{k}": F.coalesce(F.bit_xor(f"{prefix}_{k}").over(before), F.lit(0)) for k in LANES}
        return {**sums, f"{out}_words": F.coalesce(F.sum(f"{prefix}_words").over(before), F.lit(0))}

    inner = wide.withColumns(chained(["conv_id", "run"], "block", "own", "in"))
    runs = wide.groupBy("conv_id", "run").agg(*[F.bit_xor(f"own_{k}").alias(f"run_{k}") for k in LANES], F.sum("own_words").alias("run_words"))
    runs = runs.withColumns(chained(["conv_id"], "run", "run", "pre")).select("conv_id", "run", *[f"pre_{k}" for k in LANES], "pre_words")
    return inner.join(runs, ["conv_id", "run"]).select(
        "conv_id",
        "block",
        *[F.col(f"pre_{k}").bitwiseXOR(F.col(f"in_{k}")).alias(f"prior_{k}") for k in LANES],
        (F.col("pre_words") + F.col("in_words")).alias("prior_words"),
        *[f"t{i}" for i in range(block)],
    )


def rolled(wide: DataFrame, sums: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Every node with its key, parent's key, `above` (words of the path before its last turn), `words` of its last turn, and
    the aggregates of `sums` over its members' rows."""
    turns = ", ".join(f"t{i}" for i in range(block))
    prior = "block, " + ", ".join(f"prior_{k}" for k in LANES) + ", prior_words"
    asked = ", ".join(f"{expr} AS {name}" for name, expr in sums.items())
    groups = wide.sparkSession.sql(
        f"SELECT {prior}, {turns}, {block} - bit_count(grouping_id()) AS used, {asked} FROM {{wide}} GROUP BY {prior}, ROLLUP({turns})", wide=wide
    )
    held = F.array(*[f"t{i}" for i in range(block)])
    # A group counts if its last column holds a turn; the one without columns is a node only at the root.
    last = F.when(F.col("used") > 0, held[F.col("used") - 1])
    groups = groups.withColumn("last", last).where("last IS NOT NULL OR (used = 0 AND block = 0)")
    depth = F.col("block") * block + F.col("used")

    def xor(which: int, key: str, upto: Column) -> Column:
        out = F.col(f"prior_{key}")
        for i in range(block):
            out = out.bitwiseXOR(F.when(F.lit(i) < upto, _lane(which, F.col("block") * block + i + 1, F.col(f"t{i}")["id"])).otherwise(0))
        return out

    above = F.col("prior_words")
    for i in range(block):
        above = above + F.when(F.lit(i) < F.col("used") - 1, F.col(f"t{i}")["words"]).otherwise(0)
    return groups.select(
        depth.cast("long").alias("depth"),
        *[xor(w, k, F.col("used")).alias(k) for w, k in enumerate(LANES)],
        *[xor(w, k, F.col("used") - 1).alias(f"parent_{k}") for w, k in enumerate(LANES)],
        above.alias("above"),
        F.coalesce(F.col("last")["words"], F.lit(0)).alias("words"),
        *sums,
    )


def ends(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, lanes, total) of the node that each conversation ends in; total is its words."""
    found = turns.groupBy("conv_id").agg(F.max("pos").alias("depth"), *[F.bit_xor(_lane(w, F.col("pos"), F.col("turn_id"))).alias(k) for w, k in enumerate(LANES)], F.sum("words").alias("total"))
    return convs.join(found, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*NODE, "total")])


def id_hashes(ended: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node, ends_sha256) over each node's ascending conv_ids, comma-joined.

    The ids are sorted and joined in pieces of a bounded number of ids, by as many tasks as there are pieces; a node's pieces
    then run through one hash in their order, never held together, as the digest of one string can only be taken in sequence.
    """
    pieces = (
        ended.withColumn("piece", F.floor(F.col("conv_id") / piece))
        .groupBy(*NODE, "piece")
        .agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))).alias("ids"))
    )
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []

        def rows(done: list) -> pa.RecordBatch:
            kinds = [pa.int64()] * len(NODE) + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * len(kinds), kinds)], names=[*NODE, "ends_sha256"])

        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if key != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(out)
            out = []
        if node is not None:
            yield rows([(*node, state.hexdigest())])

    return ordered.select(*NODE, "ids").mapInArrow(run, ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """The nodes of the trie of all given conversations: (conv_id, pos 1, 2, ..., turn_id, words), (conv_id).

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    wide = written(blocks(turns, convs, block, run), "blocks")
    nodes = written(rolled(wide, {"n_convs": "count(*)", "conv_id": "min(conv_id)"}, block), "nodes")
    parent = [F.col(f"parent_{k}").alias(k) for k in LANES]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *parent).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    ended = ends(turns, convs)
    # What a conversation shares with smaller ones: the words above its first own node, or all if it owns none.
    owned = nodes.groupBy("conv_id").agg(F.min_by("above", "depth").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    marks = ended.join(owned, "conv_id", "left").select("conv_id", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    below = rolled(wide.join(marks, "conv_id"), {"n_leaves": "sum(leaf)", "all_shared": "sum(shared)", "owner_shared": "min_by(shared, conv_id)"}, block)

    owners = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(f"parent_{k}") for k in LANES], F.col("conv_id").alias("parent_conv_id"))
    saved = F.col("all_shared") - F.col("owner_shared") - (F.col("n_convs") - 1) * F.col("above")
    return (
        nodes.join(below.select(*NODE, "n_leaves", "all_shared", "owner_shared"), list(NODE))
        .join(id_hashes(ended), list(NODE), "left")
        .join(owners, ["depth", *[f"parent_{k}" for k in LANES]], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            saved.alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def scan(conversations: DataFrame, group: int = 20, shared: int = 4, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """The trie of the conversations rebuilt by `rebuilt`."""
    placed, sizes = numbered(turns_of(conversations), run)
    sizes = written(sizes, "sizes")
    turns, convs = rebuilt(placed, sizes, group, shared)
    return trie(written(turns, "rebuilt"), convs, block, run)
