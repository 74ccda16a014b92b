"""Near-duplicate documents by word shingles: a grouped prefix join that is exact at its threshold.

Shingles are ordered by how many texts have them, rarest first; two sets that are similar enough share one within the first
part (the prefix) of each. Texts without a shared shingle in their prefix are done there and then. The others form groups of
equal size and prefix; group pairs that share a prefix shingle and pass the size filter are expanded and verified on the
whole sets. As linked documents are only asked for by component, pairs within what is already one component are not visited:
first each shingle's groups are verified against two of them, then only pairs that are still in different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import ASCII_LOWER, NOT_SPACE, batch_texts, digested, distinct_texts, first_copies, give_back, mixed, word_hashes, written
from basketflow.llm.components import connected_components

WORDS = 5
#: Least similarity in hundredths.
PERCENT = 75
#: Rounds of pairs with one leading group per shingle, before the rest is compared in full.
ROUNDS = 3
#: Bytes of shingles that one counting bucket holds on average.
BUCKET_BYTES = 24 << 20
#: Text bytes for each shingle, on the low side; sets only the number of buckets.
BYTES_PER_SHINGLE = 6

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes. A text of fewer words is one shingle, without words none."""
    hashes, of = word_hashes(data, offsets, ASCII_LOWER, NOT_SPACE)
    begin = np.searchsorted(of, np.arange(len(offsets)))
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        rolled = hashes[:n].copy()
        for k in range(1, words):
            rolled = rolled * _STEP + hashes[k : k + n]
        rolled = mixed(rolled)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= words:
            found = np.sort(rolled[a : b - words + 1])
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            out.append(found[new])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n that any set similar enough must share one of, in a common order.

    >>> [prefix_length(n, 75) for n in (1, 3, 4, 100)]
    [1, 1, 2, 26]
    """
    return n - -(-percent * n // 100) + 1


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _shared_shingles(texts: DataFrame, buckets: int, words: int) -> DataFrame:
    """(shard, shingles, counts) of the shingles that two or more distinct texts have; packed arrays, split by shingle."""

    def local(rows: pa.Table) -> pa.Table:
        give_back()
        shard = rows.column("shard")[0].as_py()
        every = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(*batch_texts(first_copies(rows).column("text")), words)])
        every.sort()
        keys, counts = _sum_by(every, np.ones(len(every), np.int64))
        of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
        used = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
        return pa.table(
            {
                "bucket": pa.array(used, pa.int32()),
                "shard": pa.array([shard] * len(used), pa.int32()),
                "keys": pa.array([keys[cuts[k] : cuts[k + 1]].tobytes() for k in used], pa.binary()),
                "counts": pa.array([np.minimum(counts[cuts[k] : cuts[k + 1]], 255).astype(np.uint8).tobytes() for k in used], pa.binary()),
            }
        )

    def total(rows: pa.Table) -> pa.Table:
        give_back()
        keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("keys")]
        counts = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("counts")]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        some, sums = _sum_by(every[order], np.concatenate(counts)[order].astype(np.int64))
        some, sums = some[sums > 1], np.minimum(sums[sums > 1], 0xFFFF).astype(np.uint16)
        out_keys, out_counts = [], []
        for k in keys:
            at = np.minimum(np.searchsorted(some, k), max(len(some) - 1, 0))
            hit = some[at] == k if len(some) else np.zeros(len(k), bool)
            out_keys.append(k[hit].tobytes())
            out_counts.append(sums[at[hit]].tobytes())
        return pa.table({"shard": rows.column("shard"), "keys": pa.array(out_keys, pa.binary()), "counts": pa.array(out_counts, pa.binary())})

    cells = texts.groupBy("shard").applyInArrow(local, "bucket int, shard int, keys binary, counts binary")
    return cells.groupBy("bucket").applyInArrow(total, "shard int, keys binary, counts binary").where(F.octet_length("keys") > 0)


def _prefixes(texts: DataFrame, shared: DataFrame, percent: int, words: int) -> DataFrame:
    """Per distinct text: its set's size; if another text has a shingle of its prefix also that prefix and the whole set."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        give_back()
        rows = first_copies(rows)
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in known.column("keys"))])
        counts = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x.as_buffer(), np.uint16) for x in known.column("counts"))])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        sizes, nodes, groups, own, prefixes, sets = [], [], [], [], [], []
        for found in shingle_sets(*batch_texts(rows.column("text")), words):
            n = len(found)
            sizes.append(n)
            at = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
            often = np.where(keys[at] == found, counts[at], 1) if len(keys) else np.ones(n, np.uint16)
            p = prefix_length(n, percent) if n else 0
            # Enough shingles that no other text has fill the prefix: nothing can be similar.
            single = int((often == 1).sum())
            if single >= p:
                nodes.append(None), groups.append(None), own.append(None), prefixes.append(None), sets.append(None)
                continue
            first = np.lexsort((found, often))[:p]
            nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
            groups.append(xxhash.xxh3_128_digest(found[first].tobytes() + n.to_bytes(8, "little")))
            own.append(single)
            prefixes.append(found[first[single:]].astype(np.int64))
            sets.append(found.tobytes())
        return pa.table(
            {
                "digest": rows.column("digest"),
                "n_shingles": pa.array(sizes, pa.int64()),
                "node": pa.array(nodes, pa.binary()),
                "group": pa.array(groups, pa.binary()),
                "own": pa.array(own, pa.int64()),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                "shingles": pa.array(sets, pa.binary()),
            }
        )

    schema = "digest binary, n_shingles long, node binary, group binary, own long, prefix array<long>, shingles binary"
    return texts.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(run, schema)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))
        give_back()

    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _can_reach(n: Column, at: Column, m: Column, at2: Column, percent: int) -> Column:
    """Whether sets of n and m can be similar enough if their first common shingle has these places in their orders.

    Sizes too far apart fail this too, as the common part is no larger than what is left of the smaller set.
    """
    return (100 + percent) * F.least(n - at, m - at2) >= percent * (n + m)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct()


def _apart(postings: DataFrame, placed: DataFrame) -> DataFrame:
    """Postings, with their group's lowest and highest component, of shingles that reach more than one component."""
    spread = placed.groupBy("group").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    held = postings.join(spread, "group")
    several = held.groupBy("shingle").agg(F.min("low").alias("least"), F.max("high").alias("most")).where(F.col("least") < F.col("most"))
    return held.join(several.select("shingle"), "shingle")


def _to_leader(held: DataFrame, score: Column, percent: int) -> DataFrame:
    """Pairs of each shingle's group of the highest score with the shingle's groups in other components."""
    best = held.groupBy("shingle").agg(F.max(F.struct(score.alias("score"), "head", "n", "at", "low", "high")).alias("best"))
    other = F.least("low", "best.low") < F.greatest("high", "best.high")
    return held.join(best, "shingle").where(other & _can_reach(F.col("n"), F.col("at"), F.col("best.n"), F.col("best.at"), percent)).select(F.col("head").alias("a"), F.col("best.head").alias("b"))


def links(sets: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) over nodes with similar sets, from rows (node, group, n_shingles, own, prefix, shingles) once per node."""
    members = sets.select("node", "group")
    groups = sets.groupBy("group").agg(F.first("n_shingles").alias("n"), F.first("own").alias("own"), F.first("prefix").alias("prefix"), F.min("node").alias("head"))
    postings = groups.select("group", "n", "own", "head", F.posexplode("prefix").alias("k", "shingle"))
    postings = written(postings.withColumn("at", F.col("own") + F.col("k")).drop("k"), "postings")
    inner = members.join(groups.select("group", "head"), "group").select(F.col("node").alias("a"), F.col("head").alias("b"))
    placed = members.withColumn("part", F.col("node"))
    found = tested = None
    for k in range(rounds):
        held = _apart(postings, placed)
        if k:
            # Then the one with the most links so far, which is nearest to the middle of its copies.
            degree = found.select(F.explode(F.array("a", "b")).alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("degree"))
            held = held.join(degree, "head", "left")
            pairs = _to_leader(held, F.struct(F.coalesce("degree", F.lit(0)), F.xxhash64("head", F.lit(k))), percent)
            pairs = _ordered(pairs).join(tested, ["a", "b"], "left_anti")
        else:
            # First the group with the fewest shingles of its own: the original rather than a changed copy.
            pairs = _ordered(_to_leader(held, -F.col("own") / F.col("n"), percent).unionByName(inner))
        pairs = written(pairs, "pairs")
        more = written(_similar(pairs, sets, percent), "similar")
        tested = tested.unionByName(pairs) if k else pairs
        found = found.unionByName(more) if k else more
        if not more.limit(1).count():
            break
        parts = connected_components(found)
        placed = written(members.join(parts, "node", "left").select("group", "node", F.coalesce("component", "node").alias("part")), "placed")
    # What is in different components still is compared in full: a shingle's groups outside its main component with all.
    held = written(_apart(postings, placed), "held")
    most = held.groupBy("shingle", "low").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "low")).alias("m"))
    held = held.join(most.select("shingle", F.col("m.low").alias("main")), "shingle")
    is_main = (F.col("low") == F.col("main")) & (F.col("high") == F.col("main"))
    left = held.where(~is_main).select("shingle", F.col("group").alias("g"), F.col("n").alias("m"), F.col("at").alias("at2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    other = F.least("low", "low2") < F.greatest("high", "high2")
    crossing = held.join(left, "shingle").where(other & _can_reach(F.col("n"), F.col("at"), F.col("m"), F.col("at2"), percent) & (is_main | (F.col("group") <= F.col("g")))).select("group", "g")
    own = placed.groupBy("group").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("group", F.col("group").alias("g"))
    left_nodes = placed.select("group", F.col("node").alias("a"), F.col("part").alias("p"))
    right_nodes = placed.select(F.col("group").alias("g"), F.col("node").alias("b"), F.col("part").alias("q"))
    rest = crossing.unionByName(own).distinct().join(left_nodes, "group").join(right_nodes, "g").where(F.col("p") != F.col("q"))
    rest = _ordered(rest.select("a", "b")).join(tested, ["a", "b"], "left_anti")
    more = written(_similar(rest, sets, percent), "similar")
    return connected_components(found.unionByName(more))


def scan(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, with_keys: bool = False) -> DataFrame:
    """Each row of `docs` (doc_id, text; other columns are ignored) with its set's size and its component.

    Documents link when the share of common shingles in all of theirs reaches `percent` hundredths; the component is the
    smallest doc_id that links lead to. Equal texts link. NULL texts and texts without words have no shingles and no links:
    their component is their own id. Rows that repeat a doc_id are one document if the text is equal. NULL ids are kept and
    take no part in the minimum. `with_keys` adds `digest` (MD5 of the text) and `key`, equal for all texts of a component.
    """
    rows = digested(docs)
    members, texts = rows.select("doc_id", "digest"), distinct_texts(rows)
    buckets = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 8 // (BYTES_PER_SHINGLE * BUCKET_BYTES)))
    found = written(_prefixes(texts, _shared_shingles(texts, buckets, words), percent, words), "prefixes")
    sets = written(found.where(F.col("node").isNotNull()).dropDuplicates(["node"]).drop("digest"), "sets")
    parts = links(sets, percent)
    least = members.groupBy("digest").agg(F.min("doc_id").alias("least"))
    # A text's key is its component, or its set if that is linked to no other, or the text itself.
    keyed = found.select("digest", "n_shingles", "node").join(parts, "node", "left").join(least, "digest").select("digest", "n_shingles", "least", F.coalesce("component", "node", "digest").alias("key"))
    keyed = written(keyed, "keyed")
    lowest = keyed.groupBy("key").agg(F.min("least").alias("component_id"))
    by_text = keyed.join(lowest, "key").select("digest", "n_shingles", "component_id", *(["key"] if with_keys else []))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    return members.join(by_text, "digest").select("doc_id", "n_shingles", component, *(["digest", "key"] if with_keys else []))
