"""Approximate nearest neighbours by cross-polytope hashing, reranked exactly.

A vector is made a unit vector, rotated by three rounds of random signs and a fast Hadamard transform, and gets the nearest
signed axis. The axes of `polytopes` such rotations are one table's code. Rows are indexed in `tables` tables under one code each;
a query looks into the `probes` codes of each table that lie nearest to it, and the rows found there are reranked by their inner
products in double precision on the original vectors.

Bounds and sizes. The number of polytopes follows from the number of rows, so that a code holds few rows at any size. The number
of probes is fitted: at most `SAMPLE` queries, those with the smallest hash of their id, are searched exactly, and the least number
that finds `TARGET` of their neighbours is taken. All rows are indexed. Codes are dealt to tasks in cells of about `CELL_BYTES`;
a cell that has more is split, and its queries go to each part. The rows of a part are held, its queries stream past.

Equal vectors are indexed once, with their smallest ids: more than one more than the asked neighbours can't be in any answer. So
copies that are a third of all rows cost as much as one. Vectors that are near, but not equal, meet in one cell's parts.

If norms differ, a coordinate is added that gives all rows one norm, so that the nearest by angle is the largest inner product.

Defined cases: vectors that are NULL, zero or hold NULL or non-finite components take no part, nor do rows without vec_id or of
another length than most rows have (of lengths equally frequent, the longest). Repeated rows count once; an id with several vectors
is a row for each, and never its own neighbour. Ties go to the smaller vec_id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketflow.llm.common import written

TABLES = 8
#: Rows that a code holds on average at most.
CODE_ROWS = 64
#: Bytes of coordinates, in double precision, of a cell's rows, and of a part of a larger cell twice as many: a task holds one part.
CELL_BYTES = 16 << 20
#: Queries whose exact neighbours fit the number of probes, and the share of these that it finds.
SAMPLE = 128
TARGET = 0.95
#: Codes of a table that a query can look into, at most; if they do not find the share, `fit` stops with an error.
MOST_PROBES = 1 << 14

_QUERIES_AT_ONCE = 128
#: Products of queries and rows that are held at a time.
_PAIRS_AT_ONCE = 1 << 21
_SEED = 20240


@dataclass(frozen=True)
class Hashing:
    """How vectors become codes."""

    dims: int
    norm: float
    lifted: bool
    polytopes: int
    cell_bits: int
    tables: int = TABLES
    probes: int = 1

    @property
    def width(self) -> int:
        """Coordinates after padding to a power of two."""
        return 1 << max(1, (self.dims + self.lifted - 1).bit_length())

    @property
    def axis_bits(self) -> int:
        return self.width.bit_length()  # two signs for each coordinate

    @property
    def code_bits(self) -> int:
        return self.axis_bits * self.polytopes

    def signs(self) -> np.ndarray:
        draw = np.random.Generator(np.random.PCG64(_SEED)).integers(0, 2, (self.tables, self.polytopes, 3, self.width))
        return (draw * 2 - 1).astype(np.float64)

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        if self.lifted and not query:
            out[:, : self.dims] = x / self.norm
            out[:, self.dims] = np.sqrt(np.maximum(0.0, 1.0 - np.square(out[:, : self.dims]).sum(1)))
        else:
            # Scaled by the largest component first: squares of tiny components would be 0.
            x = x / np.abs(x).max(1, keepdims=True)
            out[:, : self.dims] = x / np.sqrt(np.square(x).sum(1, keepdims=True))
        return out

    def signed(self, units: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """The rotated vectors' products with each signed axis: 2i for the axis i, 2i + 1 for its opposite."""
        y = units
        for s in signs:
            y = hadamard(y * s)
        return np.stack([y, -y], 2).reshape(len(y), -1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the code of each row in each table."""
        units, out = self.unit(x, query=False), np.zeros((len(x), self.tables), np.int64)
        for t, table in enumerate(self.signs()):
            for signs in table:
                out[:, t] = (out[:, t] << self.axis_bits) | np.argmax(self.signed(units, signs), 1)
        return out

    def probed(self, x: np.ndarray, probes: int) -> Iterator[np.ndarray]:
        """For each table (rows, probes): the codes nearest to each query, nearest first.

        The loss of an axis is the squared distance of its product from the best one; a code's loss is the sum over its axes.
        """
        units = self.unit(x, query=True)
        probes = min(probes, 1 << self.code_bits)
        for table in self.signs():
            loss, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for signs in table:
                v = self.signed(units, signs)
                axes = np.argsort(-v, 1, kind="stable")[:, : min(probes, v.shape[1])]
                lost = np.square(v.max(1, keepdims=True) - np.take_along_axis(v, axes, 1))
                # Of two ascending lists only pairs with (i + 1)(j + 1) <= probes can be among the best.
                i, j = np.divmod(np.arange(loss.shape[1] * lost.shape[1]), lost.shape[1])
                fit = (i + 1) * (j + 1) <= probes
                i, j = i[fit], j[fit]
                total = loss[:, i] + lost[:, j]
                order = np.argsort(total, 1, kind="stable")[:, :probes]
                loss = np.take_along_axis(total, order, 1)
                code = np.take_along_axis((code[:, i] << self.axis_bits) | axes[:, j], order, 1)
            yield code


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; its length is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        step *= 2
    return x.reshape(n, width) / np.sqrt(width)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in one order wherever a pair stands: equal vectors get equal scores."""
    return (a * b).sum(1)


def best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each query, ties to the smaller row."""
    order = np.lexsort((row, -score, query))
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


def candidates(q: np.ndarray, x: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs that can be among each query's k best, ties included; `allowed` masks pairs."""
    rough = q @ x.T
    if allowed is not None:
        rough[~allowed] = -np.inf
    if rough.shape[1] > k:
        least = np.partition(rough, rough.shape[1] - k, 1)[:, rough.shape[1] - k]
        # Products of a matrix may differ in the last digits from those of a pair.
        size = np.sqrt(np.square(q).sum(1) * np.square(x).sum(1).max())
        near = rough >= (least - 1e-10 * size)[:, None]
    else:
        near = np.ones(rough.shape, bool)
    i, j = np.nonzero(near & (rough > -np.inf))
    return i, j, products(q[i], x[j])


def cell_rows(dims: int) -> int:
    return max(1, CELL_BYTES // (8 * dims))


def usable(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part, whatever their length."""
    vec = F.col(column)
    fine = F.forall(vec, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))) & F.exists(vec, lambda v: v != 0)
    return embeddings.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))


def hashing_of(rows: DataFrame, tables: int = TABLES) -> Hashing | None:
    """Dimensions, norms and polytopes for these rows: one pass, one row for each length of vectors."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    seen = rows.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("high"), F.min(norm).alias("low"))
    most = seen.orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return None
    lifted = most["low"] < most["high"] * (1 - 1e-6)
    one = Hashing(most["dims"], most["high"], lifted, 1, 0, tables)
    polytopes = 1
    while one.axis_bits * polytopes < 62 - one.axis_bits and (CODE_ROWS << one.axis_bits * polytopes) < most["n"]:
        polytopes += 1
    bits = min(one.axis_bits * polytopes, (int(most["n"]) // cell_rows(most["dims"])).bit_length())
    return replace(one, polytopes=polytopes, cell_bits=bits)


def indexed(rows: DataFrame, how: Hashing, k: int) -> DataFrame:
    """(rep, ids, vec, codes): each distinct vector with its smallest id, its k + 1 smallest ids, and a code for each table."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    # The rank is cut before the shuffle too, so a vector that very many rows have sends k + 1 ids from each task.
    least = rows.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    copies = least.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vec")
    schema = T.StructType([*copies.schema, T.StructField("codes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = how.codes(matrix(batch.column("vec"), how.dims))
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * how.tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, held], names=schema.names)

    return copies.mapInArrow(run, schema)


def fit(index: DataFrame, asked: DataFrame, how: Hashing, k: int) -> Hashing:
    """`how` with the number of probes that finds `TARGET` of the exact k neighbours of a bounded sample of queries."""
    sample = asked.orderBy(F.xxhash64("qid"), "qid").limit(SAMPLE).collect()
    if not sample:
        return how
    q = np.array([r["vec"] for r in sample], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, reps = matrix(batch.column("vec"), how.dims), batch.column("rep").to_numpy()
            i, j, score = candidates(q, x, k + 1)
            other = (q[i] != x[j]).any(1)
            i, j, score = i[other], j[other], score[other]
            keep = best(i, reps[j], score, k)
            yield pa.RecordBatch.from_arrays([pa.array(i[keep]), batch.column("rep").take(pa.array(j[keep])), pa.array(score[keep]), batch.column("codes").take(pa.array(j[keep]))], names=["q", "rep", "score", "codes"])

    found = index.select("rep", "vec", "codes").mapInArrow(run, "q long, rep long, score double, codes array<long>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    exact = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "codes").collect()
    if not exact:
        return how
    at, codes = np.array([r["q"] for r in exact]), np.array([r["codes"] for r in exact], np.int64)
    first = np.full(len(at), MOST_PROBES)
    for t, probed in enumerate(how.probed(q, MOST_PROBES)):
        for s in range(0, len(at), 512):
            hit = probed[at[s : s + 512]] == codes[s : s + 512, t, None]
            first[s : s + 512] = np.minimum(first[s : s + 512], np.where(hit.any(1), hit.argmax(1), MOST_PROBES))
    probes = int(np.sort(first)[int(np.ceil(TARGET * len(first))) - 1]) + 1
    if probes > MOST_PROBES:
        raise ValueError(f"{MOST_PROBES} probes in each of {how.tables} tables do not find {TARGET:.0%} of the neighbours; use more tables")
    return replace(how, probes=probes)


def _cell(how: Hashing, code: Column) -> Column:
    return F.call_function("shiftright", code, F.lit(how.code_bits - how.cell_bits))


def _looked_up(asked: DataFrame, how: Hashing) -> DataFrame:
    """A row (tab, cell, id, vec, codes) for each query and cell that its probes lie in."""
    kind = asked.schema["vec"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _QUERIES_AT_ONCE):
                batch = whole.slice(lo, _QUERIES_AT_ONCE)
                for tab, codes in enumerate(how.probed(matrix(batch.column("vec"), how.dims), how.probes)):
                    row, code = np.repeat(np.arange(len(codes)), codes.shape[1]), codes.ravel()
                    cell = code >> (how.code_bits - how.cell_bits)
                    order = np.lexsort((code, cell, row))
                    row, cell, code = row[order], cell[order], code[order]
                    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])
                    held = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), pa.array(code))
                    at = pa.array(row[starts])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), tab, np.int32)), pa.array(cell[starts]), batch.column("qid").take(at), batch.column("vec").take(at), held], names=["tab", "cell", "id", "vec", "codes"])

    schema = T.StructType([T.StructField("tab", T.IntegerType()), T.StructField("cell", T.LongType()), T.StructField("id", T.LongType()), T.StructField("vec", kind), T.StructField("codes", T.ArrayType(T.LongType()))])
    return asked.select("qid", "vec").mapInArrow(run, schema)


def _reranked(dealt: DataFrame, how: Hashing, k: int) -> DataFrame:
    """(qid, rep, score): the k best rows of each query in each part of a cell.

    A part's rows come first and are held (their number is bounded), then its queries stream past them.
    """
    keys = ["tab", "cell", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, built = None, [], None
        for batch in batches:
            named = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*keys, "is_query")], 1)
            cuts = np.flatnonzero((named[1:] != named[:-1]).any(1)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(named)]):
                if not len(named):
                    continue
                if group != (key := tuple(named[lo, :3])):
                    group, held, built = key, [], None
                piece = batch.slice(lo, hi - lo)
                if not named[lo, 3]:
                    held.append((piece.column("id").to_numpy(), matrix(piece.column("vec"), how.dims), piece.column("codes").flatten().to_numpy()))
                    continue
                if not held:
                    continue
                if built is None:
                    ids, x, codes = (np.concatenate(c) for c in zip(*held))
                    built = ids, x, *np.unique(codes, return_inverse=True)
                ids, x, known, slot = built
                at_once = max(1, min(_QUERIES_AT_ONCE, _PAIRS_AT_ONCE // len(ids)))
                for s in range(0, piece.num_rows, at_once):
                    some = piece.slice(s, at_once)
                    lists = some.column("codes")
                    code = lists.flatten().to_numpy()
                    row = np.repeat(np.arange(some.num_rows), np.diff(lists.offsets.to_numpy()))
                    spot = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    real = known[spot] == code
                    open_ = np.zeros((some.num_rows, len(known)), bool)
                    open_[row[real], spot[real]] = True
                    any_ = np.flatnonzero(open_.any(1))
                    if not len(any_):
                        continue
                    i, j, score = candidates(matrix(some.column("vec"), how.dims)[any_], x, k, open_[any_][:, slot])
                    keep = best(i, ids[j], score, k)
                    qids = some.column("id").to_numpy()[any_]
                    yield pa.RecordBatch.from_arrays([pa.array(qids[i[keep]]), pa.array(ids[j[keep]]), pa.array(score[keep])], names=["qid", "rep", "score"])

    sorted_ = dealt.repartition(*keys).sortWithinPartitions(*keys, "is_query")
    return sorted_.mapInArrow(run, "qid long, rep long, score double")


def search(embeddings: DataFrame, asked: Column, k: int = 20, column: str = "embedding", tables: int = TABLES, most_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of each row that `asked` (a condition on vec_id) selects.

    Cells of more than `most_rows` rows are split (two cells' bytes, if not given).
    """
    rows = usable(embeddings, column)
    how = hashing_of(rows, tables)
    if how is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vec") == how.dims)
    index = written(indexed(rows, how, k), "index")
    queries = rows.where(asked).distinct()
    first = queries.groupBy("vec").agg(F.min("vec_id").alias("qid"))
    distinct_queries = written(first.select("qid", "vec"), "asked")
    how = fit(index, distinct_queries, how, k)

    points = index.select(F.posexplode("codes").alias("tab", "code"), F.col("rep").alias("id"), "vec").withColumn("cell", _cell(how, F.col("code")))
    full = points.groupBy("tab", "cell").agg(F.ceil(F.count(F.lit(1)) / (most_rows or 2 * cell_rows(how.dims))).alias("parts")).where("parts > 1")
    spread = points.join(full, ["tab", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    probes = _looked_up(distinct_queries, how).join(full, ["tab", "cell"], "left")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    dealt = spread.select("tab", "cell", "part", F.lit(0).alias("is_query"), "id", "vec", F.array("code").alias("codes")).unionByName(
        probes.select("tab", "cell", "part", F.lit(1).alias("is_query"), "id", "vec", "codes")
    )
    # Every table finds the same pair anew; one exchange serves the distinct pairs and the ranks.
    by_query = Window.partitionBy("qid").orderBy(F.desc("score"), "rep")
    found = _reranked(dealt, how, k + 1).repartition("qid").groupBy("qid", "rep").agg(F.max("score").alias("score"))
    nearest = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k + 1)
    copies = index.where(F.size("ids") > 1).select("rep", "ids")
    members = nearest.join(copies, "rep", "left").select("qid", "score", F.explode(F.coalesce("ids", F.array("rep"))).alias("vec_id"))
    by_id = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    lists = (
        members.withColumn("rank", F.row_number().over(by_id))
        .where(F.col("rank") <= k + 1)
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    )
    # Queries with one vector share its list; each leaves out its own id.
    own = queries.join(first, "vec").select(F.col("vec_id").alias("query_id"), "qid").join(lists, "qid")
    others = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "c")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))


def scan(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by `every`."""
    return search(embeddings, F.col("vec_id") % every == 0, k)
