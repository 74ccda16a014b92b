"""Helpers shared by the corpus operators: tables, scratch folders, words as arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one group of documents (a shard) holds on average.
SHARD_BYTES = 6 << 20

#: Bytes of text that become Python strings at a time.
SLICE_BYTES = 2 << 20

WHITESPACE = b" \t\n\x0b\x0c\r"

_MIX_A = np.uint64(0x9E3779B97F4A7C15)
_MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The column with NULL as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder below `spark.checkpoint.dir`, which driver and executors share.

    Where the setting is absent the warehouse folder, which Spark shares too, is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """`df` as a Parquet table in the shared scratch folder: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shard_count(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards give about `shard_bytes` of text each; one pass over the text column."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // shard_bytes))


def batch_texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its n + 1 offsets. NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit changes every output bit."""
    values = values ^ (values >> np.uint64(32))
    values = values * _MIX_A
    values ^= values >> np.uint64(29)
    values *= _MIX_B
    values ^= values >> np.uint64(32)
    return values


_POWERS = {"at": np.ones(1, np.uint64), "back": np.ones(1, np.uint64)}
_BASE = 0x2545F4914F6CDD1D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS["at"]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for key, base in (("at", _BASE), ("back", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["at"][:n], _POWERS["back"][:n]


#: Bytes hashed at a time: keeps the temporary arrays in the processor's cache.
_BLOCK = 1 << 17


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in one buffer, and the text that each belongs to.

    `lower` maps bytes before hashing, `is_word` marks the mapped bytes that words are made of.
    Words never reach across texts. Equal words have equal hashes in every batch and task.
    """
    folded = lower[data]
    inside = is_word[folded]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_text = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_text] = inside[starts_text]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _BLOCK, "right")))
        a, b = start[lo], end[hi - 1]
        up, down = _powers(int(b - a) + 1)
        total = np.zeros(int(b - a) + 1, np.uint64)
        np.cumsum((folded[a:b].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _MIX_A
        lo = hi
    return mixed(out), np.searchsorted(offsets, start, "right") - 1


def byte_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


#: A-Z to a-z, all other bytes as they are.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Words are runs of bytes that are not ASCII white space.
NOT_SPACE = ~byte_table(WHITESPACE)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of `column`; a longer single row is a piece of its own."""
    _, offsets = batch_texts(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def give_back() -> None:
    """Returns what a task has freed to the system. Workers are used again, and would keep the most that any task held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def new_copies(batch: pa.RecordBatch, seen: set[bytes]) -> pa.RecordBatch:
    """The rows whose digest is not in `seen`, to which it goes."""
    new = [not (d in seen or seen.add(d)) for d in batch.column("digest").to_pylist()]
    return batch if all(new) else batch.filter(pa.array(new, pa.bool_()))


def digested(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, shard, digest, text) of each row; equal texts have equal digests and shards."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    shards = shard_count(rows, shard_bytes)

    return rows.select("doc_id", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", "text")


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(shard, digest, text) of `digested` rows with the copies of each input partition once.

    So a group of copies that holds a third of all rows sends one text from each partition. What is left of them within a
    shard, `first_copies` removes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            yield new_copies(batch, seen)

    return rows.select("shard", "digest", "text").mapInArrow(run, "shard int, digest binary, text string")


def first_copies(rows: pa.Table) -> pa.Table:
    """The rows of one shard with each digest once, in the order of the digests."""
    digests = rows.column("digest").to_pylist()
    at = {d: k for k, d in enumerate(digests)}
    return rows.take(pa.array([at[d] for d in sorted(at)], pa.int64()))
