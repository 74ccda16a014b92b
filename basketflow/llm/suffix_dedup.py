"""Removal of repeated byte strings with a sparse suffix array.

A string of `length` bytes is found by the suffix that starts at its anchor: the place of the smallest hash of 32 bytes in
it, which equal strings share. Only about one suffix in eighty is an anchor's, so few are shuffled, and no repeat is lost.

1. Each anchor sends a hash of its 32 leading bytes and one of its span (all strings it is the anchor of, put together).
   What leads no other suffix is done. Spans that occur twice are repeats as a whole.
2. One copy of each other span is sent to the suffix array: sampled splitters range-partition the suffixes by their leading
   bytes, and each task sorts its own with multikey quicksort, eight bytes at a time, forwards from the anchor and backwards.
   Splitters never divide equal leading bytes, so neighbours across a boundary share less than any repeat.
3. Neighbours that agree far enough, forwards and backwards, have the same string. The verdicts go back to the texts.

Spans with one lead are sorted in one task. A lead that very many spans have (a common passage in changing contexts) would be
a group without bound, so beyond `most_together` its spans' strings are counted by 128-bit hash instead, with partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import batch_texts, digested, distinct_texts, first_copies, mixed, new_copies, slices, written

LENGTH = 200
#: Leading bytes that anchors are chosen by.
LEAD = 32
#: Bytes of text handled at a time: its arrays stay in the processor's cache.
_CHUNK = 1 << 18
#: Suffixes sorted together, unless one leading string has more.
_ROWS = 1 << 14
#: Suffixes with one lead that are sorted together.
MOST_TOGETHER = _ROWS // 4
#: Spans whose strings are hashed into one batch.
_HASHED = 512
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor) of each run of consecutive strings with one anchor, for texts in one buffer.

    `first` and `last` are the places where the run's first and last string start.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    eight = _words(data)
    m = n - LEAD + 1
    order = eight[:m] * _FACTORS[0]
    for k in range(1, LEAD // 8):
        order ^= eight[8 * k : 8 * k + m] * _FACTORS[k]
    order ^= order >> np.uint64(31)
    order *= _FACTORS[1]
    order &= _HIGH
    order |= np.arange(m, dtype=np.uint64)
    width, step = length - LEAD + 1, 1
    while 2 * step <= width:
        order = np.minimum(order[:-step], order[step:])
        step *= 2
    if step < width:
        order = np.minimum(order[: n - length + 1], order[width - step :])
    anchor = (order & _LOW).astype(np.int64)
    # Strings that reach into the next text are none.
    start = np.arange(len(anchor))
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = of[: len(anchor)] == of[length - 1 :]
    start, anchor, of = start[inside], anchor[inside], of[start[inside]]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return start[first], start[last], anchor[first]


def _hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Each run's hash of its anchor's leading bytes, and that of its span."""
    eight = _words(data) if len(anchor) else np.zeros(0, np.uint64)
    key = np.zeros(len(anchor), np.uint64)
    for k in range(LEAD // 8):
        key = mixed(key + eight[anchor + 8 * k] + np.uint64(k)) if len(anchor) else key
    raw = memoryview(np.ascontiguousarray(data))
    digest = xxhash.xxh3_64_intdigest
    span = np.array([digest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
    return key.view(np.int64), span.view(np.int64)


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHUNK bytes."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _CHUNK, "right")) - 1)
        yield lo, hi
        lo = hi


def _anchored(column: pa.ChunkedArray | pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
    """(first text, end text, bytes, offsets, (first, last, anchor, key, span)) of each chunk of a text column."""
    data, offsets = batch_texts(column)
    for lo, hi in _chunks(data, offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        found = runs(part, at, length)
        yield lo, hi, part, at, (*found, *_hashes(part, *found, length))


def _code(key: np.ndarray, span: np.ndarray) -> np.ndarray:
    return mixed(key.view(np.uint64) + span.view(np.uint64) * _FACTORS[0])


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of big-endian numbers, and how many leading bytes each row shares with the one before it.

    Rows are parted by their first number, then only groups that are still equal by the next.
    """
    n, depth = words.shape
    order = np.argsort(words[:, 0], kind="stable") if depth else np.arange(n)
    starts = np.ones(n, bool)
    if depth:
        starts[1:] = words[order[1:], 0] != words[order[:-1], 0]
    for k in range(1, depth):
        tied = ~starts
        tied[:-1] |= ~starts[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group, key = np.cumsum(starts)[at], words[order[at], k]
        by = np.lexsort((key, group))
        order[at], key, group = order[at][by], key[by], group[by]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        starts[at] |= new
    as_bytes = np.ascontiguousarray(words.astype(">u8")).view(np.uint8)[order]
    shared = np.zeros(n, np.int64)
    differ = as_bytes[1:] != as_bytes[:-1]
    shared[1:] = np.where(differ.any(1), differ.argmax(1), 8 * depth)
    return order, shared


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), ">u8").reshape(len(strings), width // 8).astype(np.uint64)


def repeated(bodies: list[bytes], anchors: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Which of the strings of each span occur in another of the given spans too. `anchors` are places in the spans."""
    out = [np.zeros(len(b) - length + 1, bool) for b in bodies]
    if len(bodies) < 2:
        return out
    most = length - LEAD
    right, shared_right = multikey_order(_padded([b[a:] for b, a in zip(bodies, anchors, strict=True)], length))
    left, shared_left = multikey_order(_padded([b[:a][::-1] for b, a in zip(bodies, anchors, strict=True)], most))
    farthest, nearest = anchors, anchors - np.array([len(x) - 1 for x in out])
    for d in range(int(farthest.max()) + 1):
        # The string that starts d bytes before the anchor: equal if d bytes to the left and the rest to the right are.
        rows = np.flatnonzero((farthest >= d) & (nearest <= d))
        if len(rows) < 2:
            continue
        forwards, backwards = np.empty(len(bodies), np.int64), np.empty(len(bodies), np.int64)
        forwards[right] = np.cumsum(shared_right < length - d)
        backwards[left] = np.cumsum(shared_left < d)
        both = forwards[rows] * (len(bodies) + 1) + backwards[rows]
        _, where, counts = np.unique(both, return_inverse=True, return_counts=True)
        for k in rows[counts[where] > 1].tolist():
            out[k][farthest[k] - d] = True
    return out


def _sorted_bucket(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One range of the suffix array: rows come in the order of their leading bytes and are sorted and compared in blocks."""
    held: list[tuple] = []

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated([r[3] for r in rows], np.array([r[2] for r in rows], np.int64), length)
        return pa.RecordBatch.from_pydict(
            {"key": pa.array([r[0] for r in rows], pa.int64()), "span": pa.array([r[1] for r in rows], pa.int64()), "flags": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())}
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "span", "anchor", "body")), strict=True):
            if len(held) >= _ROWS and row[0] != held[-1][0]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(a, b, key, span, at): the 128-bit hash of each string of each span, and its place there."""
    for whole in batches:
        for lo in range(0, whole.num_rows, _HASHED):
            batch = whole.slice(lo, _HASHED)
            bodies = batch.column("body").to_pylist()
            sizes = [len(b) - length + 1 for b in bodies]
            digests = b"".join(xxhash.xxh3_128_digest(b[k : k + length]) for b, n in zip(bodies, sizes, strict=True) for k in range(n))
            halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
            at = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in sizes)])
            key, span = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("key", "span"))
            yield pa.RecordBatch.from_pydict({"a": halves[:, 0].copy(), "b": halves[:, 1].copy(), "key": key, "span": span, "at": at})


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of repeated strings in each span as packed bits."""
    for batch in batches:
        flags = []
        for at in batch.column("at").to_pylist():
            bits = np.zeros(max(at) + 1, bool)
            bits[at] = True
            flags.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "span": batch.column("span"), "flags": pa.array(flags, pa.binary())})


def _counted(spans: DataFrame, length: int) -> DataFrame:
    """The verdicts on spans of crowded leads. A string stands once in a span, so one that is counted twice is in two."""
    strings = spans.select("key", "span", "body").mapInArrow(lambda batches: _strings(batches, length), "a long, b long, key long, span long, at int")
    twice = strings.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a", "b")
    hits = strings.join(twice, ["a", "b"]).groupBy("key", "span").agg(F.collect_list("at").alias("at"))
    return hits.mapInArrow(_flagged, "key long, span long, flags binary")


def scan(docs: DataFrame, length: int = LENGTH, with_text: bool = False, most_together: int = MOST_TOGETHER) -> DataFrame:
    """What is left of each row of `docs` (doc_id, text; other columns are ignored) without its repeated strings.

    Removed is each byte of the UTF-8 text inside a string of `length` bytes that also starts anywhere else in the table, in
    the same text or another. Per row: the text's bytes, those removed, the maximal removed runs, the SHA-256 of the rest;
    with `with_text` also `kept`, the rest as binary (it may end within a character). NULL is an empty text; shorter texts
    than `length` lose nothing. A repeated row repeats its whole text. `most_together` changes the plan, not the result.
    """
    rows = digested(docs)
    members, texts = rows.select("doc_id", "digest"), distinct_texts(rows)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for whole in batches:
            for batch in slices(new_copies(whole, known), "text", 16 * _CHUNK):
                shard, parts = batch.column("shard").to_numpy(), []
                for lo, _, _, at, (first, _, _, key, span) in _anchored(batch.column("text"), length):
                    parts.append((key, span, shard[lo + np.searchsorted(at, first, "right") - 1]))
                key, span, of = (np.concatenate(x) for x in zip(*parts, strict=True))
                code = _code(key, span) + of.astype(np.uint64) * _FACTORS[2]
                _, at, n = np.unique(code, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": key[at], "span": span[at], "shard": of[at].astype(np.int32), "n": np.minimum(n, 2).astype(np.int8)})

    seen = written(rows.select("shard", "digest", "text").mapInArrow(local, "key long, span long, shard int, n byte"), "suffixes")
    led = seen.groupBy("key").agg(F.sum("n").alias("c"), F.min("span").alias("least"), F.max("span").alias("most")).where("c > 1").select("key", (F.col("least") < F.col("most")).alias("several"), (F.col("c") > most_together).alias("crowded"))
    shared = written(seen.join(led, "key"), "shared")
    spans = shared.groupBy("key", "span").agg((F.sum("n") > 1).alias("full"), F.min("shard").alias("from"))
    placed = written(shared.join(spans, ["key", "span"]).select("key", "span", "shard", "several", "crowded", "full", (F.col("several") & (F.col("shard") == F.col("from"))).alias("send")).distinct(), "placed")

    def bodies(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        left = dict(zip(_code(*(wanted.column(c).to_numpy() for c in ("key", "span"))).tolist(), wanted.column("crowded").to_pylist(), strict=True))
        keys, spans, crowds, places, leads, out = [], [], [], [], [], []
        if left:
            for _, _, part, _, (first, last, anchor, key, span) in _anchored(first_copies(rows).column("text"), length):
                raw = part.tobytes()
                for k, code in enumerate(_code(key, span).tolist()):
                    if code in left:
                        crowds.append(left.pop(code))
                        a, b, at = int(first[k]), int(last[k]), int(anchor[k])
                        keys.append(key[k]), spans.append(span[k]), places.append(at - a), out.append(raw[a : b + length])
                        leads.append(int.from_bytes(raw[at : at + 8], "big") - (1 << 63))
        return pa.table({"key": pa.array(keys, pa.int64()), "span": pa.array(spans, pa.int64()), "crowded": pa.array(crowds, pa.bool_()), "anchor": pa.array(places, pa.int32()), "lead": pa.array(leads, pa.int64()), "body": pa.array(out, pa.binary())})

    def cut(rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        rows = first_copies(rows)
        flags = dict(zip(_code(*(verdicts.column(c).to_numpy() for c in ("key", "span"))).tolist(), verdicts.column("flags").to_pylist(), strict=True))
        sizes, removed, pieces, digests, kept = [], [], [], [], []
        for lo, hi, part, at, (first, last, _, key, span) in _anchored(rows.column("text"), length):
            change = np.zeros(len(part) + 1, np.int64)
            for k, code in enumerate(_code(key, span).tolist()):
                if code in flags:
                    found, a, b = flags[code], first[k], last[k]
                    if found is None:
                        change[a] += 1
                        change[b + length] -= 1
                    else:
                        hit = a + np.flatnonzero(np.unpackbits(np.frombuffer(found, np.uint8), count=b - a + 1))
                        change[hit] += 1
                        change[hit + length] -= 1
            gone = np.cumsum(change[:-1]) > 0
            for k in range(hi - lo):
                mine, own = gone[at[k] : at[k + 1]], part[at[k] : at[k + 1]]
                rest = own[~mine].tobytes()
                sizes.append(len(own)), removed.append(int(mine.sum())), digests.append(hashlib.sha256(rest).hexdigest()), kept.append(rest if with_text else None)
                pieces.append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
        return pa.table(
            {"digest": rows.column("digest"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(pieces, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.binary())}
        )

    sent = texts.groupBy("shard").cogroup(placed.where("send").groupBy("shard")).applyInArrow(bodies, "key long, span long, crowded boolean, anchor int, lead long, body binary")
    # Written, as sampling the splitters reads it too.
    sent = written(sent, "bodies")
    ranged = sent.where("NOT crowded").drop("crowded").repartitionByRange("lead", "key").sortWithinPartitions("lead", "key")
    partly = ranged.mapInArrow(lambda batches: _sorted_bucket(batches, length), "key long, span long, flags binary").unionByName(_counted(sent.where("crowded"), length))
    whole = placed.where("full").select("shard", "key", "span", F.lit(None).cast("binary").alias("flags"))
    some = placed.where("several and not full").join(partly, ["key", "span"]).select("shard", "key", "span", "flags")
    verdicts = whole.unionByName(some)
    left = texts.groupBy("shard").cogroup(verdicts.groupBy("shard")).applyInArrow(cut, "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    copies = members.groupBy("digest").agg((F.count(F.lit(1)) > 1).alias("copied"))
    gone = F.col("copied") & (F.col("n_bytes") >= length)
    left = left.join(copies, "digest").select(
        "digest",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    return members.join(left, "digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
