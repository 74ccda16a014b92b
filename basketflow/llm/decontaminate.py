"""Benchmark decontamination with suffix arrays of the training text.

Every task turns its documents into shards of bounded size and builds each shard's suffix array over words. Each distinct
window of the benchmark's suffixes is then binary-searched in it once, so a word of the text begins at most one match of a
length. Hit words come from the windows, items from a list by window, and runs of windows that follow each other in an item
are the longest matches. The benchmark is sent in blocks of bounded size over its distinct texts, each a further pass and job,
so its size is not limited by an executor's memory. With one block no document is shuffled; with more, the findings of all but
the last are joined to the documents by digest.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import slices, text_of, written

#: Bytes of documents in one suffix array, and of benchmark text in one block.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20

#: Words are runs of 0-9, a-z and everything beyond ASCII, after lower-casing A-Z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Word ids in a sort key; ids take _BITS bits each.
_WIDE, _BITS = 3, 21

#: Names of items in one batch of rows, and in what is kept of the texts before.
_BATCH_NAMES = 1 << 18

#: What the passes over the blocks fill in.
_FOUND = ["n_words", "spans", "items", "longest", "longest_item", "longest_start"]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _keys(seq: np.ndarray) -> np.ndarray:
    """Each suffix's next three words as one number; 0 stands for the end of a document."""
    padded = np.concatenate([seq, np.zeros(_WIDE - 1, np.int64)])
    n = len(seq)
    return (padded[:n] << (2 * _BITS)) | (padded[1 : n + 1] << _BITS) | padded[2 : n + 2]


def suffix_array(seq: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of `seq` in the order of their first `depth` words, and the sort keys by position.

    Multikey sorting: all suffixes by their first three words, then only those still tied by the next three, and so on.
    """
    keys = _keys(seq)
    order = np.argsort(keys, kind="stable")
    starts = np.ones(len(order), bool)
    starts[1:] = keys[order[1:]] != keys[order[:-1]]
    after = np.concatenate([keys, np.zeros(depth + _WIDE, np.int64)])
    for step in range(_WIDE, depth, _WIDE):
        tied = ~starts
        tied[:-1] |= ~starts[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(starts)[at]
        key = after[order[at] + step]
        by = np.lexsort((key, group))
        order[at], key, group = order[at][by], key[by], group[by]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        starts[at] |= new
    return order, after


def _bisect(lo: np.ndarray, hi: np.ndarray, at_most: np.ndarray, value_at) -> np.ndarray:
    """For each range [lo, hi): the first place whose value is not below `at_most`."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        below = np.zeros(len(lo), bool)
        below[open_] = value_at(mid[open_]) < at_most[open_]
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def find(order: np.ndarray, after: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `query` (equally long word sequences): the range of suffixes that begin with it."""
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
    for step in range(0, query.shape[1], _WIDE):
        part = query[:, step : step + _WIDE]
        shift = (_WIDE - part.shape[1]) * _BITS
        wanted = np.zeros(len(query), np.int64)
        for k in range(part.shape[1]):
            wanted = (wanted << _BITS) | part[:, k]

        def value(at: np.ndarray, step: int = step, shift: int = shift) -> np.ndarray:
            return after[order[at] + step] >> shift

        lo, hi = _bisect(lo, hi, wanted, value), _bisect(lo, hi, wanted + 1, value)
    return lo, hi


class Windows:
    """The distinct windows of one length, and for each where the items have it."""

    def __init__(self, rows: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        self.query, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(self.query)))])
        #: By window: the items that have it, and its places, in order, in one numbering that leaves a gap after each item.
        self.item, self.place = item[order], place[order]

    def of(self, window: int) -> slice:
        return slice(self.begin[window], self.begin[window + 1])

    def longest(self, run: np.ndarray) -> tuple[int, int, np.ndarray]:
        """Of windows that begin at words in a row: how many follow each other in an item at most, the first of them, the items.

        Only the places of one window and of the one before it are held at a time.
        """
        best, before, since = (0, 0, run[:0]), run[:0], run[:0]
        for k, window in enumerate(run):
            at = self.of(window)
            place = self.place[at]
            first = np.full(len(place), k)
            if len(before):
                j = np.minimum(np.searchsorted(before, place - 1), len(before) - 1)
                first = np.where(before[j] == place - 1, since[j], first)
            if k + 1 - (least := int(first.min())) > best[0]:
                best = (k + 1 - least, least, self.item[at][first == least])
            before, since = place, first
        return best


class Benchmark:
    """One block of test items (their ids, text): their words as ids, their windows (or, if shorter, all words) by length."""

    def __init__(self, items: list[tuple[list[str], str]], window: int) -> None:
        ids: dict[bytes, int] = {}
        self.names, rows, places = [], defaultdict(list), defaultdict(int)
        for names, text in items:
            found = np.array([ids.setdefault(w, len(ids) + 1) for w in words_of(text)], np.int64)
            if n := min(window, len(found)):
                part = np.lib.stride_tricks.sliding_window_view(found, n)
                rows[n].append((part, np.full(len(part), len(self.names)), places[n] + np.arange(len(part))))
                places[n] += len(part) + 1
            self.names.append(names)
        self.ids = ids
        self.windows = {n: Windows(*(np.concatenate(c) for c in zip(*x, strict=True))) for n, x in rows.items()}


#: What a text shares with a block: its words, (start, end) of the runs of hit words, the names of the items, and the longest
#: match (words, first word, name).
_Shared = tuple[int, list[tuple[int, int]], list[str], tuple[int, int, str] | None]


def _search(texts: list[str], bench: Benchmark, with_names: bool = True) -> Iterator[_Shared]:
    """What each text shares with the block. Each distinct window is searched once; a word of a text begins one of each length."""
    ids: defaultdict[bytes, int] = defaultdict(count(len(bench.ids) + 1).__next__)
    ids.update(bench.ids)
    words = [[ids[w] for w in words_of(t)] for t in texts]
    if len(ids) >= 1 << _BITS:
        # Too many different words for the key: the text's words that no test has are all one.
        top = len(bench.ids) + 1
        words = [[min(w, top) for w in x] for x in words]
    lengths = np.array([len(x) for x in words])
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    seq = np.zeros(begin[-1], np.int64)
    for k, x in enumerate(words):
        seq[begin[k] : begin[k] + len(x)] = x
    hits: list[tuple[int, np.ndarray, np.ndarray]] = []
    if bench.windows:
        order, after = suffix_array(seq, max(bench.windows))
        for n, windows in sorted(bench.windows.items(), reverse=True):
            lo, hi = find(order, after, windows.query)
            many = hi - lo
            which = np.repeat(np.arange(len(many)), many)
            at = order[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            by = np.argsort(at)
            if len(at):
                hits.append((n, at[by], which[by]))
    # Texts that hit the same windows have the same items, and equal runs the same longest match.
    known_names: dict[tuple, list[str]] = {}
    kept_names = 0
    known_runs: dict[tuple[int, bytes], tuple[int, int, str]] = {}
    for k, n_words in enumerate(lengths):
        spans, own, best = [], [], None
        for n, at, which in hits:
            a, b = np.searchsorted(at, begin[k : k + 2])
            if a == b:
                continue
            windows, full = bench.windows[n], best is None
            own.append((n, np.unique(which[a:b])))
            cuts = np.flatnonzero(np.diff(at[a:b]) != 1) + 1
            for run, part in zip(np.split(at[a:b] - begin[k], cuts), np.split(which[a:b], cuts), strict=True):
                start = int(run[0])
                spans.append((start, int(run[-1]) + n))
                if not full:
                    continue  # windows of this length are shorter than a match there is
                key = (n, part.tobytes())
                if key not in known_runs:
                    more, first, items = windows.longest(part)
                    known_runs[key] = (n + more - 1, first, min(x for i in set(items.tolist()) for x in bench.names[i]))
                size, first, name = known_runs[key]
                best = min(best or (0, 0, ""), (size, start + first, name), key=lambda m: (-m[0], m[1], m[2]))
        names: list[str] = []
        if own and with_names:
            key = tuple((n, x.tobytes()) for n, x in own)
            if key not in known_names:
                items = {i for n, x in own for w in x for i in bench.windows[n].item[bench.windows[n].of(w)].tolist()}
                names = sorted({x for i in items for x in bench.names[i]})
                if kept_names + len(names) > _BATCH_NAMES:
                    known_names, kept_names = {}, 0
                known_names[key] = names
                kept_names += len(names)
            names = known_names[key]
        yield int(n_words), spans, names, best


def _pass(docs: DataFrame, sent: Broadcast, with_names: bool, report=None, schema=None) -> DataFrame:
    """One block's matches added to each row; then `report`, if there is one, makes rows of `schema` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SHARD_BYTES):
                rows = batch.select(_FOUND).to_pydict()

                def part(lo: int, hi: int, batch=batch, rows=rows) -> pa.RecordBatch:
                    own = batch.slice(lo, hi - lo)
                    return pa.RecordBatch.from_arrays([pa.array(rows[f.name][lo:hi], f.type) if f.name in rows else own.column(f.name) for f in batch.schema], schema=batch.schema)

                lo = held = 0
                for k, (n, spans, names, best) in enumerate(_search(batch.column("text").to_pylist(), sent.value, with_names)):
                    rows["n_words"][k] = n
                    if spans:
                        rows["spans"][k] = rows["spans"][k] + [x for ab in spans for x in ab]
                        rows["items"][k] = sorted({*rows["items"][k], *names}) if rows["items"][k] else names
                        size, start, name = best
                        if (-size, start, name) < (-rows["longest"][k], rows["longest_start"][k] or 0, rows["longest_item"][k] or ""):
                            rows["longest"][k], rows["longest_item"][k], rows["longest_start"][k] = size, name, start
                    held += len(rows["items"][k])
                    if held >= _BATCH_NAMES:
                        yield part(lo, k + 1)
                        rows["items"][lo : k + 1] = [[]] * (k + 1 - lo)
                        lo, held = k + 1, 0
                if lo < batch.num_rows:
                    yield part(lo, batch.num_rows)

    return docs.mapInArrow((lambda batches: report(run(batches))) if report else run, schema or docs.schema)


def _covered(spans: list[int]) -> int:
    """Words inside any of the spans, given as start, end, start, end, ..."""
    total = reach = 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [_covered(x) for x in batch.column("spans").to_pylist()]
        items = batch.column("items").to_pylist()
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": batch.column("n_words"),
                "n_hit": pa.array(hit, pa.int64()),
                "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                "contaminated": pa.array([x > 0 for x in hit], pa.bool_()),
                "longest": batch.column("longest"),
                "longest_item": batch.column("longest_item"),
                "longest_start": batch.column("longest_start"),
            }
        )


def _blocks(bench: DataFrame, block_bytes: int) -> Iterator[list[tuple[list[str], str]]]:
    """(ids, text) of each distinct text, in blocks of about `block_bytes` of text. The table is grouped once."""
    items = bench.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text")
    items = written(items.groupBy("text").agg(F.collect_set("name").alias("names")), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield [(r["names"], r["text"]) for r in part.collect()]


def _merged(hits: list[DataFrame]) -> DataFrame:
    """What the blocks found in each text, by the text's digest. Copies of a text have equal rows, which are one in a set."""
    best = F.min(F.struct((-F.col("longest")).alias("less"), "longest_start", "longest_item")).alias("best")
    found = reduce(DataFrame.unionByName, hits).groupBy("of").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"), best)
    items = F.array_sort(F.array_distinct("items")).alias("items")
    return found.select("of", "spans", items, (-F.col("best.less")).alias("longest"), "best.longest_item", "best.longest_start")


def _searched(rows: DataFrame, bench: DataFrame, window: int, block_bytes: int, with_names: bool = True, report=None, schema=None) -> DataFrame:
    """`rows`, which have a text, with what all blocks of the benchmark find in it, or what the last pass reports of it.

    Each block but the last is a job of its own that writes, by digest of the text, what it found in the texts it hit; so
    driver and tasks hold one block at a time, whatever the benchmark's size.
    """
    none = {"n_words": "long", "spans": "array<long>", "items": "array<string>", "longest": "long", "longest_item": "string", "longest_start": "long"}
    start = {"n_words": F.lit(0), "longest": F.lit(0), "spans": F.array(), "items": F.array()}
    empty = {n: start.get(n, F.lit(None)).cast(kind) for n, kind in none.items()}
    digest = F.unhex(F.md5("text"))
    context = rows.sparkSession.sparkContext
    hits: list[DataFrame] = []
    last: list[tuple[list[str], str]] | None = None
    for block in _blocks(bench, block_bytes):
        if last is not None:
            sent = context.broadcast(Benchmark(last, window))
            found = _pass(rows.select("text").withColumns(empty), sent, with_names).where(F.size("spans") > 0)
            hits.append(written(found.select(digest.alias("of"), *[c for c in none if c != "n_words"]), "hits"))
            sent.destroy()
        last = block
    if hits:
        known = _merged(hits)
        rows = rows.withColumn("of", digest).join(known, "of", "left").drop("of").withColumns({n: F.coalesce(n, x) if n in known.columns else x for n, x in empty.items()})
    else:
        rows = rows.withColumns(empty)
    return _pass(rows, context.broadcast(Benchmark(last or [], window)), with_names, report, schema)


def clean(docs: DataFrame, bench: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` without those that share a window with an item, all columns as they were."""
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest"), F.col("text").isNull().alias("absent"), text_of().alias("text"))
    kept = _searched(held, bench, window, block_bytes, with_names=False).where(F.size("spans") == 0)
    text = F.when(~F.col("absent"), F.col("text")).alias("text")
    return kept.select(*[text if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def scan(docs: DataFrame, bench: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What each document of `docs` (doc_id, text) shares with the items of `bench` (item_id, text).

    A window is `window` consecutive words of an item, or the whole item if it is shorter but not empty. Per row of `docs`:
    its words, those inside any occurrence of a window, the items with occurring windows (their number and the SHA-256 of
    their ids), whether there are any, and the longest verbatim match (words, item, first word; of equals the earliest, then the smallest id).
    NULL or empty texts have no words. Items with a NULL id go by the name `null`. Items with equal ids count as one.
    Repeated rows are reported once each; other columns are ignored; with an empty benchmark nothing is contaminated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_item string, longest_start long"
    return _searched(rows, bench, window, block_bytes, report=_report, schema=schema)
