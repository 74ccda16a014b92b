"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

Each task packs its own rows in groups of bounded size, so nothing is shuffled. Within a group the number of sequences is
fixed by the tokens to place. Whole documents go, longest first, to the sequence with the lowest attention cost so far
among those with room; what no longer fits whole is cut to fill the gaps that are left. A document above the capacity first
gives full sequences. At most one sequence's worth of padding is left per group.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import give_back, text_of

#: Fixed value: the split rule that the published byte-level vocabulary is defined with.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Tokens that a group collects before it is packed.
GROUP_TOKENS = 1 << 21

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Chunks(dict):
    """Ids, as bytes, of a blank and the word after it; what has been met is kept, up to a bound."""

    def __init__(self, encode, limit: int = 250_000) -> None:
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= self.limit:
            self.clear()
        # The split rule begins a part at every blank between two other characters, so what lies between such blanks can
        # be encoded by itself. Elsewhere (beside other white space) it can't, which None tells.
        alone = word and not word[0].isspace() and not word[-1].isspace()
        ids = np.array(self.encode(" " + word), "<u4").tobytes() if alone else None
        if len(word) < 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids by the vocabulary of the `tokenizers` file at `path` alone, on a faster engine.

    The vocabulary's ids are merge ranks, so the file can be loaded as a rank table. Their equality is a test.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    symbols, special = _byte_symbols(), {x["content"] for x in file.get("added_tokens", [])}
    ranks = {bytes(symbols[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in special}
    plain = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    chunks = _Chunks(plain)

    def encode(text: str) -> np.ndarray:
        first, *rest = text.split(" ")
        found = [chunks[w] for w in rest]
        if rest and (None in found or not first or first[-1].isspace()):
            return np.array(plain(text), "<u4")
        return np.frombuffer(np.array(plain(first), "<u4").tobytes() + b"".join(found), "<u4")

    return encode


@lru_cache(maxsize=2)
def file_encoder(path: str):
    """text -> ids as the `tokenizers` file at `path` gives them: its added tokens are one id each wherever a text has them.

    Only added tokens that are matched as they are written can be loaded; other kinds are an error.
    """
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if other := [x["content"] for x in added if any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]:
        raise ValueError(f"added tokens that are not matched as written: {other}")
    plain = encoder(path)
    ids = {x["content"]: x["id"] for x in added if x["content"]}
    if not ids:
        return plain
    # The first in the text, of several at one place the longest.
    token = re.compile("|".join(map(re.escape, sorted(ids, key=lambda x: (-len(x), x)))))

    def encode(text: str) -> np.ndarray:
        parts, at = [], 0
        for m in token.finditer(text):
            parts += [plain(text[at : m.start()]), np.array([ids[m.group()]], "<u4")]
            at = m.end()
        return np.concatenate([*parts, plain(text[at:])]).astype("<u4", copy=False) if parts else plain(text)

    return encode


def balanced(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of the given lengths.

    >>> balanced([3, 5, 4], 4, 1.0, 0.0)
    [(1, 0, 4, 0, 0), (2, 0, 4, 1, 0), (0, 0, 3, 2, 0), (1, 4, 1, 2, 3)]
    """
    pieces, rest, used = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((doc, start, capacity, used, 0))
            used += 1
        if n % capacity:
            rest.append((n % capacity, doc))
    rest.sort(key=lambda x: (-x[0], x[1]))
    sequences = -(-sum(n for n, _ in rest) // capacity)
    room, cost = np.full(sequences, capacity, np.int64), np.zeros(sequences)

    def place(doc: int, start: int, n: int, k: int) -> None:
        pieces.append((doc, start, n, used + k, int(capacity - room[k])))
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n

    uncut = []
    for n, doc in rest:
        fits = np.flatnonzero(room >= n)
        if len(fits):
            place(doc, lengths[doc] - n, n, int(fits[cost[fits].argmin()]))
        else:
            uncut.append((n, doc))
    for n, doc in uncut:
        start = lengths[doc] - n
        while n:
            k = int(room.argmax())
            part = min(n, int(room[k]))
            place(doc, start, part, k)
            start, n = start + part, n - part
    return pieces


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    group_tokens: int = GROUP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """Packs `docs` (doc_id, text; other columns are ignored) into sequences of at most `capacity` tokens.

    One row per piece: its document, place in the document, CRC-32 of its ids as little-endian 32-bit numbers, the document's
    tokens (with the end id), its sequence and the place there; with `with_ids` the ids too. A NULL or empty text is the
    end id alone. A text that holds an added token of the file as written has that token's id there. Repeated rows are packed once each. An empty table gives no rows. Costs are `linear * n + quadratic * n * n`
    per piece. Sequence numbers are unique; they depend on how Spark splits the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = file_encoder(tokenizer_path)
        next_id = TaskContext.get().partitionId() << 33
        ids: list[np.ndarray] = []
        docs_of: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            rows = balanced([len(x) for x in ids], capacity, linear, quadratic)
            parts = [ids[d][s : s + n] for d, s, n, _, _ in rows]
            out = {
                "doc_id": pa.array([docs_of[r[0]] for r in rows], pa.int64()),
                "start": pa.array([r[1] for r in rows], pa.int64()),
                "length": pa.array([r[2] for r in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                "doc_tokens": pa.array([len(ids[r[0]]) for r in rows], pa.int64()),
                "sequence_id": pa.array([next_id + r[3] for r in rows], pa.int64()),
                "offset": pa.array([r[4] for r in rows], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
            next_id += max(r[3] for r in rows) + 1
            ids.clear()
            docs_of.clear()
            return pa.RecordBatch.from_pydict(out)

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4", copy=False))
                docs_of.append(doc)
                held += len(ids[-1])
                if held >= group_tokens:
                    yield flush()
                    held = 0
        if ids:
            yield flush()
        give_back()

    source = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return source.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def sequences(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Totals per sequence of `pack`: tokens, pieces and padding (none at a power of two)."""
    tokens = F.col("tokens")
    exact = (tokens.bitwiseAND(tokens - 1)) == 0
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
        .withColumn("padding", F.when(exact, F.lit(0)).otherwise(F.lit(capacity) - tokens))
    )
