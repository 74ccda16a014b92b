"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length.

Folding lower-cases, replaces look-alike characters and digit substitutions, and leaves single blanks between words. The
lexicon's entries are words and word beginnings whose weight is learned from labelled documents: the log of how much more
often toxic documents have them. Exception phrases (given and learned) cancel the entries inside them. The score is a
logistic function of the summed weight and of that sum per word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import SLICE_BYTES, give_back, slices, text_of, written
from basketflow.llm.pii import ONE_TO_ONE

#: Labelled documents that the lexicon is learned from, at most: a sample by hash beyond that.
MOST_LABELLED = 30_000
#: An entry occurs in at least so many toxic documents, whatever their number, and so many times as often as in clean ones,
#: half a document added to each count.
LEAST_DOCS = 5
LEAST_RATIO = 20.0
#: Lengths of the word beginnings considered.
STEMS = (4, 5, 6, 7, 8)

THRESHOLD = 0.3

#: Harmless phrases around words that are often insults.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "trash collection", "clown fish", "clown nose", "circus clown", "pond scum", "soap scum", "sore loser rule", "idiot proof", "idiot light")

#: Digits and signs that stand for letters. l, i and 1 fall together.
_LEET = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
_SIGN = re.compile(r"(?<=\w)[@$](?=\w)")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = ONE_TO_ONE.get(code, chr(code)).lower()
        c = _LEET.get(c, c) if c.isalnum() else " "
        self[code] = c
        return c


_FOLD = _Fold()


def fold(text: str) -> str:
    """
    >>> fold("An 1D10T, L0ser!")
    ' an idiot ioser '
    """
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: "a" if m.group() == "@" else "s", text)
    return f" {' '.join(text.translate(_FOLD).split())} "


def _entries(folded: str) -> set[str]:
    """The words of a folded text, as ` word `, and their beginnings, as ` beginning`."""
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) > 2}
    for w in words:
        out.update(f" {w[:n]}" for n in STEMS if n < len(w))
    return out


def _near_copy_key(folded: str) -> int:
    """Equal for most near copies: the smallest hash of three words in a row."""
    w = folded.split()
    return min((xxhash.xxh3_64_intdigest(" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))), default=0) >> 1


@dataclass(frozen=True)
class Lexicon:
    """Weights by entry, exception phrases (folded, with blanks around), and the score's bias and two factors."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    logistic: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            found.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def _weight(folded: str, automaton: ahocorasick.Automaton) -> float:
    """Summed weight: of the entries at one word the heaviest counts, unless an exception phrase holds it."""
    if not len(automaton):
        return 0.0
    heaviest: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, weight) in automaton.iter(folded):
        if weight is None:
            spared.append((end - n + 1, end))
        else:
            heaviest[end - n + 1] = max(weight, heaviest.get(end - n + 1, 0.0))
    if spared:
        return sum(w for at, w in heaviest.items() if not any(a <= at < b for a, b in spared))
    return sum(heaviest.values())


def _measures(weight: float, n_words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(100.0 * weight / max(n_words, 1))


def _fit(rows: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the two measures by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(rows)), rows])
    at = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (toxic - p) - 1e-2 * at
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        at = at + step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in at)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _counted(rows: DataFrame, known: set[str] | None) -> DataFrame:
    """In how many toxic and clean documents each entry (or each known one) occurs; summed per batch before the shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "folded", SLICE_BYTES)):
            toxic, clean = Counter(), Counter()
            for folded, label in zip(batch.column("folded").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = _entries(folded)
                (toxic if label else clean).update(found if sent is None else found & sent.value)
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_pydict({"entry": pa.array(names, pa.string()), "toxic": pa.array([toxic[x] for x in names], pa.int64()), "clean": pa.array([clean[x] for x in names], pa.int64())})

    return rows.mapInArrow(run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _folded(rows: DataFrame) -> DataFrame:
    """(folded, toxic, key) of rows with text and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text", SLICE_BYTES)):
            folded = [fold(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"folded": pa.array(folded, pa.string()), "toxic": batch.column("toxic"), "key": pa.array([_near_copy_key(x) for x in folded], pa.int64())})

    return rows.select("text", "toxic").mapInArrow(run, "folded string, toxic int, key long")


def _pairs(folded: str, weights: dict[str, float]) -> Iterator[str]:
    """Two-word phrases with an entry in them."""
    words = folded.split()
    hit = [f" {w} " in weights or any(f" {w[:n]}" in weights for n in STEMS) for w in words]
    for k in range(len(words) - 1):
        if hit[k] or hit[k + 1]:
            yield f" {words[k]} {words[k + 1]} "


def _learned_exceptions(rows: DataFrame, weights: dict[str, float], least: int = 5) -> list[str]:
    """Phrases around an entry that only clean documents have, at least `least` of them."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "folded", SLICE_BYTES)):
            found = Counter()
            for folded, toxic in zip(batch.column("folded").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found.update((x, toxic) for x in set(_pairs(folded, sent.value)))
            yield pa.RecordBatch.from_pydict(
                {"phrase": pa.array([x for x, _ in found], pa.string()), "toxic": pa.array([n if t else 0 for (_, t), n in found.items()], pa.int64()), "clean": pa.array([0 if t else n for (_, t), n in found.items()], pa.int64())}
            )

    counted = rows.mapInArrow(run, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = counted.where((F.col("toxic") == 0) & (F.col("clean") >= least)).orderBy(F.desc("clean"), "phrase")
    return [r["phrase"] for r in kept.collect()]  # of at most `most_labelled` texts


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, exceptions: Iterable[str] = EXCEPTIONS) -> Lexicon:
    """The lexicon from `docs` (doc_id, text) and `labels` (doc_id, toxic), without the held-out documents.

    At most about `most_labelled` labelled documents, chosen by the hash of their id, are read; of near copies one counts.
    Without labels, or with one class only, the lexicon is empty and every score is that of a text without entries.
    """
    phrases = tuple(fold(x) for x in exceptions)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).dropDuplicates(["doc_id"])
    total = known.count()
    share = min(1.0, most_labelled / max(total, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = _folded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(known, "doc_id"))
    rows = written(rows.dropDuplicates(["key", "toxic"]).drop("key"), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, phrases, (math.log((toxic + 0.5) / (clean + 0.5)) - 1.0, 1.0, 1.0))
    least = LEAST_DOCS
    candidates = {r["entry"] for r in _counted(rows.where("toxic = 1"), None).where(F.col("toxic") >= least).select("entry").collect()}
    smoothed = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    held = _counted(rows, candidates).where((F.col("toxic") >= least) & (smoothed >= LEAST_RATIO)).select("entry", smoothed.alias("ratio"))
    weights = {r["entry"]: round(math.log(r["ratio"]), 6) for r in held.orderBy(F.desc("ratio"), "entry").collect()}
    lexicon = Lexicon(weights, (*phrases, *_learned_exceptions(rows, weights)), (0.0, 0.0, 0.0))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        for batch in (s for b in batches for s in slices(b, "folded", SLICE_BYTES)):
            found = [_measures(_weight(t, automaton), len(t.split())) for t in batch.column("folded").to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.float64()), "b": pa.array([x for _, x in found], pa.float64()), "toxic": batch.column("toxic")})

    got = rows.mapInArrow(run, "a double, b double, toxic int").collect()  # at most `most_labelled` rows
    data = np.array([[r["a"], r["b"], r["toxic"]] for r in got])
    return Lexicon(lexicon.weights, lexicon.exceptions, _fit(data[:, :2], data[:, 2]))


def scan(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """Score and prediction for each row of `docs` (doc_id, text; other columns stay as they are).

    Adds `held_out`, `score` (0 to 1), `predicted` (1 from `threshold` on) and `toxic_weight`, replacing columns of these
    names. NULL and empty texts get the score of a text without entries. Repeated rows are scored once each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    added = ("held_out", "score", "predicted", "toxic_weight")
    rows = docs.drop(*added)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        bias, a, b = sent.value.logistic
        for batch in (s for b in batches for s in slices(b, "text", SLICE_BYTES)):
            scores, weights = [], []
            for text in batch.column("text").to_pylist():
                folded = fold(text or "")
                weight = _weight(folded, automaton)
                x, y = _measures(weight, len(folded.split()) if weight else 1)
                weights.append(weight)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * x + b * y)))))
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(weights, pa.float64())], [*names, "score", "toxic_weight"])
        give_back()

    schema = rows.withColumns({"score": F.lit(0.0), "toxic_weight": F.lit(0.0)}).schema
    scored = rows.mapInArrow(run, schema)
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
