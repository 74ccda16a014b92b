"""Conversations from messages that quote each other.

Each message is parsed into its own text and quoted passages by nesting level. Quoted passages, their lines, and own paragraphs,
lines and sentences are reduced to hashes of their normalised words; the first message that wrote a passage, or else a line, is its
original. A message replies to the original of what it quotes at the first level, else to the turn before it. Threads and
depths follow from these links by pointer doubling.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketflow.llm.common import written

_MARK = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
_SAID = re.compile(r"(?i)^\s*(on .{1,200} wrote|le .{1,200} a écrit|am .{1,200} schrieb.{0,100}|el .{1,200} escribió)\s*:\s*$")
_WORDS = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+")


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """A message without its quotes, and (level, lines) of each quoted passage. The line that announces a quote goes too.

    A passage is a run of quoted lines of one level; an empty quoted line ends it.

    >>> parse("On Monday A wrote:\\n> > deep\\n> near\\n> by\\nYes.")
    ('Yes.', [(2, ['deep']), (1, ['near', 'by'])])
    """
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    in_quote = any_mark = joins = False
    for line in text.split("\n"):
        mark = _MARK.match(line)
        if mark:
            while not in_quote and own and (not own[-1].strip() or _SAID.match(own[-1])):
                if _SAID.match(own.pop()):
                    break
            level, rest = mark.group(1).count(">"), line[mark.end() :].rstrip()
            if rest:
                if not (joins and quoted[-1][0] == level):
                    quoted.append((level, []))
                quoted[-1][1].append(rest)
            joins, any_mark = bool(rest), True
        else:
            own.append(line)
            joins = False
        in_quote = bool(mark)
    return "\n".join(own).strip("\n") if any_mark else text, quoted


def passage_hash(text: str) -> int | None:
    """Hash of the words in lower case, however they are broken into lines; None without words."""
    words = _WORDS.findall(text.lower())
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63) if words else None


def _own_hashes(text: str) -> list[int]:
    """Hashes of a message's lines, of its paragraphs and of their sentences."""
    lines = text.split("\n")
    paragraphs = [" ".join(part) for filled, part in groupby(lines, lambda x: bool(x.strip())) if filled]
    sentences = (x for p in paragraphs for x in _SENTENCE_END.split(p))
    return sorted({h for x in chain(lines, paragraphs, sentences) if (h := passage_hash(x)) is not None})


def _quoted_hashes(passages: list[tuple[int, list[str]]]) -> list[dict]:
    """Two entries for each quoted line with words: its own hash and, in a passage of several, that of the passage."""
    out, number = [], 0
    for level, lines in passages:
        held = [(x, h) for x in lines if (h := passage_hash(x)) is not None]
        whole = passage_hash(" ".join(lines))
        for x, h in held:
            out += [{"level": level, "line": number, "own": h, "hash": k, "size": len(x)} for k in ((h, whole) if len(held) > 1 else (h,))]
            number += 1
    return out


_PARSED = "conv_id long, turn long, role string, text string, own array<long>, quoted array<struct<level:int,line:int,own:long,hash:long,size:int>>"
_QUOTED = pa.list_(pa.struct([("level", pa.int32()), ("line", pa.int32()), ("own", pa.int64()), ("hash", pa.int64()), ("size", pa.int32())]))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, own, quoted = [], [], []
        for text in batch.column("text").to_pylist():
            rest, passages = parse(text)
            texts.append(rest)
            own.append(_own_hashes(rest))
            quoted.append(_quoted_hashes(passages))
        yield pa.RecordBatch.from_pydict(
            {
                "conv_id": batch.column("conv_id"),
                "turn": batch.column("turn"),
                "role": batch.column("role"),
                "text": pa.array(texts, pa.string()),
                "own": pa.array(own, pa.list_(pa.int64())),
                "quoted": pa.array(quoted, _QUOTED),
            }
        )


def _originals(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, size, of_conv, of_turn) of each quoted line whose original is known.

    A line's original is that of the passage it stands in, or of the line itself if the passage has none: the first turn of
    the same conversation that wrote it, else the first message of another conversation. For that the first messages of the two
    lowest conversations are kept, one of which is another. All are cut down before the shuffle, so a line that very many
    messages have gives few candidates and no pairs.
    """
    lines = messages.select(F.explode("own").alias("hash"), F.struct("conv_id", "turn").alias("at"))
    asked = messages.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.line", "q.own", "q.hash", "q.size")
    lines = lines.join(asked.select("hash").distinct(), "hash", "left_semi")
    here = lines.groupBy(F.col("at.conv_id").alias("conv_id"), "hash").agg(F.min("at").alias("here"))
    nth = F.row_number().over(W.partitionBy("hash").orderBy("here"))
    two = here.withColumn("nth", nth).where("nth <= 2")
    first = two.groupBy("hash").agg(F.min("here").alias("anywhere"), F.max("here").alias("elsewhere"))
    found = asked.join(here, ["conv_id", "hash"], "left").join(first, "hash", "left")
    # A message never quotes itself or what comes after it in its conversation.
    before = F.col("here.turn") < F.col("turn")
    origin = F.when(before, F.col("here"))
    for name in ("anywhere", "elsewhere"):
        origin = origin.when(F.col(f"{name}.conv_id") != F.col("conv_id"), F.col(name))
    of_passage = F.col("hash") != F.col("own")
    best = (
        found.withColumn("of", origin)
        .where(F.col("of").isNotNull())
        .groupBy("conv_id", "turn", "line", "own")
        .agg(F.min("level").alias("level"), F.max("size").alias("size"), F.max(F.struct(of_passage.alias("whole"), "of")).alias("best"))
    )
    return best.select("conv_id", "turn", "level", "size", F.col("best.of.conv_id").alias("of_conv"), F.col("best.of.turn").alias("of_turn"))


def _replies(messages: DataFrame, originals: DataFrame) -> DataFrame:
    """(conv_id, turn, to_conv, to_turn, n_linked) once per message: what it replies to, NULL for the first of a thread."""
    nodes = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn").distinct()
    quoted = originals.groupBy("conv_id", "turn", "of_conv", "of_turn").agg(F.min("level").alias("level"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    # The least deeply quoted original; of several the one with most text, then the latest.
    best = quoted.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "size", "of_turn", "of_conv")).alias("best"), F.sum("n").alias("n_linked"))
    before = nodes.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    return (
        nodes.join(best, ["conv_id", "turn"], "left")
        .join(before, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("best").isNotNull(), F.col("best.of_conv")).when(F.col("previous").isNotNull(), F.col("conv_id")).alias("to_conv"),
            F.when(F.col("best").isNotNull(), F.col("best.of_turn")).otherwise(F.col("previous")).alias("to_turn"),
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        )
    )


def _threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_conv, thread_turn, depth): the first message above each, and how far up it is.

    Every round doubles the distance that is covered, so a chain of n replies takes about log2(n) joins; a message that has
    reached its first one is in no further round. Quotes across conversations could form a ring; each message of one then
    stops where the distance would exceed all messages.
    """
    answers = F.col("to_turn").isNotNull()
    at = written(
        replies.select("conv_id", "turn", F.coalesce("to_conv", "conv_id").alias("up_conv"), F.coalesce("to_turn", "turn").alias("up_turn"), answers.cast("long").alias("depth"), answers.alias("open")),
        "threads",
    )
    most = at.count()
    while at.where("open").limit(1).count():
        upper = at.where("depth > 0").select(F.col("conv_id").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("up_conv").alias("c"), F.col("up_turn").alias("t"), F.col("depth").alias("more"))
        moved = at.where("open").drop("open").join(upper, ["up_conv", "up_turn"], "left")
        step = F.coalesce("more", F.lit(0)) > 0
        step = step & (F.col("depth") + F.col("more") <= most)
        moved = moved.select(
            "conv_id",
            "turn",
            F.when(step, F.col("c")).otherwise(F.col("up_conv")).alias("up_conv"),
            F.when(step, F.col("t")).otherwise(F.col("up_turn")).alias("up_turn"),
            F.when(step, F.col("depth") + F.col("more")).otherwise(F.col("depth")).alias("depth"),
            F.coalesce(step, F.lit(False)).alias("open"),
        )
        at = written(moved.unionByName(at.where("NOT open")), "threads")
    return at.select("conv_id", "turn", F.col("up_conv").alias("thread_conv"), F.col("up_turn").alias("thread_turn"), "depth")


def link(messages: DataFrame) -> DataFrame:
    """Each row of `messages` (conv_id, turn, role, text; other columns are ignored) without quotes and with its place.

    `reply_conv`, `reply_turn`: the message it answers. `thread_conv`, `thread_turn`: the first message of its thread, and
    `depth`, how many replies lie between; a thread sorted by depth, conversation and turn has every message after what it
    answers. `n_quotes`, `n_linked`: quoted lines with words, and those whose original is known; `levels`: deepest nesting.
    NULL texts are empty. Rows without conv_id or turn are kept, answer nothing and have no thread. Rows that repeat a
    conv_id and turn are one message for links and stay separate rows.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parsed = written(rows.mapInArrow(_parsed, _PARSED), "messages")
    replies = written(_replies(parsed, _originals(parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()))), "replies")
    return (
        parsed.join(replies, ["conv_id", "turn"], "left")
        .join(_threads(replies), ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            "text",
            F.col("to_conv").alias("reply_conv"),
            F.col("to_turn").alias("reply_turn"),
            "thread_conv",
            "thread_turn",
            "depth",
            F.size(F.filter("quoted", lambda q: q["hash"] == q["own"])).cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.coalesce(F.array_max(F.col("quoted.level")), F.lit(0)).cast("long").alias("levels"),
        )
    )
