"""Personal data in text, also behind disguises, with spans in the source's code points.

The base detectors run on the text as it is. Then a transducer rewrites disguises (look-alike characters, spelled digits,
written-out "at" and "dot", invisible characters) and keeps for each output character the source span it came from. The same
detectors run on its output; what they find there goes back through that map and is added to the base spans.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import SLICE_BYTES, give_back, slices, text_of

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only begin where a run of digits begins, as what follows the run is the same from any of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


def _emails(text: str) -> Iterator[Span]:
    """Around each @, to the left as far as the last match allows: linear where a plain search would be quadratic."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    """
    >>> luhn("4111111111111111"), luhn("4111111111111112")
    (True, False)
    """
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> dict[str, list[Span]]:
    """Base spans by kind: leftmost, non-overlapping, without matches that fail their check."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    found["email"] = list(_emails(text))
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


# ---- the transducer -------------------------------------------------------------------------------------------------

#: Cyrillic and Greek letters, and the ASCII letters that they look like.
_CYRILLIC = "а е о р с у х і ј ѕ ԁ һ ԛ ԝ А В Е К М Н О Р С Т Х І Ј Ѕ"
_CYRILLIC_AS = "a e o p c y x i j s d h q w A B E K M H O P C T X I J S"
_GREEK = "ο ν ι α ρ τ υ Α Β Ε Ζ Η Ι Κ Μ Ν Ο Ρ Τ Υ Χ"
_GREEK_AS = "o v i a p t u A B E Z H I K M N O P T Y X"
#: First code points of decimal digit runs beyond ASCII (Arabic, Persian, Devanagari, full width).
_DIGIT_ZEROS = (0x660, 0x6F0, 0x966, 0xFF10)
#: Characters that take no room.
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digits as words in English, German, French and Spanish.
SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}


def _one_to_one() -> dict[int, str]:
    out = {ord(a): b for x, y in ((_CYRILLIC, _CYRILLIC_AS), (_GREEK, _GREEK_AS)) for a, b in zip(x.split(), y.split(), strict=True)}
    out |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    out |= {zero + d: str(d) for zero in _DIGIT_ZEROS for d in range(10)}
    return out | {0xFE6B: "@", 0x3002: ".", 0xFF61: ".", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0xA0: " ", 0x202F: " "}


ONE_TO_ONE = _one_to_one()
_FOLDED = re.compile("[" + "".join(map(re.escape, map(chr, ONE_TO_ONE))) + _INVISIBLE + "]")

_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))
_AT, _DOT = r"(?:at|arroba|@)", r"(?:dot|point|punkt|punto|\.)"
_IN_BRACKETS = r"\s{0,3}[(\[{<]\s{0,3}%s\s{0,3}[)\]}>]\s{0,3}"
_BARE = r"(?<=[A-Za-z0-9_%%+-])\s{1,3}%s\s{1,3}(?=[A-Za-z0-9])"
_BRACKETED = re.compile("(?i)" + _IN_BRACKETS % f"({_AT[3:-1]}|{_DOT[3:-1]})")
# Without brackets only "dot": "at the point of sale" is prose.
_BARE_DOT = re.compile("(?i)" + _BARE % "dot")
_BARE_AT = re.compile("(?i)" + _BARE % "(?:at|arroba)")
_LABEL = "[A-Za-z0-9-]{1,63}"
#: A host whose dots may be disguised, as far as it reaches.
_HOST = re.compile(rf"(?i)(?!www\.){_LABEL}(?:(?:\.|\s{{1,3}}dot\s{{1,3}}|{_IN_BRACKETS % _DOT}){_LABEL}){{1,8}}(?<=[A-Za-z]{{2}})(?![A-Za-z0-9-])")
_LEFT_WORD = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
#: Words that stand before "at" and the name of a site in ordinary prose.
_BEFORE_AT = frozenset(
    "a about and are article available be been blog bought buy check code directly documentation done down else even ever found free here hosted in is it listed located "
    "look looked looking looks me more now of off on online only or order out over page posted published read register see seen shop site sold started stay still stop "
    "store that them there these this tickets today tools up us visit was website were work worked working works you".split()
)

#: Three or more digit words in a row, or fewer beside so many digits that it can be an identifier: else it is ordinary prose.
_SPOKEN_LEAST, _SPOKEN_DIGITS = 3, 9
_SPOKEN_GAP = rf"(?:{_IN_BRACKETS % _DOT}|[\s.,-]{{1,3}})"
_SPOKEN_DOT = "dot|point|punkt|punto"
_SPOKEN = re.compile(rf"(?i)(?<!\w)(?:(?:plus|{_NUMBER}|{_SPOKEN_DOT}|[0-9]+){_SPOKEN_GAP}){{2,}}(?:{_NUMBER}|[0-9]+)(?!\w)")
_SPOKEN_PART = re.compile(rf"(?i)(?P<word>plus|{_NUMBER})(?!\w)|(?P<digits>[0-9]+)|(?P<dot>(?:{_SPOKEN_DOT})(?!\w)|{_IN_BRACKETS % _DOT})|(?P<gap>[\s.,-]{{1,3}})")

Piece = tuple[int, int, str]


def _spoken(run: re.Match) -> Iterator[Piece]:
    """The digits of a run of digit words and digits, without what lies between; as an address if there are three dots."""
    parts = list(_SPOKEN_PART.finditer(run.group()))
    words = sum(1 for p in parts if p["word"] and p["word"].lower() != "plus")
    spelled = sum(1 for p in parts if p["word"])
    digits = words + sum(len(p["digits"]) for p in parts if p["digits"])
    dots = sum(1 for p in parts if p["dot"] or (p["gap"] and "." in p["gap"]))
    if not (spelled >= _SPOKEN_LEAST or (spelled and (digits >= _SPOKEN_DIGITS or dots == 3))):
        return
    for p in parts:
        a, b = run.start() + p.start(), run.start() + p.end()
        if word := (p["word"] or "").lower():
            yield a, b, "+" if word == "plus" else str(SPELLED[word])
        elif p["dot"] or (p["gap"] and "." in p["gap"] and dots == 3):
            yield a, b, "."
        elif p["gap"]:
            yield a, b, ""


def _ats(plain: str, others: set[int]) -> Iterator[Piece]:
    """Each bare "at" before a host. What is before a host's own "at" or @ is no host, so the last one goes first."""
    taken = set(others)
    for m in reversed(list(_BARE_AT.finditer(plain))):
        host = _HOST.match(plain, m.end())
        if not host or host.end() in taken or plain.startswith("@", host.end()):
            continue
        left = _LEFT_WORD.search(plain, max(0, m.start() - 64), m.start())
        if left and left.group().lower() in _BEFORE_AT and not re.search(r"[\s(\[{<]", host.group()):
            continue
        taken.add(m.start())
        yield m.start(), m.end(), "@"


def _rewrites(text: str) -> list[Piece]:
    """(start, end, replacement) of each disguise, in order and without overlaps.

    Characters are folded and invisible ones left out first; "at", "dot" and digit words are looked for in the result, each
    by itself. What the detectors make of them together decides.
    """
    folds: list[Piece] = []
    if not text.isascii():
        folds = [(m.start(), m.end(), ONE_TO_ONE.get(ord(m.group()), "")) for m in _FOLDED.finditer(text)]
    plain, source = text, None
    if folds:
        plain = text.translate(ONE_TO_ONE)
        if any(not new for _, _, new in folds):
            source = [k for k, c in enumerate(plain) if c not in _INVISIBLE]
            plain = "".join([plain[k] for k in source])
    low = plain.lower()
    out: list[Piece] = []
    if any(c in low for c in "([{<"):
        out += [(m.start(), m.end(), "@" if m.group(1).lower() in ("at", "arroba", "@") else ".") for m in _BRACKETED.finditer(plain)]
    if "dot" in low:
        out += [(m.start(), m.end(), ".") for m in _BARE_DOT.finditer(plain)]
    out += _ats(plain, {a for a, _, new in out if new == "@"})
    for m in _SPOKEN.finditer(plain):
        out += _spoken(m)
    if source is not None:
        out = [(source[a], source[b - 1] + 1, new) for a, b, new in out]
    kept: list[Piece] = []
    for piece in sorted(out, key=lambda x: (x[0], -x[1])):
        if not kept or piece[0] >= kept[-1][1]:
            kept.append(piece)
    # A folded character inside one of these is part of it.
    ends = [b for _, b, _ in kept]
    free = [f for f in folds if (k := bisect_right(ends, f[0])) == len(kept) or f[1] <= kept[k][0]]
    return sorted([*kept, *free])


def transduce(text: str, rewrites: list[Piece]) -> tuple[str, array, array]:
    """The rewritten text, and for each of its characters the start and end of its source."""
    out, start, end, at = [], array("q"), array("q"), 0
    for a, b, new in rewrites:
        out.append(text[at:a])
        start.extend(range(at, a))
        end.extend(range(at + 1, a + 1))
        out.append(new)
        start.extend([a] * len(new))
        end.extend([b] * len(new))
        at = b
    out.append(text[at:])
    start.extend(range(at, len(text)))
    end.extend(range(at + 1, len(text) + 1))
    return "".join(out), start, end


def _overlapping(spans: list[Span], ends: list[int], span: Span) -> list[Span]:
    """Those of `spans`, in order, without overlaps and ending at `ends`, that share a character with `span`."""
    lo = hi = bisect_right(ends, span[0])
    while hi < len(spans) and spans[hi][0] < span[1]:
        hi += 1
    return spans[lo:hi]


#: Source characters on either side of a disguise that an identifier around it can reach.
_REACH = 400


def disguised(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows. Wider ones than a base span they overlap are added, others are not."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    rewrites = _rewrites(text)
    base_ends = {k: [s[1] for s in v] for k, v in base.items()}
    # Disguises far from each other are treated apart, so the map stays as small as what it explains.
    lo = 0
    while lo < len(rewrites):
        hi = lo + 1
        while hi < len(rewrites) and rewrites[hi][0] - rewrites[hi - 1][1] <= _REACH:
            hi += 1
        a = max(0, rewrites[lo][0] - _REACH)
        b = min(len(text), rewrites[hi - 1][1] + _REACH)
        places = [(x, y) for x, y, _ in rewrites[lo:hi]]
        place_ends = [y for _, y in places]
        plain, start, end = transduce(text[a:b], [(x - a, y - a, new) for x, y, new in rewrites[lo:hi]])
        for kind, spans in detect(plain).items():
            for x, y in spans:
                span = (a + start[x], a + end[y - 1])
                if not _overlapping(places, place_ends, span):
                    continue  # nothing disguised in it: the base detectors decide
                if all(span[0] <= s[0] and s[1] <= span[1] and span != s for s in _overlapping(base[kind], base_ends[kind], span)):
                    found[kind].append(span)
        lo = hi
    return {k: sorted(set(v)) for k, v in found.items()}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans."""
    base = detect(text)
    more = disguised(text, base)
    return base, {k: sorted({*base[k], *more[k]}) for k in KINDS}


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """`text` with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, x in spans.items() for a, b in x):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Personal data in each row of `docs` (doc_id, text; other columns are ignored).

    Per row: the number of base spans by kind, the SHA-256 of their list, all spans as `kind:start:end` by kind and start
    (code points, end exclusive), how many of those the disguise pass added; with `with_text` also `redacted`, the text
    with names of kinds in place of the spans. NULL and empty texts have no spans. Repeated rows are reported once each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text", SLICE_BYTES)):
            rows = [find(t) for t in batch.column("text").to_pylist()]
            out = {"doc_id": batch.column("doc_id")}
            out |= {f"n_{k}": pa.array([len(b[k]) for b, _ in rows], pa.int64()) for k in KINDS}
            out["base_sha256"] = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string())
            out["spans"] = pa.array([joined(s) for _, s in rows], pa.string())
            out["n_added"] = pa.array([sum(len(s[k]) - len(b[k]) for k in KINDS) for b, s in rows], pa.int64())
            if with_text:
                out["redacted"] = pa.array([redacted(t, s) for t, (_, s) in zip(batch.column("text").to_pylist(), rows, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)
        give_back()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(run, SCHEMA + (", redacted string" if with_text else ""))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with names of kinds in place of personal data, `n_chars` (if there) counted anew, other columns as they are.

    A NULL text stays NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text", SLICE_BYTES)):
            texts = [None if t is None else redacted(t, find(t)[1]) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, pa.string()))
        give_back()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
