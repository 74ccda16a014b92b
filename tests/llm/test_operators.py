"""Each corpus operator against a brute-force version or an exact round trip, on awkward rows and on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketflow.llm import decontaminate, license_scan, ngram_join, packing, pii, quality_rules, quotation, suffix_dedup, toxicity, warc
from basketflow.llm.common import table
from basketflow.llm.components import connected_components
from basketflow.llm.registered import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, node string, label string"
PROSE = " ".join(f"word{k % 37} and{k % 11}" for k in range(400))
#: NULL in any column, empty and very long texts, ties, repeated rows, columns that clash with inner names.
AWKWARD = [
    (1, PROSE, "n", None),
    (2, PROSE, None, "x"),
    (3, PROSE[:900] + " a changed end of it all that differs " * 3, "n", "x"),
    (4, None, "n", "x"),
    (5, "", "n", "x"),
    (6, " \n\t ", "n", "x"),
    (None, "no id but a text of seven words", "n", "x"),
    (7, "short one", "n", "x"),
    (8, "SHORT\tone", "n", "x"),
    (9, "é ü 漢字 😀 " * 60, "n", "x"),
    (10, "a" * 150_000, "n", "x"),
    (11, "tail " + "a" * 250 + " tail", "n", "x"),
    (12, "line of it\nline of it\n\nother line\n" * 20, "n", "x"),
    (12, "line of it\nline of it\n\nother line\n" * 20, "n", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows):
    return [(r[0], r[1] or "") for r in rows]


def real(spark):
    return [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


# ---- 1


def brute_removed(rows, length=200):
    """A polynomial would do; a set of all windows is plainer."""
    seen, twice = set(), set()
    data = [t.encode() for _, t in rows]
    for b in data:
        for k in range(len(b) - length + 1):
            h = hash(b[k : k + length])
            (twice if h in seen else seen).add(h)
    out = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - length + 1):
            if hash(b[k : k + length]) in twice:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def test_suffix_dedup_awkward(spark, docs, empty):
    assert Counter(map(tuple, suffix_dedup.scan(docs).collect())) == brute_removed(texts_of(AWKWARD))
    assert suffix_dedup.scan(empty).collect() == []
    assert Counter(map(tuple, suffix_dedup.scan(docs, most_together=1).collect())) == brute_removed(texts_of(AWKWARD))


def test_suffix_dedup_of_a_crowded_lead(spark):
    """A passage below the length in very many contexts, some of which agree just far enough, on either way."""
    passage = "the passage that all of them hold, word for word and blank for blank, " * 2
    rows = [(k, f"{'left' * (k % 9)} {k // 40} {'before ' * 9}{passage}{'after ' * 12}{k % 40}{'right' * (k % 7)} {k}") for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert 0 < sum(r[2] for r in brute_removed(rows)) < sum(r[1] for r in brute_removed(rows))
    for limit in (50, suffix_dedup.MOST_TOGETHER):
        assert Counter(map(tuple, suffix_dedup.scan(frame, most_together=limit).collect())) == brute_removed(rows)


def test_suffix_dedup_table(spark):
    found = suffix_dedup.scan(table(spark, SF, "documents"), with_text=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_removed(real(spark))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=190, max_size=420), min_size=2, max_size=5))
def test_repeated_strings_of_spans(texts):
    """Every window has one anchor, equal windows have it at the same place, and the sorted spans show which repeat."""
    data = [t.encode() for t in texts if len(t) >= 200]
    bodies, anchors, starts = [], [], []
    for k, b in enumerate(data):
        raw = np.frombuffer(b, np.uint8)
        first, last, anchor = suffix_dedup.runs(raw, np.array([0, len(raw)]))
        assert sorted(x for a, z in zip(first, last) for x in range(a, z + 1)) == list(range(len(b) - 199))
        for a, z, at in zip(first, last, anchor):
            bodies.append(b[a : z + 200])
            anchors.append(at - a)
            starts.append((k, a))
    if not bodies:
        return
    count = Counter(b[x : x + 200] for b in data for x in range(len(b) - 199))
    groups = defaultdict(list)
    for j, (b, a) in enumerate(zip(bodies, anchors)):
        groups[b[a : a + suffix_dedup.LEAD]].append(j)
    for members in groups.values():
        spans = sorted({(bodies[j], int(anchors[j])) for j in members})
        flags = dict(zip(spans, suffix_dedup.repeated([s for s, _ in spans], np.array([a for _, a in spans]))))
        copies = Counter((bodies[j], int(anchors[j])) for j in members)
        for span, hit in flags.items():
            for o, flag in enumerate(hit):
                assert (flag or copies[span] > 1) == (count[span[0][o : o + 200]] > 1)


# ---- 2


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return Counter((i, len(s), min((x for x in least[find(k)] if x is not None), default=None) if s else i) for k, (i, s) in enumerate(sets))


def test_ngram_join(spark, docs, empty):
    assert Counter(map(tuple, ngram_join.scan(docs).collect())) == brute_components(texts_of(AWKWARD))
    assert Counter(map(tuple, ngram_join.scan(table(spark, SF, "documents")).collect())) == brute_components(real(spark))
    assert ngram_join.scan(empty).collect() == []


def test_ngram_join_of_chains_of_changes(spark):
    """Copies that drift from each other: links lead along the chain, also where its ends are not similar."""
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        words = list(base)
        for j in range(0, 3 * (k % 14)):
            words[(7 * j + k) % 120] = f"x{k % 3}{j}"
        rows.append((k, " ".join(words) + f" own{k} part{k}"))
    got = ngram_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(k + 100, 100) for k in range(1, 30)] + [(7, 7), (5, 4), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k + 100: 100 for k in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- 3


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_quality_counts_and_verdicts(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality_rules.scan(docs, labels).collect()
    assert Counter(tuple(r)[:7] for r in rows) == Counter((i, *brute_counts(t)) for i, t in texts_of(AWKWARD))
    assert all(r.kept != r.base_failed for r in rows)
    assert quality_rules.scan(empty, labels).collect() == []


def test_quality_rules_reject_bad_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = quality_rules.scan(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.2 * n[0, False]


# ---- 4


def test_license_spans(spark, docs, empty):
    text = "é Intro. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    apache = license_scan.TEMPLATES["Apache-2.0 header"]
    changed = apache.replace("may not use", "must never use").replace("CONDITIONS OF ANY KIND", "CONDITIONS of any sort whatever")
    rows = [(1, "so é: Released under the MIT License. End"), (2, "x " * 500 + changed + " y" * 500), (3, text), (4, "released the license under MIT"), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    (part,) = license_scan.scan(frame.where("doc_id = 3")).collect()
    assert part.license == "MIT" and part.matched_words == 22 and text[part.start : part.end].startswith("Permission is") and part.coverage < 0.2
    found = {(r.doc_id, r.license): r for r in license_scan.scan(frame, least_coverage=0.8).collect()}
    mit = found[1, "MIT notice"]
    assert rows[0][1][mit.start : mit.end] == "Released under the MIT License" and mit.coverage == 1.0
    header = found[2, "Apache-2.0 header"]
    assert 0.9 < header.coverage < 1.0 and rows[1][1][header.start : header.end].startswith("Licensed under")
    assert not any(i in (3, 4, 5) for i, _ in found)
    assert license_scan.scan(docs).collect() == license_scan.scan(empty).collect() == []


@pytest.mark.parametrize("name", ["Apache-2.0 notice", "MIT notice", "CC BY-NC notice", "MPL-2.0", "ISC", "Apache-2.0 header"])
@pytest.mark.parametrize("between", [" ", ". An end.\n", " x" * 9 + " "])
def test_license_copies_in_a_row(spark, name, between):
    line = license_scan.TEMPLATES[name]
    text = "é before " + between.join([line] * 5) + " after"
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    step = len(line) + len(between)
    assert [(r.license, r.coverage) for r in found] == [(name, 1.0)] * 5
    assert [r.start for r in found] == [9 + k * step for k in range(5)]


def test_best_covered_license(spark):
    sa, nc, header = (license_scan.TEMPLATES[n] for n in ("CC BY-SA notice", "CC BY-NC notice", "Apache-2.0 header"))
    rows = [(1, f"{nc}. {sa}. {nc}"), (2, f"Here: {sa}!"), (3, header), (4, header.replace("Unless required", f"{nc}. Unless required"))]
    found = defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.doc_id].append(r.license)
    assert found[1] == ["CC BY-NC notice", "CC BY-SA notice", "CC BY-NC notice"] and found[2] == ["CC BY-SA notice"]
    assert found[3] == ["Apache-2.0 header"] and found[4] == ["Apache-2.0 header", "CC BY-NC notice"]


def test_named_licenses(spark):
    template = license_scan.TEMPLATES
    cases = {
        "Licensed under CC BY-NC-SA 4.0": ["CC BY-NC-SA notice"],
        "Licensed under CC BY 4.0": ["CC BY notice"],
        "Released under the BSD License": [],
        "Distributed under the MIT licence": ["MIT distribution notice"],
        "x = 1  # SPDX-License-Identifier: Apache-2.0": ["SPDX Apache-2.0"],
        "SPDX-License-Identifier: GPL-3.0-or-later": ["SPDX GPL-3.0-or-later"],
        license_scan._AS_IS: ["MIT"],
        template["MIT"][:300]: ["MIT"],
        "permission is hereby granted to go, free of charge": [],
        **{template[n]: [n] for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL header", "LGPL header", "AGPL header", "CC0", "EPL-2.0 notice", "Unlicense")},
    }
    rows = list(enumerate(cases))
    found = defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[rows[r.doc_id][1]].append(r.license)
        assert (r.coverage == 1.0) == (r.matched_words == len(license_scan.words_of(template[r.license])))
    assert {text: found[text] for text in cases} == cases


# ---- 5


def test_toxicity(spark, docs, empty):
    docs_, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    lexicon = toxicity.learn(docs_, labels)
    got = toxicity.scan(docs_, lexicon).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]
    rows = toxicity.scan(docs, lexicon).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert toxicity.scan(empty, lexicon).collect() == []
    disguised = spark.createDataFrame([(1, "you ID10T you l0ser"), (2, "a clown fish in the sea"), (3, "a сlоwn you are")], "doc_id long, text string")
    score = {r.doc_id: r.predicted for r in toxicity.scan(disguised, lexicon).collect()}
    assert score == {1: 1, 2: 0, 3: 1}
    nothing = toxicity.learn(docs_, labels.where("toxic = 0"))
    assert nothing.weights == {} and toxicity.scan(docs, nothing).where("predicted = 1").count() == 0


# ---- 6


def test_warc_round_trip(spark, tmp_path):
    long = "<p>\r\n\r\nWARC/1.1 é</p>" * 20
    rows = [(3, "u\r\nX: y", long, "c"), (1, None, long, "c"), (2, "u", "small", "c"), (4, "u", "small", "c"), (5, "u", None, None), (6, "u", "", "c"), (7, "u", "b" * 3_000_000, "c"), (8, "u", "b" * 3_000_000, "c"), (8, "u", "b" * 3_000_000, "c"), (None, "u", long, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    warc.write(pages, str(tmp_path / "w"), records_per_file=2)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "w")).collect())
    revisits = {3: 1, 8: 7}
    want = Counter((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i in revisits else "response", revisits.get(i)) for i, _, h, _ in rows)
    assert got == want
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).collect() == []


# ---- 7


def test_encoder_is_the_tokenizers_file():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer_path())
    known.encode_special_tokens = True
    encode = packing.encoder(tokenizer_path())

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.sampled_from("ab'sé1²漢😀 \t\n\r\x0b\x1c\x85\xa0  ​.,!<|>\x00"), max_size=40))
    def same(text):
        assert encode(text).tolist() == known.encode(text, add_special_tokens=False).ids

    same()
    assert encode("<|endoftext|> it's we'll").tolist() == known.encode("<|endoftext|> it's we'll", add_special_tokens=False).ids


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer_path())
    known.encode_special_tokens = True
    for frame, rows in ((docs, texts_of(AWKWARD)), (table(spark, SF, "documents"), real(spark))):
        pieces = packing.pack(frame, tokenizer_path(), group_tokens=50_000, with_ids=True).collect()
        of_sequence, of_doc = defaultdict(list), defaultdict(list)
        for p in pieces:
            assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
            of_sequence[p.sequence_id].append(p)
            of_doc[p.doc_id].append(p)
        for own in of_sequence.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048
        wanted = defaultdict(list)
        for i, t in rows:
            wanted[i] += [*known.encode(t, add_special_tokens=False).ids, 1]
        assert {i: sum(p.length for p in own) for i, own in of_doc.items()} == {i: len(x) for i, x in wanted.items()}
        for i, own in of_doc.items():
            if own[0].doc_tokens == len(wanted[i]):
                assert [x for p in sorted(own, key=lambda p: p.start) for x in p.ids] == wanted[i]
    assert packing.pack(empty, tokenizer_path()).collect() == []


def test_added_tokens_are_one_id_each(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer_path())  # as loaded
    encode = packing.file_encoder(tokenizer_path())

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "a", " ", "  ", "\n", "'s", "é", "漢", "12", "."]), max_size=12).map("".join))
    def same(text):
        assert encode(text).tolist() == known.encode(text, add_special_tokens=False).ids

    same()
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|>" * 3, 3: "none"}
    rows = packing.pack(spark.createDataFrame([*texts.items()], "doc_id long, text string"), tokenizer_path(), with_ids=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: [*known.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60))
def test_balanced_places_every_token_once(lengths):
    pieces = packing.balanced(lengths, 32, 1.0, 0.1)
    assert sorted((d, s + k) for d, s, n, _, _ in pieces for k in range(n)) == [(d, k) for d, n in enumerate(lengths) for k in range(n)]
    cells = [(q, o + k) for _, _, n, q, o in pieces for k in range(n)]
    assert len(set(cells)) == len(cells) and all(o < 32 for _, o in cells)
    assert len({q for q, _ in cells}) <= -(-sum(lengths) // 32) + 1


# ---- 8

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    def passes(kind, found):
        digits = re.sub("[^0-9]", "", found)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in found.split(".")), "card": lambda: 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()

    return {k: [m.span() for m in re.finditer(p, text) if passes(k, m.group())] for k, p in PLAIN.items()}


@settings(max_examples=500, deadline=None)
@given(st.text("a@.-+ 0145(25)é", max_size=40))
def test_base_detectors(text):
    base, every = pii.find(text)
    assert base == brute_base(text)
    assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)


@pytest.mark.parametrize(
    ("kind", "hidden"),
    [
        ("email", "john.doe (at) example (dot) com"),
        ("email", "john.doe at example dot com"),
        ("email", "jоhn.doe＠exаmple．com"),
        ("email", "john​.doe@exam​ple.com"),
        ("phone", "plus one five five five one two three four five six seven"),
        ("ip", "１９２.168.0.1"),
        ("card", "four one one one 1111 one one one one 1111"),
    ],
)
def test_disguises_map_back(kind, hidden):
    text = f"é write to {hidden}, or not"
    base, every = pii.find(text)
    new = set(every[kind]) - set(base[kind])
    assert hidden in {text[a:b] for a, b in new}
    assert hidden not in pii.redacted(text, every)


@pytest.mark.parametrize(
    ("kind", "hidden"),
    [
        ("email", "john (at) example dot com"),
        ("email", "john@example dot com"),
        ("email", "john at example.com"),
        ("email", "john dot doe [at] exаmple (dot) co dot uk"),
        ("email", "jоhn\u00a0аt example d\u200bot com"),
        ("ip", "192 dot 168 dot 0 dot 1"),
        ("ip", "one nine two dot one six eight dot zero dot one"),
        ("ip", "192[.]168[.]0[.]1"),
        ("ip", "192 [dot] one six eight (.) zero dot 1"),
        ("ip", "192.168.zero.one"),
        ("card", "4111 1111 1111 one one 11"),
        ("card", "4111 оne 11 one 111 \u200bо\u200bne 1111"),
        ("phone", "plus 49 30 оne two 3456 seven"),
    ],
)
def test_mixed_disguises_map_back(kind, hidden):
    text = f"é write me at {hidden}, or not"
    base, every = pii.find(text)
    assert hidden in {text[a:b].strip("\u200b") for a, b in set(every[kind]) - set(base[kind])}
    assert hidden not in pii.redacted(text, every)


def test_sites_in_prose_are_no_addresses():
    prose = "It is available at example.com, or look at www.example.org. We met at noon at the point of sale. In 2019 one in 1234 (at 5.30) had 3.2.1"
    assert pii.find(prose) == ({k: [] for k in pii.KINDS},) * 2
    text = "reach me at john.doe (at) example.com or me at john.doe@example.com at noon"
    assert [text[a:b] for a, b in pii.find(text)[1]["email"]] == ["john.doe (at) example.com", "john.doe@example.com"]


def test_prose_has_no_disguises(spark, docs, empty):
    prose = "We met at noon. One two three. The dot at the end (at last) costs 12.50, chapter 3.2.1; seven eight nine! null null null"
    assert pii.find(prose) == ({k: [] for k in pii.KINDS},) * 2
    assert pii.scan(docs).count() == len(AWKWARD) and pii.scan(empty).collect() == []
    for r in pii.scan(table(spark, SF, "documents"), with_text=True).collect():
        text = dict(real(spark))[r.doc_id] if r.n_email + r.n_ip + r.n_card + r.n_phone else None
        if text is not None:
            assert r.base_sha256 == hashlib.sha256(pii.joined(brute_base(text)).encode()).hexdigest()
            assert pii.detect(r.redacted)["email"] == []
    assert pii.detect("1" * 200_000 + "@" * 1000 + "a" * 200_000)["email"] == []


# ---- 9


def brute_hits(rows, items, window=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))

    windows = defaultdict(set)
    for name, text in items:
        w = words(text or "")
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add("null" if name is None else str(name))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_decontamination(spark, docs, empty, block_bytes):
    items = [(1, " ".join(PROSE.split()[5:30])), (2, "Short ONE"), (3, None), (4, ""), (None, "漢字 😀"), (2, "of it line"), (5, "line of it line of it other line line of it line of it other"), (5, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs, bench, block_bytes=block_bytes)
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_hits(texts_of(AWKWARD), items)
    assert max(r.longest for r in got.collect()) == 25
    clean = {r.doc_id for r in got.collect() if not r.contaminated}
    kept = decontaminate.clean(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean and kept.where("text is null").count() == 1
    assert decontaminate.scan(empty, bench).collect() == []
    assert decontaminate.scan(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_table(spark):
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = decontaminate.scan(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()
    assert Counter(tuple(r)[:6] for r in got) == brute_hits(real(spark), bench)


def test_decontamination_of_a_shared_prompt(spark):
    """Very many items that share a prompt: a document's spans don't grow with them."""
    prompt = "read the text below and pick the best answer to this question"
    items = [(k, f"{prompt} what is item{k} of {k % 7} and why") for k in range(1500)] + [(9000 + k, f"{prompt} of all") for k in range(500)]
    rows = [(k, f"some {k} words {prompt} but of its own {k} {prompt} what is item{k} of {k % 7} then") for k in range(60)] + [(70, f"x {prompt} of all {prompt} of all")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (8 << 20, 20_000):
        got = decontaminate.scan(frame, bench, block_bytes=block_bytes).collect()
        assert Counter(tuple(r)[:6] for r in got) == brute_hits(rows, items)
        longest = {r.doc_id: (r.longest, r.longest_item, r.longest_start) for r in got}
        assert longest == {k: (17, str(k), 3 + 12 + 5) for k in range(60)} | {70: (14, "9000", 1)}
    found = decontaminate._searched(frame, bench, 10, 8 << 20)
    assert found.selectExpr("max(size(spans)) AS n").first().n <= 4


def test_one_block_of_the_benchmark_in_a_stage(spark, capsys):
    items = [(k, " ".join(f"item{k}x{j}" for j in range(12))) for k in range(40)]
    rows = [(k, "start " + items[k][1] + " then " + items[39 - k][1]) for k in range(40)] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_bytes=200)
    capsys.readouterr()
    got.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_hits(rows, items)


def test_decontamination_blocks_of_a_repeated_text(spark):
    items = [(k, "one and the same text of a test that is there very often") for k in range(400)] + [(1000 + k, f"a text of its own, number {k}, in the test") for k in range(200)]
    blocks = [*decontaminate._blocks(spark.createDataFrame(items, "item_id long, text string"), 2000)]
    assert max(sum(len(x[1]) for x in block) for block in blocks) <= 4000
    assert sorted(x for block in blocks for names, _ in block for x in names) == sorted(str(i) for i, _ in items)


# ---- 10


def test_quotation_threads(spark):
    rows = [
        (1, 0, "user", "Where is the key?\nI need it."),
        (1, 1, "assistant", "Under the mat."),
        (1, 2, "user", "On Monday B wrote:\n> Under the mat.\n\nNot there."),
        (1, 3, "assistant", "> > Under the mat.\n> Not there.\nLook again"),
        (1, 4, "user", "> where is the KEY\nnever mind"),
        (2, 0, "user", "> Look again\nMay I ask too?"),
        (2, 1, "assistant", "> text that nobody wrote\nYes"),
        (None, 1, "user", "> Under the mat."),
        (3, None, "user", None),
        (4, 7, "user", ""),
    ]
    got = {(r.conv_id, r.turn): r for r in quotation.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    replies = {k: (r.reply_conv, r.reply_turn) for k, r in got.items()}
    assert replies[1, 2] == (1, 1) and replies[1, 3] == (1, 2) and replies[1, 4] == (1, 0) and replies[2, 0] == (1, 3) and replies[2, 1] == (2, 0)
    assert (got[2, 1].thread_conv, got[2, 1].thread_turn, got[2, 1].depth) == (1, 0, 5)
    assert got[1, 2].text == "Not there." and got[1, 3].text == "Look again" and got[1, 3].levels == 2
    assert (got[1, 3].n_quotes, got[1, 3].n_linked, got[2, 1].n_quotes, got[2, 1].n_linked) == (2, 2, 1, 0)
    assert got[None, 1].reply_turn is None and got[4, 7].depth == 0 and got[3, None].text == ""
    assert quotation.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_passages_decide_before_lines(spark):
    """A line that several wrote belongs to the passage around it, and a quote may be wrapped anew."""
    rows = [
        (1, 0, "user", "Yes.\nThe train leaves at nine"),
        (1, 1, "assistant", "Yes.\nThe bus leaves at ten"),
        (1, 2, "user", "> Yes.\n> The bus leaves at ten\n\nThanks"),
        (2, 0, "user", "A long line that a mail program is going to wrap"),
        (2, 1, "assistant", "And then?"),
        (2, 2, "user", "> A long line that a mail\n> program is going to wrap\nDid it?"),
        (3, 0, "user", "Yes."),
        (3, 1, "user", "first"),
        (3, 2, "user", ">\n>  \n> Yes."),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotation.link(frame.unionByName(frame)).collect()}
    assert {k: (r.reply_conv, r.reply_turn) for k, r in got.items() if k[1] == 2} == {(1, 2): (1, 1), (2, 2): (2, 0), (3, 2): (3, 0)}
    assert [(got[c, 2].n_quotes, got[c, 2].n_linked, got[c, 2].text) for c in (1, 2, 3)] == [(2, 2, "Thanks"), (2, 2, "Did it?"), (1, 1, "")]


def test_quotes_of_sentences_and_of_other_conversations(spark):
    rows = [
        (1, 0, "user", "The key is gone. I looked under the old\nmat. Who has it?"),
        (1, 1, "assistant", "Nobody."),
        (1, 2, "user", "> I looked under the old mat.\nLook again"),
        (1, 3, "user", "> I looked under\n> the old mat.\nOnce more"),
        (2, 0, "user", "> A passage of both\nA passage of both"),
        (2, 1, "assistant", "> Later on\nand"),
        (2, 2, "assistant", "Later on"),
        (3, 5, "user", "A passage of both\n\nLater on"),
        (4, 0, "user", "A passage of both"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotation.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    to = {k: (r.reply_conv, r.reply_turn) for k, r in got.items()}
    assert to[1, 2] == to[1, 3] == (1, 0) and got[1, 3].n_linked == 2
    assert to[2, 0] == to[2, 1] == (3, 5)


def test_threads_of_the_table(spark):
    rows = table(spark, SF, "conversations")
    got = quotation.link(rows.withColumn("depth", F.lit("clash")).withColumn("own", F.lit(1))).collect()
    assert Counter((r.conv_id, r.turn, r.text) for r in got) == Counter((r.conv_id, r.turn, r.text) for r in rows.collect())
    assert all((r.thread_conv, r.depth) == (r.conv_id, r.turn) for r in got)
