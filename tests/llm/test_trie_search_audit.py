"""The prefix trie, the neighbour search and the filter audit against brute force, on awkward rows and on the smallest tables."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketflow.llm import cross_polytope, filter_audit, prefix_trie
from basketflow.llm.common import table
from basketflow.llm.registered import ORACLES, QUERIES
from compare import difference, duck

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_queries_equal_their_oracles(spark, key):
    assert difference(QUERIES[key](spark, SF), duck(SF), ORACLES[key]) is None


# ---- 11


def brute_trie(rows, group=20, shared=4):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % shared
        path = tuple(own.get(c - c % group, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaf = [p for p in below if not any(q[:-1] == p for q in members if q)]
        ids = sorted(c for c, end in inside if end)
        saved = sum((len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) for p in below if p)
        out.append(
            (
                min(c for c, _ in inside),
                len(path),
                min(c for c, _ in members[path[:-1]]) if path else None,
                len(inside),
                sum(1 for q in members if q and q[:-1] == path),
                len(leaf),
                saved,
                hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


TRIE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
CONVERSATIONS = (
    # The same long start in many, cut at different lengths; ids of several groups, one of them without its first.
    [(c, t, "user" if t % 2 else None, f"turn {t} of all", "x") for c in (*range(0, 12), *range(45, 52)) for t in range(c % 7 + 3)]
    + [(20, t, "user", f"long {t // 3}", "x") for t in range(70)]
    + [(21, t, "user", f"long {t // 3}", "x") for t in range(68)]
    + [(22, t, "user", f"long {t // 3}" if t != 40 else "apart", "x") for t in range(70)]
    + [(60, None, "user", None, "x"), (60, None, "user", None, "x"), (60, 3, None, "tie", "x"), (60, 3, "user", "tie", None), (60, 3, "user", "other", None)]
    + [(61, 1, "system", "w " * 40_000, "x"), (None, 1, "user", "no conversation", "x"), (62, 1, "", "", "x"), (63, -5, "user", "a\x00b c", "x")]
)


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string, block string").repartition(3)


@pytest.mark.parametrize("block,run", [(8, 4096), (3, 5), (1, 2)])
def test_trie_equals_brute_force(conversations, block, run):
    got = prefix_trie.scan(conversations, block=block, run=run)
    assert sorted((tuple(r) for r in got.select(*TRIE_COLUMNS).collect()), key=str) == brute_trie(CONVERSATIONS)


def test_trie_of_turnless_conversations(spark):
    """All conversations take no turn of an absent first one and lose their only turn."""
    ids = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0][:6]
    rows = [(c, 1, "user", "gone") for c in ids]
    got = prefix_trie.scan(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(*TRIE_COLUMNS).collect()
    assert [tuple(r) for r in got] == brute_trie(rows) and got[0].n_leaves == 1


def test_trie_of_nothing(spark):
    assert prefix_trie.scan(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_member_lists_run_through_pieces(spark):
    """A node with members in many pieces has the hash of the whole list."""
    ids = list(range(-30, 5000, 7))
    ended = spark.createDataFrame([(i, 2, 5, 6) for i in ids] + [(1, 1, 0, 0)], "conv_id long, depth long, key_a long, key_b long").repartition(5)
    got = {r.depth: r.ends_sha256 for r in prefix_trie.id_hashes(ended, piece=16).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for d, v in ((2, ids), (1, [1]))}


# ---- 12


def brute_neighbours(vectors, every, k):
    out = {}
    good = {(i, tuple(v)) for i, v in vectors}
    for i, v in good:
        if i % every == 0:
            scored = sorted((-float(np.dot(v, w)), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / len(want[i]) for i in want])


@pytest.fixture(scope="module")
def random_vectors():
    rng = np.random.default_rng(5)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((3000, 24)).astype(np.float32))]


@pytest.mark.parametrize("unit", [True, False])
def test_recall_and_exact_scores(spark, random_vectors, unit):
    """Unit vectors, and vectors whose norms differ by up to some 3 times: random ones are the hardest to tell apart."""
    rows = random_vectors
    if unit:
        rows = [(i, [float(x) for x in (np.array(v) / np.linalg.norm(v)).astype(np.float32)]) for i, v in rows]
    got = found(cross_polytope.scan(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)))
    want = brute_neighbours(rows, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    at = dict(rows)
    assert all(abs(s - float(np.dot(at[i], at[j]))) < 1e-12 for i, v in got.items() for j, s in v)
    assert all([(-s, j) for j, s in v] == sorted((-s, j) for j, s in v) for v in got.values())


def test_cells_are_split_and_nothing_is_lost(spark, random_vectors):
    """With small cells every one has parts; the result is that of whole cells."""
    df = spark.createDataFrame(random_vectors, "vec_id long, embedding array<float>").repartition(4)
    asked = F.col("vec_id") % 20 == 0
    assert found(cross_polytope.search(df, asked, most_rows=40)) == found(cross_polytope.search(df, asked))


def test_copies_ties_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(6)
    some = [[float(x) for x in v] for v in rng.standard_normal((30, 8))]
    nan, inf = float("nan"), float("inf")
    rows = [(i, some[0], "x", 9) for i in range(0, 900, 2)]  # a third and more are one vector
    rows += [(1000 + i, v, "x", None) for i, v in enumerate(some)] + [(1000, some[0], "x", 1)] * 3
    rows += [(3000, None, "x", 1), (3020, [0.0] * 8, "x", 1), (3040, [None] + [1.0] * 7, "x", 1), (3060, [nan] * 8, "x", 1), (3080, [inf] * 8, "x", 1)]
    rows += [(3100, [1.0, 2.0], "x", 1), (None, some[3], "x", 1)]
    got = found(cross_polytope.scan(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, cell int").repartition(5)))
    want = brute_neighbours([(i, v) for i, v, *_ in rows if i is not None and i < 3000], 20, 20)
    assert set(got) == set(want)
    for i in want:
        if i < 1000:  # the copies: the smallest other ids, in order
            assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
    assert recall(got, want) >= 0.9


def test_fewer_rows_than_asked(spark):
    schema = "vec_id long, embedding array<float>"
    assert found(cross_polytope.scan(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], schema))) == {0: [(1, 0.5), (2, -1.0)]}
    assert cross_polytope.scan(spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    assert cross_polytope.scan(spark.createDataFrame([(1, [1.0]), (3, [2.0])], schema)).collect() == []
    assert cross_polytope.scan(spark.createDataFrame([], schema)).collect() == []


def test_rotation_keeps_lengths_and_probes_start_at_the_own_code():
    how = cross_polytope.Hashing(50, 1.0, False, 3, 0, tables=3)
    x = np.random.default_rng(7).standard_normal((40, 50))
    assert np.allclose(np.linalg.norm(how.signed(how.unit(x, True), how.signs()[0, 0])[:, ::2], axis=1), 1)
    codes = how.codes(x)
    for t, probed in enumerate(how.probed(x, 60)):
        assert (probed[:, 0] == codes[:, t]).all() and all(len(set(p)) == 60 for p in probed)


# ---- 13


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    firsts = {}
    for d, text, *_ in docs:
        if d is not None:
            firsts[text or ""] = min(d, firsts.get(text or "", d))
    failed, parts = [], defaultdict(list)
    for d, text, part, *_ in docs:
        text = text or ""
        w = WORDS.findall(text)
        fails = {
            f
            for f, bad in zip(
                "ABCDE",
                (
                    len(w) < 50,
                    100 * len(set(w)) < 65 * len(w),
                    100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                    re.search(r"[#$%&*|]", text) is not None,
                    d is not None and d > firsts[text],
                ),
            )
            if bad
        }
        parts[part or ""].append((fails, d in good, d in toxic))
    out = []
    for part, rows in parts.items():
        shapley, lines = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                redundant = sum(f in r[0] for r in rows) - len(gone)
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


LONG = " ".join(f"w{k}" for k in range(80))
AUDITED = [
    (1, LONG, "a", "n"),
    (2, LONG, "b", "n"),
    (2, LONG, "b", "n"),
    (3, LONG.upper(), "a", None),
    (4, "same " * 60 + "#", "a", "n"),
    (5, None, "a", "n"),
    (6, "", None, "n"),
    (7, "\x0b\x1c tab wide", "", "n"),
    (8, "A|b", "a", "n"),
    (9, LONG + " | pipe", "only", "n"),
    (None, LONG, "a", "n"),
    (None, LONG, None, "n"),
    (10, "word " * 200_000, "a", "n"),
    (11, LONG + " É", "c", "n"),
]
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (4, 1, 1), (99, 1, 1), (None, 1, 1), (6, 0, None)]


def test_audit_equals_brute_force(spark):
    docs = spark.createDataFrame(AUDITED, "doc_id long, text string, source string, mask string").repartition(4)
    labels = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int")
    got = filter_audit.scan(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(AUDITED, [m for m in MARKS if m[0] is not None])


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.scan(docs, labels).collect() == []
    one = filter_audit.scan(spark.createDataFrame([(1, LONG, None)], "doc_id long, text string, source string"), labels)
    assert one.count() == 600 and one.where("removed + redundant + unique_fails + good_lost + toxic_lost + shapley > 0 OR kept <> 1 OR part <> ''").count() == 0


@pytest.mark.parametrize("k", [1, 3, 5])
def test_edges_are_passed_by_all_orders(k):
    """Each step of an order is one edge: the edges of a filter, and those out of the sets of one size, share all orders."""
    edges, total = filter_audit.edges_of(k), int(np.prod(range(1, k + 1)))
    assert len(edges) == k << (k - 1)
    assert all(sum(w for _, f, w in edges if f == g) == total for g in range(k))
    assert all(sum(w for s, _, w in edges if s.bit_count() == size) == total for size in range(k))
