"""Near copies against all pairs: the operator, the search around a consensus, and the sketches."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from hourloom.llm import setsketch
from hourloom.llm.common import stage


def shingle_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def sentence(rng, n):
    return " ".join(f"Word{rng.randrange(50000)}" for _ in range(n))


def changed(rng, text, count, kinds="rdi"):
    words = text.split()
    for _ in range(count):
        i, kind = rng.randrange(len(words)), rng.choice(kinds)
        words[i : i + 1] = {"r": [f"new{rng.randrange(10**9)}"], "d": [], "i": [words[i], f"new{rng.randrange(10**9)}"]}[kind]
    return " ".join(words)


def roots_of(sets, num, den):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    root = [root[j] if r == root[i] else r for r in root]
    return root


@pytest.fixture(scope="module")
def rows():
    rng, rows = random.Random(3), []
    for size in (60, 300, 1000):
        for k in range(8):
            text = sentence(rng, size)
            rows += [(len(rows), text), (len(rows) + 1, changed(rng, text, max(1, size * (k % 5 + 1) // 250)))]
    base = sentence(rng, 200)
    rows += [(len(rows) + i, changed(rng, base, 1 + i % 9)) for i in range(60)]  # the base itself is missing
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  TWO"), (1005, "two one"), (None, base), (None, None), (None, None)]
    rows += [(1006, "x " * 300), (0, rows[0][1]), (2000, rows[0][1]), (1007, "long words " * 20000), (1008, sentence(rng, 4))]
    return rows


def test_against_all_pairs(spark, rows):
    sets = [shingle_set(t) for _, t in rows]
    root = roots_of(sets, 85, 100)
    least = {}
    for (i, _), s, r in zip(rows, sets, root):
        if s and i is not None:
            least[r] = min(least.get(r, i), i)
    want = []
    for (i, _), s, r in zip(rows, sets, root):
        component = least.get(r) if s else i
        want.append((i, len(s), component, component == i))
    docs = spark.createDataFrame([(i, t, "?", "?") for i, t in rows], "doc_id long, text string, fp string, n string").repartition(6)
    got = [tuple(r) for r in setsketch.near_copies(docs).collect()]
    assert Counter(map(str, got)) == Counter(map(str, want))
    assert len({w[2] for w in want}) < len(want) - 30


def families(seed):
    """Sets that differ from a base by few random elements, by shared ones, or by missing ones."""
    rng = random.Random(seed)
    base = [rng.getrandbits(62) for _ in range(120)]
    extra = [rng.getrandbits(62) for _ in range(12)]
    out = [frozenset(base)] if seed % 2 else []
    for _ in range(90):
        own = set(base)
        kind = rng.randrange(4)
        for e in rng.sample(base, rng.randrange(0, 26)):
            own.discard(e)
        if kind == 1:
            own |= {rng.getrandbits(62) for _ in range(rng.randrange(25))}
        if kind == 2:
            own |= set(rng.sample(extra, rng.randrange(12)))
        if kind == 3:
            own = set(base[: rng.randrange(60, 120)]) | set(rng.sample(extra, 2))
        out.append(frozenset(own))
    return sorted(set(out), key=sorted)


@pytest.mark.parametrize("seed, similar, paired", [(1, (85, 100), 32), (4, (4, 5), 12)])
def test_one_bucket_is_connected_as_by_all_pairs(spark, monkeypatch, seed, similar, paired):
    monkeypatch.setattr(setsketch, "PAIRED", paired)
    sets = families(seed)
    root = roots_of(sets, *similar)
    want = defaultdict(set)
    for i, r in enumerate(root):
        want[r].add(i)
    rows = []
    for i, s in enumerate(sets):
        hashes = np.array(sorted(s), np.uint64)
        rows.append((i.to_bytes(4, "big"), hashes.view(np.int64).tolist(), len(s), setsketch.registers(hashes).tobytes(), i * 7 % 5))
    table = stage(spark.createDataFrame(rows, "fp binary, shingles array<long>, n long, registers binary, crowd long"), "sets")
    found = setsketch.linked(table.selectExpr("fp", "1L as key"), table, similar)
    got = defaultdict(set)
    for r in found.collect():
        got[bytes(r.root)].add(int.from_bytes(r.fp, "big"))
    members = {frozenset(m | {int.from_bytes(r, "big")}) for r, m in got.items()}
    assert members == {frozenset(m) for m in want.values() if len(m) > 1}


def test_sketch_of_a_union_is_the_larger_register():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64)) for _ in range(2))
    merged = setsketch.merge(setsketch.registers(a), setsketch.registers(b))
    assert (merged == setsketch.registers(np.union1d(a, b))).all()
    assert (setsketch.registers(a[:0]) == 0).all() and (setsketch.registers(a) > 0).all()


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_likelihood_finds_the_similarity(share):
    rng = np.random.default_rng(2)
    found = []
    for _ in range(40):
        both, more = rng.integers(0, 1 << 63, 1000).astype(np.uint64), int(1000 * (1 / share - 1) / 2)
        a, b = (setsketch.registers(np.concatenate([both, rng.integers(0, 1 << 63, more).astype(np.uint64)])) for _ in range(2))
        best, sure = setsketch.similarity(*(np.array([x]) for x in ((a > b).sum(), (a < b).sum(), 1000.0 + more, 1000.0 + more)), 0.85)
        found.append(best[0])
        if share >= 0.85:
            assert best[0] >= 0.85 or sure[0] < setsketch.CERTAIN
    assert abs(np.mean(found) - 1000 / (1000 + 2 * more)) < 0.02


def test_empty(spark):
    assert setsketch.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
