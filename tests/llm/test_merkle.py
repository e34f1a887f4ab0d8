"""The manifest against trees built in one piece."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from hourloom.llm import merkle


def H(text):
    return sha256(text.encode()).hexdigest()


def piece(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return H("".join(map(piece, (doc_id, source, lang, n_chars, text))))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        run = i - i % 8
        yield "".join(level[run:i]), "".join(level[i + 1 : run + 8])
        i //= 8


def brute(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for own in langs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = [tree([leaf(r, r[1]) for r in langs[g]]) for g in order]
    top = tree([t[-1][0] for t in trees])
    for k, (g, levels) in enumerate(zip(order, trees)):
        for i, row in enumerate(langs[g]):
            doc_id, text = row[:2]
            if doc_id is not None and text and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            ways, folded = [*path(levels, i), *path(top, k)], leaf(row, text)
            for left, right in ways:
                folded = H(left + folded + right)
            proof = H("".join(a + b for a, b in ways))
            yield doc_id, levels[0][i], levels[-1][0], top[-1][0], proof, folded, folded == top[-1][0]


def rows():
    rng = random.Random(2)
    out = [(i, "Word " * rng.randrange(5) + str(i), rng.choice(["en", "en", "en", None, "ä", "", "zz"]), f"s{i % 3}", i) for i in range(330)]
    out += [(1000 + i, "X", f"lang{i}", None, None) for i in range(20)]  # more languages than a node has children
    out += [(None, None, None, None, None), (None, "A", "en", "s", 1), (5000, None, "en", None, 3), (5001, "", "ä", "", -1), (7, "A", "en", "s", 1)]
    return [*out, (5002, "long ß " * 50000, "en", "s", 5)]


@pytest.mark.parametrize("height", [1, 2, 4])
def test_against_whole_trees(spark, height):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.selectExpr("*", "'?' as leaf", "'?' as grp", "0 as pos")
    got = sorted(map(tuple, merkle.audit(docs, height).collect()), key=str)
    assert got == sorted(brute(rows()), key=str)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_repeated_rows_and_one_row(spark):
    for few in ([(1, "A", "en", "s", 1)] * 3, [(1, "A", "en", "s", 1)], [(None, None, None, None, None)]):
        docs = spark.createDataFrame(few, "doc_id long, text string, lang string, source string, n_chars int")
        assert sorted(map(tuple, merkle.audit(docs).collect()), key=str) == sorted(brute(few), key=str)


def test_empty(spark):
    assert merkle.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_is_a_permutation_with_near_parents(levels):
    places = [merkle.address(d, np.arange(8**d), levels) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(sum(8**d for d in range(levels))))
    assert places[0][0] == 0
    lower = levels - levels // 2
    if levels > 1:  # each lower tree lies in one stretch
        size = sum(8**d for d in range(lower))
        roots = places[levels // 2]
        leaves = places[-1].reshape(len(roots), -1)
        assert ((leaves >= roots[:, None]) & (leaves < roots[:, None] + size)).all()
