"""Alignment of two tokenizers against plain encoding of whole texts, and perfect hashing."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from hourloom.llm import alignment
from hourloom.llm.perfect import PerfectHash


def texts():
    rng = random.Random(4)
    words = "the Time naïve  of\tword café 日本語テキスト 1234567 don't re-write XMLHttpRequest ½ 😀 a b".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "  two  spaces "), (104, "line\n next\n\n x\ty"), (105, "a ▁ b"), (106, "x▁"), (None, "the end"), (None, None)]
    rows += [(107, "<|endoftext|> <s> <unk> <0x41> </s>"), (108, "abab" * 4000), (109, "Ａ ﬁ   \xa0 ​\x00"), (0, rows[0][1]), (0, rows[0][1]), (110, "long text " * 20000)]
    return rows


def brute(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}

    def piece(i):
        p = m.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode()

    aligned, counts = [], Counter()
    for doc_id, text in rows:
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = m.encode(text) if text else []
        one, two = [bytes(byte[c] for c in t.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or not b"".join(one) == b"".join(two) == (" " + text).encode():
            aligned.append((doc_id, [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (one, two)]
        common = sorted({*ends[0]} & {*ends[1]})
        groups, i, j = [], 0, 0
        for c in common:
            i2, j2 = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        aligned.append((doc_id, a, b, groups))
        counts.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    best = {}
    for (x, _), c in counts.items():
        best[x] = max(best.get(x, 0), c)
    for doc_id, a, b, groups in aligned:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        shown = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in groups)
        n_best, total = sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links)
        yield doc_id, len(a), len(b), len(groups), len(links), n_best, total, sha256(shown.encode()).hexdigest() if shown else ""


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("broadcast_pairs", [1 << 22, 0])
def test_against_whole_texts(spark, broadcast_pairs):
    docs = spark.createDataFrame([(i, t, "?", "?") for i, t in texts()], "doc_id long, text string, pair string, groups string").repartition(5)
    got = alignment.align(docs, broadcast_pairs=broadcast_pairs).select(*NAMES)
    want = sorted(brute(texts()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(w[5] < w[4] for w in want) and any(w[3] and w[4] > w[3] for w in want)


def test_units_start_afresh(monkeypatch):
    rows = [(i, t) for i, t in texts()]
    aligner = alignment.Aligner(alignment.vocabulary_file(), alignment.piece_file())
    whole = [[aligner.groups[i] for i in u] for u in aligner.units([t for _, t in rows])]
    monkeypatch.setattr(alignment, "MEMO_WORDS", 3)
    monkeypatch.setattr(alignment, "SLICE_WORDS", 50)
    again = alignment.Aligner(alignment.vocabulary_file(), alignment.piece_file())
    found, ages = [], set()
    for _, _, units in alignment._slices([{"_hl_text": [t for _, t in rows]}], again):
        found += [[again.groups[i] for i in u] for u in units]
        ages.add(again.age)
    assert found == whole and len(ages) > 5


def test_texts_with_many_links(monkeypatch):
    rows = [t for _, t in texts() if t]
    aligner = alignment.Aligner(alignment.vocabulary_file(), alignment.piece_file())
    held = []
    for many in (1 << 16, 2):
        monkeypatch.setattr(alignment, "MANY_LINKS", many)
        aligner.reset()
        units = aligner.units(rows)
        found = []
        for u in units:
            _, pair, times = aligner.pairs_in(np.array(u, np.int64))
            total = Counter()
            for p, n in zip(pair.tolist(), times.tolist()):
                total[p] += n
            found.append(total)
        held.append(found)
    assert held[0] == held[1] and any(held[0])


def test_empty_and_without_tokens(spark):
    for few in ([], [(1, None), (2, "")]):
        docs = spark.createDataFrame(few, "doc_id long, text string")
        assert sorted(map(tuple, alignment.align(docs).select(*NAMES).collect())) == sorted(brute(few))


def test_pairs_in_steps(monkeypatch):
    monkeypatch.setattr(alignment, "AT_ONCE", 7)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
    a_group, b_group = np.sort(rng.integers(0, 20, 200)), np.sort(rng.integers(0, 20, 200))
    want = Counter((x, y) for x, g in zip(a.tolist(), a_group) for y, h in zip(b.tolist(), b_group) if g == h)
    keys, times = alignment.pairs_of(a, b, a_group, b_group)
    assert {(k >> 16, k & 0xFFFF): n for k, n in zip(keys.tolist(), times.tolist())} == want


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 32, n, replace=False).astype(np.int64)
    made = PerfectHash.build(keys)
    assert sorted(made.find(keys).tolist()) == list(range(n))
    again = PerfectHash.from_bytes(*made.to_bytes())
    assert again.find(keys).tolist() == made.find(keys).tolist()
    assert sum(len(bits) for bits in made.levels) <= max(64 * 8, 5.5 * n) + 64 * len(made.levels)


def test_vectors_add_up_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    rows = [(i, t) for i, t in texts()] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert sorted(map(tuple, alignment.align(docs).select(*NAMES).collect()), key=str) == sorted(brute(rows), key=str)


def test_units_are_numbered_alike_in_any_slices():
    texts = ["ab cd ab", None, "", "one", "ab  cd", " cd", "ab\ncd ef", "cd ", "ef ab one", "▁ x", "\uac00 é ab"]
    at_once = alignment.Aligner(alignment.vocabulary_file(), alignment.piece_file())
    one_by_one = alignment.Aligner(alignment.vocabulary_file(), alignment.piece_file())
    shown = [[[a.groups[i] for i in u] for u in own] for a, own in ((at_once, at_once.units(texts)), (one_by_one, [one_by_one.units([t])[0] for t in texts]))]
    assert shown[0] == shown[1]
    assert [len(u) for u in shown[0]] == [3, 0, 0, 1, 1, 1, 2, 1, 3, 0, 3]
