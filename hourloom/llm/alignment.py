"""Alignment of two tokenizers over a corpus, with counts of linked tokens held by minimal perfect hashing."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import K1, K2, arrow_schema, field, id_text, map_partition, row_key, stage, to_bytes
from hourloom.llm.packing import _encode_ranks, vocabulary_file
from hourloom.llm.perfect import PerfectHash
from hourloom.llm.pieces import mixed

#: Words and linked pairs remembered by a task, and distinct pairs counted by it, before it starts afresh.
MEMO_WORDS, MEMO_PAIRS, COUNTED_PAIRS = 1 << 18, 1 << 22, 1 << 20
#: Words gathered before their pairs are counted, and pairs of ids formed at once.
SLICE_WORDS, AT_ONCE = 1 << 18, 1 << 20
#: Words encoded as one text.
WORDS_AT_ONCE = 1 << 12
#: Links of one unit beyond which its equal pairs are counted together at once.
MANY_LINKS = 1 << 16
#: Parts of the key space; each has a hash function and count vectors of its own.
SECTORS = 256
#: Count vectors added in one task, and tasks' counts that enter one vector.
FAN = 16
#: The counted index (14 bytes a pair) is broadcast up to this many distinct pairs, else joined.
BROADCAST_PAIRS = 1 << 22
_SPACE = "▁"
_UNSAFE = re.compile(rf"^\s| $| \s|{_SPACE}")
_NAMES = [str(i) for i in range(1 << 16)]
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# --- alignment of one text -------------------------------------------------------


class Tokenizers:
    """Token ids and token bytes of both tokenizers; special tokens in a text are plain text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.plain = _encode_ranks(a_path) or _encode_plain(a_path)
        with open(a_path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.a_bytes = {i: bytes(byte.get(c, 0) for c in t) for t, i in vocabulary.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, t in self.a_bytes.items():
            self.a_size[i] = len(t)
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in pieces]
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        #: A piece holds spaces at its head only, so it never reaches over the space between two words.
        self.by_word = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of space + text in both, with their number per text, and whether their bytes are those of space + text."""
        one, two, same = [], [], []
        for text, b in zip(texts, self.model.encode(texts, num_threads=1)):
            a, whole = self.plain(" " + text), to_bytes(" " + text)
            same.append(b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b]))
            one.append(a if same[-1] else [])
            two.append(b if same[-1] else [])
        return *_flat(one), *_flat(two), np.array(same, bool)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """The same for words, many at a time: A reads them as one text and is cut where words end."""
        found = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            text = " " + " ".join(part)
            pieces, a = self.model.encode(part, num_threads=1), np.array(self.plain(text), np.int64)
            b, n_b = _flat(pieces)
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)) + 1)
            a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            cut = np.searchsorted(a_end, ends)
            same = a_end[-1] == ends[-1] == b_end[-1] and (a_end[cut] == ends).all() and (b_end[np.cumsum(n_b) - 1] == ends).all()
            if same and b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(pieces))) == text.encode():
                found.append((a, np.diff(cut, prepend=-1), b, n_b, np.ones(len(part), bool)))
            else:
                found.append(self.encode(part))
        return tuple(map(np.concatenate, zip(*found)))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _encode_plain(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def pairs_of(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs ``a << 16 | b`` of ids that share a group, and how many pairs of occurrences each has.

    Equal ids of a group are counted together first, and pairs are formed in bounded steps.
    """
    own_a, times_a = np.unique(a_group.astype(np.int64) << 32 | a, return_counts=True)
    own_b, times_b = np.unique(b_group.astype(np.int64) << 32 | b, return_counts=True)
    first = np.searchsorted(own_b >> 32, own_a >> 32, "left")
    width = np.searchsorted(own_b >> 32, own_a >> 32, "right") - first
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, at = np.cumsum(width), 0
    while at < len(own_a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        left = np.repeat(np.arange(at, to), width[at:to])
        right = np.arange(len(left)) - np.repeat(np.cumsum(width[at:to]) - width[at:to], width[at:to]) + np.repeat(first[at:to], width[at:to])
        made = (own_a[left] & 0xFFFFFFFF) << 16 | own_b[right] & 0xFFFFFFFF
        keys, inverse = np.unique(np.concatenate((keys, made)), return_inverse=True)
        added = np.concatenate((times, times_a[left] * times_b[right]))
        times, at = np.bincount(inverse, added, len(keys)).astype(np.int64), to
    return keys, times


class Aligner:
    """Texts as lists of units: words with the space before them, or the whole text where words may not be cut apart.

    Both tokenizers end a token before a space between two words, so a word boundary is a group boundary too and a text
    is the sum of its words.  Units are numbered from 0; ``reset`` forgets them.
    """

    def __init__(self, a_path: str, b_path: str, shown: bool = True):
        self.tokens, self.shown = _tokenizers(a_path, b_path), shown
        self.a_size, self.b_size = self.tokens.a_size, self.tokens.b_size
        if max(len(self.a_size), len(self.b_size)) > 1 << 16:
            raise ValueError("a vocabulary has over 65,536 entries")
        self.age = 0
        self.reset()

    def reset(self) -> None:
        self.age += 1
        self.numbers: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = array("q")  # n_a, n_b, n_groups, n_links of each unit
        self.pairs, self.times, self.ends = array("q"), array("q"), array("q", [0])

    def full(self) -> bool:
        return len(self.groups) > MEMO_WORDS or len(self.pairs) > MEMO_PAIRS

    def units(self, texts: list[str | None]) -> list[np.ndarray]:
        """The units of each text; none where it has no tokens."""
        # a text of one unit may be a whole text that is no word
        split = [bool(t) and self.tokens.by_word and " " in t and not _UNSAFE.search(t) for t in texts]
        lists = pc.split_pattern(pa.array([t for t, by_word in zip(texts, split) if by_word], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        words, whole = coded.dictionary.to_pylist(), {t for t, by_word in zip(texts, split) if t and not by_word}
        self._learn([w for w in words if w not in self.numbers], self.tokens.encode_words)
        self._learn(list(whole - self.numbers.keys()), self.tokens.encode)
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        cut = iter(np.split(numbers, lists.offsets.to_numpy()[1:-1]))
        out = [next(cut) if by_word else np.array([self.numbers[t]] if t else [], np.int64) for t, by_word in zip(texts, split)]
        odd = [i for i, own in enumerate(out) if len(own) and own.min() < 0]
        self._learn(list({texts[i] for i in odd} - self.numbers.keys()), self.tokens.encode)
        for i in odd:
            number = self.numbers[texts[i]]
            out[i] = np.array([] if number < 0 else [number], np.int64)
        return out

    def _learn(self, words: list[str], encode: Callable) -> None:
        """Number new units and keep what is known of them; one pass of array operations for all of them."""
        if not words:
            return
        a, n_a, b, n_b, same = encode(words)
        numbers = np.where(same, len(self.groups) - 1 + np.cumsum(same), -1)
        self.numbers.update(zip(words, numbers.tolist()))
        n_a, n_b = n_a[same], n_b[same]
        if not len(n_a):
            return
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(a_end, b_end, assume_unique=True)  # every unit's end is among them
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        in_a, in_b = np.bincount(a_group), np.bincount(b_group)
        last = np.searchsorted(common, a_end[np.cumsum(n_a) - 1])
        n_groups = np.diff(last, prepend=-1)
        n_links = np.add.reduceat(in_a * in_b, last - n_groups + 1)
        self._show(a, b, in_a, in_b, n_groups)
        self.facts.frombytes(np.stack((n_a, n_b, n_groups, n_links), 1).tobytes())
        large = np.flatnonzero(n_links > MANY_LINKS)
        width = in_b[a_group]
        unit = np.repeat(np.arange(len(n_a)), n_a)
        width[np.isin(unit, large)] = 0
        left = np.repeat(np.arange(len(a)), width)
        right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + (np.cumsum(in_b) - in_b)[a_group[left]]
        keys, times = a[left] << 16 | b[right], np.ones(len(left), np.int64)
        sizes = np.where(n_links > MANY_LINKS, 0, n_links)
        for u in large.tolist():  # few: equal ids of a group are counted together
            own_a, own_b = unit == u, np.repeat(np.arange(len(n_b)), n_b) == u
            more = pairs_of(a[own_a], b[own_b], a_group[own_a], b_group[own_b])
            at = int(sizes[:u].sum())
            keys, times = (np.concatenate((x[:at], y, x[at:])) for x, y in zip((keys, times), more))
            sizes[u] = len(more[0])
        first = len(self.pairs)
        self.pairs.frombytes(keys.tobytes())
        self.times.frombytes(times.tobytes())
        self.ends.frombytes((first + np.cumsum(sizes)).tobytes())

    def _show(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n_groups: np.ndarray) -> None:
        if not self.shown:
            self.groups += [""] * len(n_groups)
            return
        one, two = [_NAMES[x] for x in a.tolist()], [_NAMES[x] for x in b.tolist()]
        at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        parts = list(map("|".join, zip(map(one.__getitem__, at_a.tolist()), map(two.__getitem__, at_b.tolist()))))
        wide = np.flatnonzero((in_a > 1) | (in_b > 1))  # the others hold one token of each
        for g, i, x, j, y in zip(*[v.tolist() for v in (wide, at_a[wide], in_a[wide], at_b[wide], in_b[wide])]):
            parts[g] = f"{','.join(one[i : i + x])}|{','.join(two[j : j + y])}"
        ends = np.cumsum(n_groups).tolist()
        self.groups += [";".join(parts[p:q]) for p, q in zip([0, *ends], ends)]

    def pairs_in(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For an array of units: the position there, the pair and its number of links."""
        ends, pairs, times = (np.frombuffer(v, np.int64) if len(v) else np.zeros(0, np.int64) for v in (self.ends, self.pairs, self.times))
        start, width = ends[units], ends[units + 1] - ends[units]
        owner = np.repeat(np.arange(len(units)), width)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(start, width)
        return owner, pairs[at], times[at]


def _slices(batches: Iterator[dict], aligner: Aligner) -> Iterator[tuple[list[int], dict, list[np.ndarray]]]:
    """``(row numbers, batch, units)`` of some rows at a time; the aligner starts afresh when it has grown too large."""
    for batch in batches:
        texts, at = batch["_hl_text"], 0
        while at < len(texts):
            to, words = at, 0
            while to < len(texts) and (to == at or words < SLICE_WORDS):
                words += (texts[to] or "").count(" ") + 1
                to += 1
            if aligner.full():
                aligner.reset()
            yield list(range(at, to)), batch, aligner.units(texts[at:to])
            at = to


# --- counts ------------------------------------------------------------------------


def _sector(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) % np.uint64(SECTORS)).astype(np.int64)


def partial_counts(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(part, sector, pairs, counts)``: for pairs seen by a task the number of its documents that hold them linked."""
    schema = T.StructType(
        [
            T.StructField("part", T.LongType()),
            T.StructField("sector", T.IntegerType()),
            T.StructField("pairs", T.ArrayType(T.LongType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        aligner, part = Aligner(a_path, b_path, shown=False), TaskContext.get().partitionId() << 24
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def written() -> Iterator[dict]:
            sector = _sector(keys)
            order = np.argsort(sector, kind="stable")
            cuts = np.searchsorted(sector[order], np.arange(SECTORS + 1))
            own = [i for i in range(SECTORS) if cuts[i] < cuts[i + 1]]
            split = [order[cuts[i] : cuts[i + 1]] for i in own]
            yield {"part": [part] * len(own), "sector": own, "pairs": [keys[s] for s in split], "counts": [counts[s] for s in split]}

        for _, _, units in _slices(batches, aligner):
            held = [np.unique(u) for u in units]
            sizes = list(map(len, held))
            owner, pair, _ = aligner.pairs_in(np.concatenate(held))
            document = np.repeat(np.arange(len(units)), sizes)[owner]
            seen = np.unique(document << 32 | pair) & 0xFFFFFFFF  # each pair once a document
            new, times = np.unique(seen, return_counts=True)
            keys, inverse = np.unique(np.concatenate((keys, new)), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate((counts, times)), len(keys)).astype(np.int64)
            if len(keys) > COUNTED_PAIRS:
                yield from written()
                part, keys, counts = part + 1, keys[:0], counts[:0]
        if len(keys):
            yield from written()

    return map_partition(rows.select("_hl_text"), run, schema)


_HASH = "sector int, n bigint, sizes array<int>, bits binary, keys binary"


def hashed_pairs(partial: DataFrame) -> DataFrame:
    """One perfect hash function per sector over the distinct pairs; ``keys`` holds the pair of each number."""
    schema = T._parse_datatype_string(_HASH)

    def run(table: pa.Table) -> pa.Table:
        keys = table["pair"].to_numpy()
        made = PerfectHash.build(keys)
        placed = np.zeros(len(keys), np.int64)
        placed[made.find(keys)] = keys
        sizes, bits = made.to_bytes()
        row = {"sector": table["sector"][0].as_py(), "n": len(keys), "sizes": sizes, "bits": bits, "keys": placed.astype(np.uint32).tobytes()}
        return pa.Table.from_pylist([row], arrow_schema(schema))

    distinct = partial.select("sector", F.explode("pairs").alias("pair")).distinct()
    return distinct.groupBy("sector").applyInArrow(run, schema)


def summed_counts(partial: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(sector, counts)``: dense vectors, indexed by the sector's hash function, added up as a tree.

    Some tasks' counts are laid out in one vector; then up to 16 vectors at a time are added until one is left.
    """
    parts = partial.agg(F.count_distinct("part")).first()[0]
    slots = -(-parts // FAN) if parts else 0
    schema = T._parse_datatype_string("sector int, slot bigint, counts binary")
    rows = partial.select("sector", F.pmod(F.xxhash64("part"), F.lit(max(1, slots))).alias("slot"), "pairs", "counts")
    wanted = stage(rows.select("sector", "slot").distinct().join(hashes, "sector"), "wanted")

    def vector(rows: pa.Table, hashed: pa.Table) -> pa.Table:
        own = hashed.to_pylist()[0]
        index, total = PerfectHash.from_bytes(own["sizes"], own["bits"]), np.zeros(own["n"], np.int64)
        for pairs, counts in zip(rows["pairs"].to_pylist(), rows["counts"].to_pylist()):
            total[index.find(np.array(pairs, np.int64))] += counts
        return pa.Table.from_pylist([{"sector": own["sector"], "slot": own["slot"], "counts": total.tobytes()}], arrow_schema(schema))

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table["counts"].to_pylist())
        row = {"sector": table["sector"][0].as_py(), "slot": table["slot"][0].as_py(), "counts": total.tobytes()}
        return pa.Table.from_pylist([row], arrow_schema(schema))

    vectors = stage(rows.groupBy("sector", "slot").cogroup(wanted.groupBy("sector", "slot")).applyInArrow(vector, schema), "vectors")
    while slots > 1:
        slots = -(-slots // FAN)
        moved = vectors.select("sector", F.floor(F.col("slot") / FAN).alias("slot"), "counts")
        vectors = stage(moved.groupBy("sector", "slot").applyInArrow(added, schema), "vectors")
    return vectors.select("sector", "counts")


class CountIndex:
    """Counts of pairs by perfect hashing; every key found is verified."""

    def __init__(self, rows: list):
        self.sectors = {r["sector"]: (PerfectHash.from_bytes(r["sizes"], r["bits"]), np.frombuffer(r["keys"], np.uint32), np.frombuffer(r["counts"], np.int64)) for r in rows}

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        out, sector = np.zeros(len(pairs), np.int64), _sector(pairs)
        order = np.argsort(sector, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(sector[order])) + 1) if len(order) else ():
            index, keys, counts = self.sectors[int(sector[own[0]])]
            at = index.find(pairs[own])
            if (at < 0).any() or (keys[at] != pairs[own]).any():
                raise KeyError("a pair was never counted")
            out[own] = counts[at]
        return out


# --- operator ------------------------------------------------------------------------

MADE = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per input row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``
    (as text) and ``groups_sha256``.

    Byte offsets at which tokens of both tokenizers end cut the tokens of space + text into groups; all pairs of an A
    and a B token of one group are links.  A pair's count is the number of rows that hold it linked.  ``count_sum`` adds
    up the counts of a row's links, ``n_best`` says how many of them have the highest count of their A id.  Null and
    empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros and empty strings.
    Null ids and repeated rows count like others.

    First pass: each task counts the pairs of its documents; the distinct pairs get perfect hash functions and the
    counts are added up as vectors.  Second pass: texts are aligned again and their pairs looked up, in a broadcast
    index of up to ``broadcast_pairs`` pairs and else by a join on the pairs of each row.
    """
    a_path, b_path = a_path or vocabulary_file(), b_path or piece_file()
    rows = id_text(docs, id_col, text_col)
    partial = stage(partial_counts(rows, a_path, b_path), "pair-counts")
    hashes = stage(hashed_pairs(partial), "pair-hashes")
    index = stage(hashes.join(summed_counts(partial, hashes), "sector"), "pair-index")
    best = _best(index)
    if (index.agg(F.sum("n")).first()[0] or 0) <= broadcast_pairs:
        return _looked_up(rows, index, best, a_path, b_path).withColumnRenamed("_hl_id", id_col)
    return _joined(rows, index, best, a_path, b_path).withColumnRenamed("_hl_id", id_col)


def _best(index: DataFrame) -> DataFrame:
    """``(a, best)``: the highest count of each A id; at most one row per entry of the vocabulary."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for keys, counts in zip(batch["keys"], batch["counts"]):
                a = np.frombuffer(keys, np.uint32).astype(np.int64) >> 16
                own, inverse = np.unique(a, return_inverse=True)
                most = np.zeros(len(own), np.int64)
                np.maximum.at(most, inverse, np.frombuffer(counts, np.int64))
                yield {"a": own, "best": most}

    schema = T._parse_datatype_string("a bigint, best bigint")
    return map_partition(_packed(index).select("keys", "counts"), run, schema).groupBy("a").agg(F.max("best").alias("best"))


def _packed(index: DataFrame) -> DataFrame:
    return index.select("sector", "n", "sizes", "bits", "keys", "counts")


def _output(rows: DataFrame, extra: list[T.StructField]) -> T.StructType:
    numbers = [T.StructField(c, T.LongType()) for c in MADE]
    return T.StructType([field(rows, "_hl_id"), *extra, *numbers, T.StructField("groups", T.StringType()), T.StructField("groups_sha256", T.StringType())])


def _totals(aligner: Aligner, units: list[np.ndarray], sums: np.ndarray) -> list[list]:
    """Sums of the units' numbers per text, their groups and the digest of these."""
    ends = np.cumsum([len(u) for u in units])
    running = np.concatenate((np.zeros((1, sums.shape[1]), np.int64), np.cumsum(sums[np.concatenate(units)], axis=0)))
    totals = running[ends] - running[np.concatenate(([0], ends[:-1]))]
    groups = [";".join(map(aligner.groups.__getitem__, u.tolist())) for u in units]
    return [*totals.T.tolist(), groups, [sha256(g.encode()).hexdigest() if g else "" for g in groups]]


def _looked_up(rows: DataFrame, index: DataFrame, best: DataFrame, a_path: str, b_path: str) -> DataFrame:
    context = rows.sparkSession.sparkContext
    shared = context.broadcast([r.asDict() for r in _packed(index).collect()])
    highest = context.broadcast({r.a: r.best for r in best.collect()})
    schema = _output(rows, [])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        aligner, counted = Aligner(a_path, b_path), CountIndex(shared.value)
        top = np.zeros(len(aligner.a_size), np.int64)
        top[list(highest.value)] = list(highest.value.values())
        sums, age = np.zeros((0, len(MADE)), np.int64), 0
        for numbers, batch, units in _slices(batches, aligner):
            if aligner.age > age:  # its units are numbered afresh
                sums, age = sums[:0], aligner.age
            known, n = len(sums), len(aligner.groups)
            if n > known:
                owner, pair, times = aligner.pairs_in(np.arange(known, n))
                counts = counted.counts(pair)
                new = np.zeros((n - known, len(MADE)), np.int64)
                new[:, :4] = np.frombuffer(aligner.facts, np.int64).reshape(-1, 4)[known:]
                np.add.at(new[:, 4], owner, times * (counts == top[pair >> 16]))
                np.add.at(new[:, 5], owner, times * counts)
                sums = np.concatenate((sums, new))
            columns = _totals(aligner, units, sums)
            yield dict(zip(schema.names, [[batch["_hl_id"][i] for i in numbers], *columns]))

    return map_partition(rows, run, schema)


def _joined(rows: DataFrame, index: DataFrame, best: DataFrame, a_path: str, b_path: str) -> DataFrame:
    keyed = rows.select(*row_key(F.col("_hl_id"), F.col("_hl_text")), "_hl_id", "_hl_text")
    key = [T.StructField(k, T.LongType()) for k in (K1, K2)]
    pairs_schema = T.StructType([*key, T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())])

    def pairs(batches: Iterator[dict]) -> Iterator[dict]:
        aligner = Aligner(a_path, b_path, shown=False)
        for numbers, batch, units in _slices(batches, aligner):
            owner, pair, times = aligner.pairs_in(np.concatenate(units))
            document = np.repeat(np.arange(len(units)), [len(u) for u in units])[owner]
            own, inverse = np.unique(document << 32 | pair, return_inverse=True)
            row = [numbers[i] for i in (own >> 32).tolist()]
            total = np.bincount(inverse, times, len(own)).astype(np.int64)
            yield {K1: [batch[K1][i] for i in row], K2: [batch[K2][i] for i in row], "pair": own & 0xFFFFFFFF, "times": total}

    def counts(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for keys, own in zip(batch["keys"], batch["counts"]):
                yield {"pair": np.frombuffer(keys, np.uint32).astype(np.int64), "count": np.frombuffer(own, np.int64)}

    counted = map_partition(_packed(index).select("keys", "counts"), counts, T._parse_datatype_string("pair bigint, count bigint"))
    counted = counted.withColumn("a", F.shiftright("pair", 16)).join(best, "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    held = map_partition(keyed.select(K1, K2, "_hl_text").dropDuplicates([K1, K2]), pairs, pairs_schema)
    met = stage(held, "row-pairs").join(stage(counted, "counted"), "pair")
    sums = met.groupBy(K1, K2).agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("count")).alias("_sum"))
    schema = _output(keyed, key)

    def facts(batches: Iterator[dict]) -> Iterator[dict]:
        aligner = Aligner(a_path, b_path)
        for numbers, batch, units in _slices(batches, aligner):
            own = np.zeros((len(aligner.groups), len(MADE)), np.int64)
            own[:, :4] = np.array(aligner.facts, np.int64).reshape(-1, 4)
            columns = [[batch[c][i] for i in numbers] for c in ("_hl_id", K1, K2)]
            yield dict(zip(schema.names, [*columns, *_totals(aligner, units, own)]))

    joined = map_partition(keyed, facts, schema).join(sums, [K1, K2], "left")
    looked = {"n_best": F.coalesce("_best", F.lit(0)).cast("long"), "count_sum": F.coalesce("_sum", F.lit(0)).cast("long")}
    return joined.withColumns(looked).drop(K1, K2, "_best", "_sum")
