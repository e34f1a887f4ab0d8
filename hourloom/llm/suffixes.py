"""Removal of long repeated byte strings by a logarithmic family of suffix arrays."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm import pieces
from hourloom.llm.common import map_partition, row_key, slices, to_bytes

WIDTH = 400
GRAM = 32
BATCH_BYTES = 256 << 10
#: Text of compared pieces per task that the number of buckets aims at.
BUCKET_BYTES = 16 << 20
_SEED = 11
_BYTE = pieces.mixed(np.arange(1, 257, dtype=np.uint64) * pieces.FACTOR)


class SuffixFamily:
    """Suffix arrays of sizes that double, over pieces that enter batch by batch.

    A piece has a suffix that begins at its anchor and a head before it.  ``add`` sorts a batch's suffixes, scans them
    against every level from the place where they would merge, and then merges levels of equal size.  Two pieces whose
    suffixes share ``gram`` bytes are compared to the full extent on both sides of the anchor; all windows of ``width``
    bytes inside the common part are marked in both, or with ``earlier`` only in the one of larger rank.  Equal pieces
    must be entered once.
    """

    def __init__(self, width: int = WIDTH, gram: int = GRAM, earlier: bool = False):
        self.width, self.gram, self.earlier = width, gram, earlier
        self.ranks: list[tuple] = []
        self.levels: list[list[tuple[bytes, int]]] = []
        self.heads: list[bytes] = []
        self.marks: list[np.ndarray] = []

    def add(self, batch: list[tuple[bytes, int]], ranks: list[tuple] | None = None) -> None:
        """``batch``: pieces as (bytes, place of the anchor); ``ranks``: of each the least text that holds it."""
        self.ranks += ranks or [()] * len(batch)
        first = len(self.heads)
        array = sorted((piece[lead:], first + i) for i, (piece, lead) in enumerate(batch))
        self.heads += [piece[:lead] for piece, lead in batch]
        self.marks += [np.zeros(max(0, len(piece) - self.width + 1), bool) for piece, _ in batch]
        for i, (suffix, own) in enumerate(array):  # within the batch: each with those after it
            self._scan(suffix, own, array, i + 1)
        for level in self.levels:
            at = 0
            for suffix, own in array:
                at = bisect_left(level, (suffix[: self.gram],), at)
                self._scan(suffix, own, level, at)
        self.levels.append(array)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels[-2:] = [sorted(self.levels[-2] + self.levels[-1])]  # two sorted runs: a linear merge

    def _scan(self, suffix: bytes, own: int, array: list, at: int) -> None:
        gram = suffix[: self.gram]
        while at < len(array) and array[at][0].startswith(gram):
            other, who = array[at]
            after = _common(suffix, other)
            before = _common(self.heads[own][::-1], self.heads[who][::-1])
            if before + after >= self.width:
                for piece, partner in ((own, who), (who, own)):
                    if self.earlier and self.ranks[partner] >= self.ranks[piece]:
                        continue
                    lead = len(self.heads[piece])
                    self.marks[piece][lead - before : max(0, lead + after - self.width + 1)] = True
            at += 1


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] equal, a[:high] not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def cut_bytes(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple]:
    """Pieces of texts as bytes; ``gram`` is a power of two."""
    doublings = gram.bit_length() - 1
    power = [np.uint64(pow(int(pieces.FACTOR), 1 << i, 1 << 64)) for i in range(doublings)]
    for a, b in slices(texts, BATCH_BYTES):
        joined = b"".join(texts[a:b])
        sizes = np.array([len(t) for t in texts[a:b]], np.int64)
        ends = np.cumsum(sizes)
        for low in range(0, max(1, len(joined) - width + 1), pieces.STRETCH):
            part = joined[low : low + pieces.STRETCH + width - 1]
            if len(part) < width:
                continue
            hashes, step = _BYTE[np.frombuffer(part, np.uint8)], 1
            for p in power:
                hashes = hashes[:-step] * p + hashes[step:]
                step *= 2
            hashes = pieces.mixed(hashes)
            row = np.searchsorted(ends, low + np.arange(len(part)), "right")
            start, n, lead, anchor = pieces.cut(hashes, ends[row] - low, min(pieces.STRETCH, len(part)), width, width - step + 1)
            stop = (start + n + width - 1).tolist()
            digest = b"".join([xxhash.xxh64_digest(part[i:j], _SEED) for i, j in zip(start.tolist(), stop)])
            own = row[start]
            begin = start + low - (ends[own] - sizes[own])
            yield a + own, begin, n, lead, anchor, np.frombuffer(digest, ">u8").astype(np.uint64)


def _cut_out(text: bytes, wants: list[tuple[int, int]]) -> list[bytes]:
    return [text[a : a + n] for a, n in wants]


def _compare(texts: DataFrame, width: int, earlier: bool) -> DataFrame:
    """Windows that pieces share with others, by one family per bucket of anchors."""
    size = texts.agg(F.sum(F.length("piece"))).first()[0] or 0
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("ranges", pieces.RANGE)])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        family, names = SuffixFamily(width, earlier=earlier), {}
        for batch in batches:
            new, ranks = [], []
            for anchor, digest, piece, lead, none, least in zip(*(batch[c] for c in ("anchor", "digest", "piece", "lead", "none", "id"))):
                if names.setdefault((anchor, digest), len(names)) == len(family.heads) + len(new):
                    new.append((piece, lead))
                    ranks.append((none, 0 if none else least))
            family.add(new, ranks)
        marked = [(name, pieces.runs(m)) for name, m in zip(names, family.marks) if m.any()]
        yield {"anchor": [n[0] for n, _ in marked], "digest": [n[1] for n, _ in marked], "ranges": [r for _, r in marked]}

    rows = texts.select("anchor", "digest", "lead", "piece", F.col("rank.none").alias("none"), F.col("rank.id").alias("id"))
    return map_partition(rows.repartition(buckets, "anchor"), run, schema)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, earlier: bool = False) -> DataFrame:
    """``(_hl_k1, _hl_k2, spans)``: byte ranges that lie in a string of ``width`` bytes found at two places or more.

    With ``earlier`` only those count that also start in a text with a smaller id (a null id is larger than any).
    """

    def windows(piece: bytes) -> list[bytes]:
        return [piece[i : i + width] for i in range(len(piece) - width + 1)]

    cutter, compare = partial(cut_bytes, width=width), partial(_compare, width=width, earlier=earlier)
    return pieces.repeated(docs, id_col, text_col, cutter, _cut_out, compare, windows, width, earlier)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes``, removed ``spans`` (maximal runs of bytes) and the ``kept`` bytes.

    Removes each byte covered by a 400-byte string that also starts anywhere else, in the same text or another; strings
    are judged on the input.  Null and short texts lose nothing (null is empty).  Each of several equal rows counts as a
    place, so long repeated rows lose everything.  Kept bytes may begin or end inside a character.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", pieces.RANGE), T.StructField("kept", T.BinaryType())]
    return pieces.applied(docs, repeated_bytes(docs, id_col, text_col), id_col, text_col, _without, fields)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, width: int = WIDTH, earlier: bool = False
) -> DataFrame:
    """The rows with repeated bytes (see ``repeated_bytes``) cut out of the text and other columns as they are.

    With ``earlier`` the text with the smallest id keeps a repeated string.  Rows with equal ids leave each other alone.

    A character of which only some bytes are left is dropped.  ``size_col`` names a column that is to hold the number of
    characters left.  A null text stays null.
    """
    keyed = docs.withColumns(dict(zip((pieces.K1, pieces.K2), row_key(F.col(id_col), F.col(text_col)))))
    found = repeated_bytes(docs, id_col, text_col, width, earlier).withColumnRenamed("spans", "_hl_spans")
    joined = keyed.join(found, [pieces.K1, pieces.K2], "left").select(*docs.columns, "_hl_spans")
    at = docs.columns.index(text_col)
    size_at = None if size_col is None else docs.columns.index(size_col)

    def run(batches):
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            columns = batch.columns[:-1]
            new = [t if s is None else _left(t, s) for t, s in zip(columns[at].to_pylist(), spans)]
            if size_at is not None:
                sizes = zip(columns[size_at].to_pylist(), new, spans)
                columns[size_at] = pa.array([n if s is None else len(t) for n, t, s in sizes], columns[size_at].type)
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def _left(text: str, spans: list) -> str:
    return _without(to_bytes(text), pieces.merged(spans))["kept"].decode("utf-8", "ignore")


def _without(text: bytes, spans: list[tuple[int, int]]) -> dict:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return {"n_bytes": len(text), "spans": [{"a": a, "b": b} for a, b in spans], "kept": b"".join([*kept, text[at:]])}
