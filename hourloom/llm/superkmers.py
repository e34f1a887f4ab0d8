"""Removal of repeated word windows by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm import pieces
from hourloom.llm.common import map_partition, slices

WIDTH = 50
GRAM = 5
BATCH_BYTES = 1 << 20
_SEED = 13


def cut_words(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple]:
    """Super-k-mers of texts as words without ASCII white space."""
    for a, b in slices(texts, BATCH_BYTES):
        split = [t.split() for t in texts[a:b]]
        sizes = np.array([len(w) for w in split], np.int64)
        ends = np.cumsum(sizes)
        words = [w for own in split for w in own]
        for low in range(0, max(1, len(words) - width + 1), pieces.STRETCH):
            part = words[low : low + pieces.STRETCH + width - 1]
            if len(part) < width:
                continue
            codes, distinct = pd.factorize(np.array([*part, None], object)[:-1])
            codes = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)[codes]
            hashes = codes
            for i in range(1, gram):
                hashes = hashes[:-1] * pieces.FACTOR + codes[i:]
            row = np.searchsorted(ends, low + np.arange(len(part)), "right")
            start, n, lead, anchor = pieces.cut(pieces.mixed(hashes), ends[row] - low, min(pieces.STRETCH, len(part)), width, width - gram + 1)
            joined = b" ".join(part)
            after = np.cumsum([len(w) + 1 for w in part])  # one beyond the word, and its space
            first = np.concatenate(([0], after))[start].tolist()
            last = (after[start + n + width - 2] - 1).tolist()
            digest = b"".join([xxhash.xxh64_digest(joined[i:j], _SEED) for i, j in zip(first, last)])
            own = row[start]
            begin = start + low - (ends[own] - sizes[own])
            yield a + own, begin, n, lead, anchor, np.frombuffer(digest, ">u8").astype(np.uint64)


def _cut_out(text: bytes, wants: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a : a + n]) for a, n in wants]


def _windows(piece: bytes) -> list[bytes]:
    gaps = [-1, *np.flatnonzero(np.frombuffer(piece, np.uint8) == 32).tolist(), len(piece)]
    return [piece[gaps[i] + 1 : gaps[i + WIDTH]] for i in range(len(gaps) - WIDTH)]


def _compare(texts: DataFrame) -> DataFrame:
    """Windows of a piece that a piece seen earlier holds too, by sorting the windows of each anchor."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("ranges", pieces.RANGE)])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rows = (row for b in batches for row in zip(b["anchor"], b["digest"], b["none"], b["id"], b["piece"]))
        found = []
        for anchor, group in groupby(rows, key=lambda r: r[0]):
            different = list({row[1]: row for row in group}.values())
            found += [(anchor, digest, ranges) for digest, ranges in _later(different)]
            if len(found) >= 4096:
                yield dict(zip(("anchor", "digest", "ranges"), zip(*found)))
                found = []
        if found:
            yield dict(zip(("anchor", "digest", "ranges"), zip(*found)))

    rows = texts.select("anchor", "digest", F.col("rank.none").alias("none"), F.col("rank.id").alias("id"), "piece")
    return map_partition(rows.repartition("anchor").sortWithinPartitions("anchor"), run, schema)


def _later(group: list[tuple]) -> Iterator[tuple[int, list]]:
    """``group``: up to ``CROWD`` different pieces of one anchor, each with the least id that holds it."""
    order = sorted(range(len(group)), key=lambda i: (group[i][2], group[i][3] if not group[i][2] else 0))
    rank, ids = {}, None
    for i in order:
        now = group[i][2:4]
        rank[i] = rank[previous] + (now != ids) if rank else 0
        ids, previous = now, i
    entries = [(w, rank[i], i, at) for i, row in enumerate(group) for at, w in enumerate(_windows(row[4]))]
    entries.sort()
    marks: dict[int, list[int]] = {}
    word, least = None, 0
    for w, r, i, at in entries:
        if w != word:
            word, least = w, r
        elif r > least:
            marks.setdefault(i, []).append(at)
    for i, places in marks.items():
        flags = np.zeros(max(places) + 1, bool)
        flags[places] = True
        yield group[i][1], pieces.runs(flags)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_hl_k1, _hl_k2, spans)``: word ranges in a 50-word window that also starts in a text with a smaller id."""
    return pieces.repeated(docs, id_col, text_col, cut_words, _cut_out, _compare, _windows, WIDTH, earlier=True)


def remove_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, removed ``spans`` (word ranges) and the ``kept`` words joined by a space.

    Removes each word covered by a 50-word window whose words also start in a row with a smaller id; windows are judged
    on the input.  A null id is larger than any other; rows with the same id leave each other alone.  Null, empty and
    short texts lose nothing.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", pieces.RANGE), T.StructField("kept", T.BinaryType())]
    return pieces.applied(docs, repeated_words(docs, id_col, text_col), id_col, text_col, _without, fields)


def _without(text: bytes, spans: list[tuple[int, int]]) -> dict:
    words = text.split()
    at, kept = 0, []
    for a, b in spans:
        kept += words[at:a]
        at = b
    return {"n_words": len(words), "spans": [{"a": a, "b": b} for a, b in spans], "kept": b" ".join([*kept, *words[at:]])}
