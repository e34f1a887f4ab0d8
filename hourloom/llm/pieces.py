"""Repeated windows of fixed length, found through pieces that share a minimiser.

A window is W consecutive units (bytes or words) of one text.  The minimiser of a window is the least of its k-unit
hashes (the leftmost of equals), so equal windows have it at the same place.  Consecutive windows with one minimiser
form a piece; a text of n units has about 2n / (W - k) pieces.  Windows of one piece can only equal windows of pieces
with the same minimiser hash (the anchor), so it is enough to compare pieces anchor by anchor:

1. every text is cut into pieces; what is kept of a piece is its place, anchor and digest;
2. equal pieces are counted together, and only anchors with two or more different pieces need the text of a piece;
3. one copy of each such piece is fetched from its document and sent to the bucket of its anchor, where the operator
   (suffix arrays or sorted windows) finds the windows it shares with others;
4. an anchor with over ``CROWD`` different pieces is not gathered: its windows become rows of 128-bit digests that are
   counted by an ordinary grouped aggregation;
5. the ranges found go back to every document that holds the piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import K1, K2, field, id_text, map_batches, row_key, stage, to_bytes

#: Different pieces of one anchor that are compared in one task; more are compared as digests, spread over all tasks.
CROWD = 64
#: Units of a text that are cut at a time; a minimiser's place takes the low 24 bits of a key.
STRETCH = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)

RANGE = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
PIECE = [
    T.StructField("start", T.IntegerType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("lead", T.IntegerType()),
    T.StructField("anchor", T.LongType()),
    T.StructField("digest", T.LongType()),
]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread evenly, so that the order of hashes says nothing about the text."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut(hashes: np.ndarray, owner_end: np.ndarray, n_starts: int, width: int, grams: int) -> tuple[np.ndarray, ...]:
    """Pieces of a stretch of units: ``start, n, lead`` and the anchor's hash.

    ``hashes[i]`` is the hash of the k-gram at unit i, ``owner_end[i]`` the end of the text that unit i belongs to, and
    ``grams`` the number of k-grams in a window of ``width`` units; windows start at units below ``n_starts``.
    """
    if n_starts <= 0 or len(hashes) < grams:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < grams:
        least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
    n_starts = min(n_starts, len(least))
    place = (least[:n_starts] & _PLACE).astype(np.int64)
    at = np.arange(n_starts)
    inside = at + width <= owner_end[:n_starts]
    place[~inside] = -1
    edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    n = np.diff(np.append(edge, n_starts))
    real = place[edge] >= 0
    start, n = edge[real], n[real]
    anchor = place[start]
    return start, n, anchor - start, hashes[anchor]


def occurrences(rows: DataFrame, cutter: Callable[[list[bytes]], Iterator[tuple]]) -> DataFrame:
    """One row per piece of each row of ``(_hl_k1, _hl_k2, _hl_id, _hl_text)``.

    ``cutter`` yields ``(row numbers, start, n, lead, anchor, digest)`` for a list of texts.
    """
    keep = [rows.schema[c] for c in (K1, K2, "_hl_id")]

    def run(batch: dict) -> Iterator[dict]:
        texts = [to_bytes(t) for t in batch["_hl_text"]]
        for row, start, n, lead, anchor, digest in cutter(texts):
            out = {f.name: [batch[f.name][i] for i in row.tolist()] for f in keep}
            yield out | {"start": start, "n": n, "lead": lead, "anchor": anchor.view(np.int64), "digest": digest.view(np.int64)}

    return map_batches(rows, run, T.StructType([*keep, *PIECE]))


def repeated(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    cutter: Callable,
    fetch: Callable[[bytes, list[tuple[int, int]]], list[bytes]],
    compare: Callable[[DataFrame], DataFrame],
    windows: Callable[[bytes, int], list[bytes]],
    width: int,
    earlier: bool,
) -> DataFrame:
    """``(_hl_k1, _hl_k2, spans)``: units of each row that lie in repeated windows, as ranges that may overlap.

    earlier=False: the window starts at two or more places.  earlier=True: it also starts in a text with a smaller id
    (a null id is larger than any).  ``fetch`` cuts pieces ``(start, units)`` out of a text, ``compare`` finds the
    shared windows of gathered pieces and ``windows`` lists the windows of a piece.
    """
    rows = id_text(docs, id_col, text_col)
    rows = rows.select(*row_key(F.col("_hl_id"), F.col("_hl_text")), "_hl_id", "_hl_text")
    places = stage(occurrences(rows, cutter), "places")
    often = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor")
    often = stage(often, "often")  # so that the join has shuffles of its own, which Spark can split where they are skewed
    places = stage(places.join(often, "anchor", "left_semi"), "repeated-anchors")
    rank = F.struct(F.isnull("_hl_id").alias("none"), F.col("_hl_id").alias("id"))
    sample = F.min(F.struct(rank.alias("rank"), K1, K2, "start", "n", "lead")).alias("s")
    kinds = places.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), sample)
    kinds = stage(kinds.select("anchor", "digest", "copies", "s.*"), "kinds")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    needed = kinds.join(several, "anchor").withColumn("crowd", F.col("kinds") > CROWD)
    texts = _fetched(rows.select(K1, K2, "_hl_text"), needed, fetch, width)
    texts = stage(texts, "pieces")
    calm = compare(texts.filter(~F.col("crowd")))
    found = calm.unionByName(_crowded(texts.filter("crowd"), windows, earlier))
    ranges = found.groupBy("anchor", "digest").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    kinds = kinds.join(ranges, ["anchor", "digest"], "left").select("anchor", "digest", "copies", F.col("rank").alias("first"), "ranges")
    whole = (rank > F.col("first")) if earlier else (F.col("copies") > 1)
    kinds = stage(kinds.filter("copies > 1 or ranges is not null"), "verdicts")
    marked = places.join(kinds, ["anchor", "digest"])
    every = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b")))
    marked = marked.select(K1, K2, "start", F.when(whole, every).otherwise(F.col("ranges")).alias("r")).filter("r is not null")
    span = F.transform("r", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + width).alias("b")))
    return marked.groupBy(K1, K2).agg(F.flatten(F.collect_list(span)).alias("spans"))


def _fetched(texts: DataFrame, needed: DataFrame, fetch: Callable, width: int) -> DataFrame:
    """Each needed piece, cut out of the document it was first seen in; again for every row equal to that one."""
    wanted = F.collect_list(F.struct("start", "n", "lead", "anchor", "digest", "copies", "rank", "crowd")).alias("w")
    joined = texts.join(needed.groupBy(K1, K2).agg(wanted), [K1, K2]).select("_hl_text", "w")
    schema = T.StructType(
        [
            T.StructField("anchor", T.LongType()),
            T.StructField("digest", T.LongType()),
            T.StructField("lead", T.IntegerType()),
            T.StructField("copies", T.LongType()),
            field(needed, "rank"),
            T.StructField("crowd", T.BooleanType()),
            T.StructField("piece", T.BinaryType()),
        ]
    )

    def run(batch: dict) -> Iterator[dict]:
        for text, wants in zip(batch["_hl_text"], batch["w"]):
            out = {c: [w[c] for w in wants] for c in ("anchor", "digest", "lead", "copies", "rank", "crowd")}
            yield out | {"piece": fetch(to_bytes(text), [(w["start"], w["n"] + width - 1) for w in wants])}

    return map_batches(joined, run, schema)


def _crowded(texts: DataFrame, windows: Callable, earlier: bool) -> DataFrame:
    """Shared windows of the pieces of crowded anchors, counted as digests over all tasks."""
    schema = T.StructType(
        [
            T.StructField("anchor", T.LongType()),
            T.StructField("digest", T.LongType()),
            field(texts, "rank"),
            T.StructField("at", T.IntegerType()),
            T.StructField("w1", T.LongType()),
            T.StructField("w2", T.LongType()),
        ]
    )

    def run(batch: dict) -> Iterator[dict]:
        for anchor, digest, rank, piece in zip(batch["anchor"], batch["digest"], batch["rank"], batch["piece"]):
            own = windows(piece)
            codes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in own]), "<i8").reshape(-1, 2)
            n = len(own)
            yield {"anchor": [anchor] * n, "digest": [digest] * n, "rank": [rank] * n, "at": np.arange(n), "w1": codes[:, 0], "w2": codes[:, 1]}

    rows = stage(map_batches(texts.select("anchor", "digest", "rank", "piece"), run, schema), "digests")
    seen = rows.groupBy("w1", "w2").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2"), F.min("rank").alias("first"))
    seen = seen.filter("d1 != d2").select("w1", "w2", "first")
    met = rows.join(seen, ["w1", "w2"])
    if earlier:
        met = met.filter(F.col("rank") > F.col("first"))
    one = F.collect_list(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("ranges")
    return met.groupBy("anchor", "digest").agg(one)


def applied(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, remove: Callable[[bytes, list], dict], fields: list) -> DataFrame:
    """Each row's id with what ``remove(text, merged spans)`` returns."""
    rows = id_text(docs, id_col, text_col)
    rows = rows.select(*row_key(F.col("_hl_id"), F.col("_hl_text")), "_hl_id", "_hl_text")
    joined = rows.join(spans, [K1, K2], "left").select("_hl_id", "_hl_text", "spans")
    schema = T.StructType([field(rows, "_hl_id", id_col), *fields])
    return map_batches(joined, _remover(id_col, remove, fields), schema)


def _remover(id_col: str, remove: Callable, fields: list) -> Callable:
    names = [f.name for f in fields]

    def run(batch: dict) -> Iterator[dict]:
        for a in range(0, len(batch["_hl_id"]), 512):
            part = slice(a, a + 512)
            done = [remove(to_bytes(t), merged(s)) for t, s in zip(batch["_hl_text"][part], batch["spans"][part])]
            yield {id_col: batch["_hl_id"][part]} | {n: [d[n] for d in done] for n in names}

    return run


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges [a, b) in order, with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs(marks: np.ndarray) -> list[dict]:
    """Ranges [a, b] of marked windows."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return [{"a": a, "b": b - 1} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
