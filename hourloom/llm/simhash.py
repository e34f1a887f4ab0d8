"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from hourloom.llm import setsketch
from hourloom.llm.common import K1, K2, field, id_text, map_batches, row_key, stage, to_bytes
from hourloom.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
SHINGLES_AT_ONCE = 1 << 16
#: Fingerprints per table key beyond which links go through midpoints instead of pairs; both ways are exact.
PAIRED_KEYS = 64
_LOW = 0xFFFFFFFF


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64 bits; a bit is set if it is set in over half of the shingle hashes.  No words: 0."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    n = max(1, len(words) - shingle_words + 1)
    ends = ends[shingle_words - 1 :] if len(words) >= shingle_words else ends[-1:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for a in range(0, n, SHINGLES_AT_ONCE):
        b = min(n, a + SHINGLES_AT_ONCE)
        hashes = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[a:b], ends[a:b])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(rows: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds ``fp`` (signed 64 bits) to rows with a ``_hl_text``, which it drops."""
    rest = [f for f in rows.schema.fields if f.name != "_hl_text"]

    def run(batch: dict) -> Iterator[dict]:
        out = {f.name: batch[f.name] for f in rest}
        yield out | {"fp": [fingerprint(to_bytes(t), shingle_words) for t in batch["_hl_text"]]}

    return map_batches(rows, run, T.StructType([*rest, T.StructField("fp", T.LongType())]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``fp``, ``fingerprint`` (hex) and ``component_id``.

    Fingerprints link at ``MAX_BITS`` or fewer differing bits; the component id is the smallest id reachable.  Texts
    without words (null and empty ones too) have fingerprint 0 and link like others.  Null ids count as larger than any
    id: a component of null ids only has a null id.  Repeated rows fall into one component.
    """
    found = stage(fingerprints(id_text(docs, id_col, text_col)), "fingerprints")
    return _with_components(found, "_hl_id").select(
        F.col("_hl_id").alias(id_col),
        "fp",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, the one with the smallest id (then row key), with its columns as they are.

    Of rows that repeat both id and text one stays; which one is open where their other columns differ.
    """
    keyed = docs.withColumns(dict(zip((K1, K2), row_key(F.col(id_col), F.col(text_col)))))
    rows = keyed.select(K1, K2, F.col(id_col).alias("_hl_id"), F.col(text_col).alias("_hl_text"))
    found = stage(fingerprints(rows), "fingerprints")
    rank = F.struct(F.isnull("_hl_id"), "_hl_id", K1, K2)
    first = _with_components(found.withColumn("_hl_rank", rank), "_hl_rank")
    kept = first.select("component").distinct()
    kept = kept.select(F.col(f"component.{K1}").alias(K1), F.col(f"component.{K2}").alias(K2))
    return keyed.join(kept, [K1, K2], "left_semi").dropDuplicates([K1, K2]).drop(K1, K2)


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = (4, 5), shingle_words: int = 5) -> DataFrame:
    """Of texts that links of ``similar`` or more connect, the one with the smallest id (then row key) stays as it is.

    Similarity is that of the sets of shingles (shared over all).  Fingerprints over the same shingles that differ in
    ``MAX_BITS`` or less give the first candidates.  At a similarity of 0.8 fingerprints differ in about 10 of 64 bits,
    too many for Hamming balls around segments, so the bands of ``setsketch`` give the others; the full sets decide on
    all of them.  Texts without words are equal.  Of rows that repeat both id and text one stays; which one is open where
    their other columns differ.
    """
    keyed = docs.withColumns(dict(zip((K1, K2), row_key(F.col(id_col), F.col(text_col)))))
    rows = keyed.select(K1, K2, F.col(id_col).alias("_hl_id"), F.col(text_col).alias("_hl_text"))
    found = stage(setsketch.sketches(rows, shingle_words), "sketches")
    rank = F.struct(F.isnull("_hl_id"), "_hl_id", K1, K2)
    one = found.filter("n > 0").groupBy("fp").agg(F.min(F.struct(K1, K2)).alias("row")).select(F.col("fp").alias("set"), f"row.{K1}", f"row.{K2}")
    prints = stage(fingerprints(rows.join(one, [K1, K2]).dropDuplicates([K1, K2]).select("set", "_hl_text"), shingle_words), "fingerprints")
    of_print = stage(prints.groupBy("fp").agg(F.min("set").alias("least")), "of-print")
    same = prints.join(of_print, "fp").filter("set != least").select(F.col("least").alias("a"), F.col("set").alias("b"))
    near = links(of_print.select("fp")).join(of_print.select(F.col("fp").alias("a"), F.col("least").alias("_a")), "a")
    near = near.join(of_print.select(F.col("fp").alias("b"), F.col("least").alias("_b")), "b")
    pairs = same.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "print-pairs")
    roots = setsketch.classes(found, rows, similar, pairs, shingle_words)
    least = found.groupBy("fp").agg(F.min(rank).alias("least")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = least.groupBy("root").agg(F.min("least").alias("least")).select(f"least.{K1}", f"least.{K2}")
    return keyed.join(stage(kept, "kept"), [K1, K2], "left_semi").dropDuplicates([K1, K2]).drop(K1, K2)


def _with_components(found: DataFrame, rank: str) -> DataFrame:
    """Adds ``component``, the smallest ``rank`` that the row's fingerprint reaches."""
    distinct = stage(found.groupBy("fp").agg(F.min(rank).alias("_hl_least")), "distinct")
    roots = components(links(distinct.select("fp")))
    of_root = F.coalesce("root", "fp")
    labelled = distinct.join(roots, "fp", "left").select("fp", "_hl_least", of_root.alias("root"))
    least = labelled.groupBy("root").agg(F.min("_hl_least").alias("component"))
    return found.join(labelled.join(least, "root").select("fp", "component"), "fp")


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)`` with a != b: enough links between distinct fingerprints to connect all at ``MAX_BITS`` or less.

    Each fingerprint is filed under both of its 32-bit halves.  Two that differ in 3 bits or fewer have a half with at
    most one differing bit, so each looks up its own half (distance 0) and the half with each zero bit set (distance 1;
    the other one of the pair has that bit).  Whole distances are then verified.  Where a key holds more than
    ``PAIRED_KEYS`` fingerprints no pairs are made: every member files its ball of radius 1 and whoever looks the key up
    its ball of radius 2, and all that meet at a midpoint link with the least member filed there.
    """
    half = F.explode(F.array(F.struct(F.lit(0).alias("part"), _high("fp").alias("key")), F.struct(F.lit(1).alias("part"), _low("fp").alias("key"))))
    table = distinct.select(F.col("fp").alias("b"), half.alias("k")).select("b", "k.part", "k.key")
    sizes = table.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    heavy = sizes.filter(F.col("n") > PAIRED_KEYS).select("part", "key", F.lit(True).alias("heavy"))
    table = stage(table.join(heavy, ["part", "key"], "left"), "halves")
    ones = F.sequence(F.lit(-1), F.lit(31))
    flipped = F.filter(
        F.transform(ones, lambda i: F.when(i < 0, F.col("key")).otherwise(F.col("key").bitwiseOR(_bit(i)))),
        lambda k, i: (i == 0) | (k != F.col("key")),
    )
    probes = table.select(F.col("b").alias("a"), "part", F.explode(flipped).alias("key"))
    met = probes.join(table, ["part", "key"])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = met.filter(F.col("heavy").isNull() & (F.col("a") != F.col("b")) & near).select("a", "b")
    # crowded keys: the members on one side, all that look the key up (from either side of a flip) on the other
    crowd = table.filter("heavy")
    either = F.transform(ones, lambda i: F.when(i < 0, F.col("key")).otherwise(F.col("key").bitwiseXOR(_bit(i))))
    seekers = table.select(F.col("b").alias("a"), "part", F.explode(either).alias("key"))
    seekers = seekers.join(heavy, ["part", "key"], "left_semi").select("a").distinct()
    one = crowd.select("b").distinct().select("b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.col("b").bitwiseXOR(_bit(i)))).alias("z"))
    centre = one.groupBy("z").agg(F.min("b").alias("b"))
    two = seekers.select("a", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    two = two.select("a", F.explode(F.transform(F.sequence("i", F.lit(64)), lambda j: F.col("a").bitwiseXOR(_bit(F.col("i"))).bitwiseXOR(F.when(j == F.col("i"), F.lit(0).cast("long")).otherwise(_bit(j))))).alias("z"))
    stars = two.join(centre, "z").filter("a != b").select("a", "b")
    return pairs.unionByName(stars).distinct()


def _high(name: str) -> Column:
    return F.shiftrightunsigned(name, 32)


def _low(name: str) -> Column:
    return F.col(name).bitwiseAND(F.lit(_LOW).cast("long"))


def _bit(i: Column) -> Column:
    """A long with bit ``i`` set; none for 64."""
    return F.when(i == 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i))
