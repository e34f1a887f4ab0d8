"""Near copies by the similarity of their word shingles: SetSketch registers find candidates, full sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from hourloom.llm.common import K1, K2, id_text, map_batches, row_key, stage, to_bytes
from hourloom.llm.components import components

SHINGLE_WORDS = 5
#: Two texts link if their sets share this part of what they hold together.
SIMILAR = (85, 100)
#: Two sets of similarity 0.85 miss each other in every band twice in 100 million pairs, of 0.8 once in 100,000.
BANDS, BAND_ROWS = 30, 5
REGISTERS = BANDS * BAND_ROWS
#: Scale of the registers: neighbouring values differ by this factor, and a register is one of 65536.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: A candidate is not verified if the likeliest similarity is below the bound and e ** 16 times as likely as the bound.
CERTAIN = 16.0
#: Sets that share a difference are compared in pairs up to this many; more start a round of their own.
PAIRED = 32
SEED = 42
AT_ONCE = 1 << 10
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (REGISTERS, 1), np.uint64) | np.uint64(1)
_GRID = np.linspace(0.0, 1.0, 201)


# --- sketches ------------------------------------------------------------------


def shingles(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the set of shingles; a text of fewer words is one shingle, one without words none."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    ends = ends[size - 1 :] or ends[-1:]
    hashes = b"".join([xxhash.xxh64_digest(joined[i:j], SEED) for i, j in zip(starts, ends)])
    return np.unique(np.frombuffer(hashes, "<u8"))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Each register is the least of one exponential value per element, on a logarithmic scale and cut off at both ends.

    The least value only grows smaller with more elements, so the sketch of a union is the larger value of each register.
    """
    least = np.full(REGISTERS, ~np.uint64(0))
    for a in range(0, len(hashes), AT_ONCE):
        np.minimum(least, (_FACTORS * hashes[a : a + AT_ONCE]).min(1), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE if len(hashes) else np.full(REGISTERS, np.inf)
    with np.errstate(divide="ignore", over="ignore"):
        return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def bands(sketch: np.ndarray) -> list[int]:
    """One key per band of registers; sets of similarity s share a given one with probability of about s ** 5."""
    return [_signed(xxhash.xxh64_intdigest(r.tobytes(), i)) for i, r in enumerate(sketch.reshape(BANDS, BAND_ROWS))]


def _signed(hashed: int) -> int:
    return hashed - (1 << 64) if hashed >> 63 else hashed


def similarity(larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest similarity of pairs of sets, and by how much its log likelihood exceeds that of ``bound``.

    ``larger`` counts the registers in which the first set's value is the larger one, ``smaller`` those in which it is
    the smaller one; ``n`` and ``m`` are the sizes.  With u and v the shares of the sizes, a register is larger with
    probability p(u - vJ), smaller with p(v - uJ) and equal else, where p(x) = -log_b(1 - x (b - 1) / b).
    """
    u = (n / (n + m))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def likelihood(j):
        above = -np.log1p(-np.clip(u - v * j, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        below = -np.log1p(-np.clip(v - u * j, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        counts = (larger[:, None], smaller[:, None], (REGISTERS - larger - smaller)[:, None])
        return sum(np.where(c > 0, c * np.log(np.maximum(p, 1e-12)), 0.0) for c, p in zip(counts, (above, below, 1 - above - below)))

    tried = likelihood(np.minimum(_GRID, most))
    best = tried.argmax(1)
    at = np.arange(len(best))
    return np.minimum(_GRID[best], most[:, 0]), tried[at, best] - likelihood(np.minimum(bound, most))[:, 0]


def sketches(rows: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``_hl_text`` gives way to ``fp`` (128-bit digest of the shingle set), ``n`` (its size), ``registers`` and ``bands``."""
    rest = [f for f in rows.schema.fields if f.name != "_hl_text"]
    kinds = (("fp", T.BinaryType()), ("n", T.LongType()), ("registers", T.BinaryType()), ("bands", T.ArrayType(T.LongType())))
    made = [T.StructField(*k) for k in kinds]

    def run(batch: dict) -> Iterator[dict]:
        out: dict[str, list] = {f.name: [] for f in made}
        for text in batch["_hl_text"]:
            found = shingles(to_bytes(text), size)
            sketch = registers(found)
            for column, value in zip(out.values(), (xxhash.xxh3_128_digest(found.tobytes()), len(found), sketch.tobytes(), bands(sketch))):
                column.append(value)
        yield {f.name: batch[f.name] for f in rest} | out

    return map_batches(rows, run, T.StructType([*rest, *made]))


def shingle_sets(rows: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(fp, shingles)`` from ``(fp, _hl_text)``."""

    def run(batch: dict) -> Iterator[dict]:
        yield {"fp": batch["fp"], "shingles": [shingles(to_bytes(t), size).view(np.int64) for t in batch["_hl_text"]]}

    schema = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return map_batches(rows.select("fp", "_hl_text"), run, schema)


# --- links ---------------------------------------------------------------------


def classes(found: DataFrame, rows: DataFrame, similar: tuple[int, int] = SIMILAR, pairs: DataFrame | None = None, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(fp, root)`` of every set that links of ``similar`` or more connect with another one.

    ``found`` has ``fp``, ``n``, ``registers``, ``bands`` and the row key, ``rows`` the row key and ``_hl_text``.  More
    candidates may come as ``pairs`` of ``(a, b)``.
    """
    of_set = [F.first(c).alias(c) for c in ("n", "registers", "bands")]
    distinct = stage(found.filter("n > 0").groupBy("fp").agg(F.min(F.struct(K1, K2)).alias("row"), *of_set), "distinct")
    buckets = distinct.select("fp", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stage(buckets.join(stage(shared, "shared"), "key"), "members")
    crowd = members.groupBy("fp").agg(F.sum("size").alias("crowd"))
    wanted = members.select("fp")
    if pairs is not None:
        wanted = wanted.unionByName(pairs.select(F.col("a").alias("fp"))).unionByName(pairs.select(F.col("b").alias("fp")))
    chosen = distinct.join(wanted.distinct(), "fp", "left_semi").select("fp", f"row.{K1}", f"row.{K2}")
    sets = shingle_sets(rows.join(chosen, [K1, K2]).dropDuplicates([K1, K2]), size)
    sets = stage(sets.join(distinct.select("fp", "n", "registers"), "fp").join(crowd, "fp", "left"), "sets")
    return linked(members.select("key", "fp"), sets, similar, pairs)


def linked(buckets: DataFrame, sets: DataFrame, similar: tuple[int, int] = SIMILAR, pairs: DataFrame | None = None) -> DataFrame:
    """``(fp, root)``: components of the links among the members of each bucket, without forming all pairs of a bucket.

    Every member of a bucket is compared with one centre.  A bucket that this does not connect is a group, and goes on
    by what its members have of their own.  Let V be the group's consensus (what over half of its members hold), D(x)
    the shingles in only one of x and V, and f(x) = |D(x)| - t |x| with t = (1 - s) / (1 + s).  Sets link if at most
    t (|x| + |y|) shingles are in only one of them, which are |D(x)| + |D(y)| less twice what D(x) and D(y) share.  Let c
    be the member with the least f.  If x does not link with c, then f(x) + f(c) > 0 (what they share only adds to it),
    so for any y the sum f(x) + f(y) is positive too, and x and y can link only if D(x) and D(y) share over half of it.
    So x and y meet in a bucket of a shared difference:

    * a shingle that both hold and V does not (every member is filed under all of these), or
    * one that V holds and both lack.  If they share none of the first kind, then over (f(y) - f(c)) / 2 of those that y
      lacks are lacking in x.  So y is filed under as many of them as may have to be tried, and x under all, unless even
      sharing all of y's would not do.

    At most half of a group meets in such a bucket, since what more than half hold belongs to V, so the rounds end.  Buckets of up to
    ``PAIRED`` sets are compared in pairs, larger ones start again, at most log(size) times.  Copies that were changed in
    different places share no such difference, so nearly all groups end after the first round.
    """
    num, den = similar
    t = (den - num) / (den + num)
    edges, first = None, True
    if pairs is not None:
        edges = _links(pairs.filter("a != b").select(F.col("a").alias("c"), F.col("b").alias("fp")), sets, similar)
    while True:
        most = F.max(F.struct("crowd", "fp"))["fp"].alias("c")
        ranked = buckets.join(sets.select("fp", F.coalesce("crowd", F.lit(0)).alias("crowd")), "fp")
        centres = ranked.groupBy("key").agg(most, (F.count(F.lit(1)) > 2).alias("more"))
        centres = stage(centres, "centres")
        stars = buckets.join(centres, "key").filter("fp != c").groupBy("c", "fp").agg(F.max("more").alias("more"))
        met = stage(compared(stars, sets, similar), "compared")
        new = met.filter("linked").select(F.col("c").alias("a"), F.col("fp").alias("b"))
        roots = components(new if edges is None else new.unionByName(edges))
        edges = roots.select(F.col("fp").alias("a"), F.col("root").alias("b"))
        if first:  # the bands of one centre are one group
            placed, first = met.filter("more").withColumn("key", F.xxhash64("c")), False
        else:
            places = buckets.join(centres, "key").filter("more").select("key", "c", "fp")
            placed = met.join(places, ["c", "fp"])
        group = _apart(placed, roots)
        if group.isEmpty():
            return roots
        group, second = _around_consensus(group, sets, similar, t)
        filed = stage(_filed(group, t), "filed")
        bounds = [F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.when(F.col("alone"), F.col("f"))).alias("least"), F.max("reach").alias("reach")]
        held = filed.groupBy("key").agg(F.count_distinct("fp").alias("size"), *bounds)
        held = stage(held.filter("low < high and least <= reach + 1e-9").select("key", "size"), "held")
        few = stage(filed.join(held.filter(F.col("size") <= PAIRED), "key").drop("size").distinct(), "few")
        other = few.select("key", *[F.col(x).alias(f"_{x}") for x in ("fp", "root", "f", "reach")])
        meets = (F.col("root") != F.col("_root")) & (F.col("f") <= F.col("_reach") + 1e-9) & (F.col("_f") <= F.col("reach") + 1e-9)
        tried = few.filter("alone").join(other, "key").filter(meets)
        tried = tried.select(F.greatest("_fp", "fp").alias("c"), F.least("_fp", "fp").alias("fp")).distinct()
        edges = edges.unionByName(second).unionByName(_links(tried, sets, similar))
        buckets = stage(filed.join(held.filter(F.col("size") > PAIRED), "key").select("key", "fp").distinct(), "buckets")
        if buckets.isEmpty():
            return components(edges)


def _links(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs ``(c, fp)`` that link, as ``(a, b)``."""
    found = compared(pairs.withColumn("more", F.lit(False)), sets, similar).filter("linked")
    return stage(found.select(F.col("c").alias("a"), F.col("fp").alias("b")), "edges")


def _apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the groups (``key``) whose members are in several components, with their ``root``."""
    rows = met.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    return stage(rows.join(stage(several.filter("low < high").select("key", "size"), "several"), "key"), "apart")


def _around_consensus(group: DataFrame, sets: DataFrame, similar: tuple[int, int], t: float) -> tuple[DataFrame, DataFrame]:
    """Members and old centre of each group with their differences from the consensus: what they ``hold`` and ``miss``,
    ``f``, the least f of the group (``f_c``) and ``alone`` (no link with the member of least f); and new links."""
    none = F.array().cast("array<bigint>")
    each = group.select("key", "size", F.explode(F.concat(_tagged("adds", True), _tagged("lacks", False))).alias("d"))
    common = each.groupBy("key", "d").agg(F.count(F.lit(1)).alias("holders"), F.first("size").alias("size")).filter(2 * F.col("holders") > F.col("size") + 1)
    gained, lost = (F.collect_list(F.when(F.col("d.added") == x, F.col("d.e"))) for x in (True, False))
    common = stage(common.groupBy("key").agg(gained.alias("gained"), lost.alias("lost")), "consensus")
    centre = group.select("key", "c").distinct().join(sets.select(F.col("fp").alias("c"), "n"), "c")
    lone = centre.join(_root_of(group), "c").select("key", "c", F.col("c").alias("fp"), "n", "root", none.alias("adds"), none.alias("lacks"), F.lit(True).alias("linked"))
    rows = group.select("key", "c", "fp", "n", "root", "adds", "lacks", "linked").unionByName(lone).join(common, "key", "left")
    gained, lost = F.coalesce("gained", none), F.coalesce("lost", none)
    holds = F.concat(F.array_except("adds", gained), F.array_except(lost, F.col("lacks")))
    misses = F.concat(F.array_except("lacks", lost), F.array_except(gained, F.col("adds")))
    rows = rows.select("key", "c", "fp", "n", "root", "linked", holds.alias("holds"), misses.alias("misses"))
    rows = stage(rows.withColumn("f", F.size("holds") + F.size("misses") - t * F.col("n")), "differences")
    best = F.min(F.struct("f", "fp"))
    best = stage(rows.groupBy("key").agg(best["f"].alias("f_c"), best["fp"].alias("best")), "best")
    rows = rows.join(best, "key")
    again = rows.filter("best != c and best != fp").select(F.col("best").alias("c"), "fp").distinct()
    new = _links(again, sets, similar)
    rows = rows.join(new.select(F.col("a").alias("best"), F.col("b").alias("fp"), F.lit(True).alias("_near")), ["best", "fp"], "left")
    near = F.when(F.col("best") == F.col("c"), F.col("linked")).otherwise((F.col("best") == F.col("fp")) | F.col("_near").isNotNull())
    return stage(rows.withColumn("alone", ~near).drop("_near", "linked", "best"), "group"), new


def _root_of(group: DataFrame) -> DataFrame:
    """The component of each centre: that of a member it links with, else its own."""
    found = group.filter("linked").groupBy("c").agg(F.first("root").alias("root"))
    return group.select("c").distinct().join(found, "c", "left").withColumn("root", F.coalesce("root", "c"))


def _tagged(column: str, added: bool) -> Column:
    return F.transform(column, lambda e: F.struct(F.lit(added).alias("added"), e.alias("e")))


def _filed(group: DataFrame, t: float) -> DataFrame:
    """``(key, fp, root, alone, f, reach)``: the buckets of shared differences that each member is filed under.

    Two members of a bucket can only link if the f of each is at most the ``reach`` of the other: twice what they can
    share, less the other's f.  For a difference that V holds that is what the other misses, as pairs that share one of
    the other kind meet there.
    """
    held, missing = F.size("holds"), F.size("misses")
    rows = group.withColumns({"by_miss": 2 * missing - F.col("f"), "by_hold": 2 * (missing + held) - F.col("f")})
    rows = rows.join(stage(rows.groupBy("key").agg(F.max("by_miss").alias("most")), "most"), "key")
    tried = F.greatest(F.lit(0), missing - F.floor((F.col("f") - F.col("f_c")) / 2 - 1e-9)).cast("int")
    all_of = F.col("alone") & (F.col("f") <= F.col("most") + 1e-9)
    missed = F.when(all_of, F.col("misses")).otherwise(F.slice(F.array_sort("misses"), 1, tried))
    kinds = [F.transform(c, lambda e: F.struct(e.alias("e"), F.col(reach).alias("reach"))) for c, reach in (("holds", "by_hold"), (missed, "by_miss"))]
    rows = rows.select("key", "fp", "root", "alone", "f", F.explode(F.concat(*kinds)).alias("d"))
    return rows.select(F.xxhash64("key", "d.e").alias("key"), "fp", "root", "alone", "f", "d.reach")


def compared(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs ``(c, fp, more)`` with ``n`` of fp, ``linked`` and, where more members of the bucket wait, the shingles that
    fp ``adds`` to c and ``lacks`` of it.

    A pair that nobody else waits for is dropped unseen if the sizes or the registers rule it out.
    """
    num, den = similar
    one = sets.select("fp", "n", "registers")
    two = sets.select(F.col("fp").alias("c"), F.col("n").alias("m"), F.col("registers").alias("other"))
    judged = stage(_plausible(pairs.join(two, "c").join(one, "fp"), num / den), "plausible")
    full = judged.join(sets.select(F.col("fp").alias("c"), F.col("shingles").alias("_c")), "c")
    full = full.join(sets.select("fp", F.col("shingles").alias("_x")), "fp")
    both = F.size(F.array_intersect("_c", "_x"))
    none = F.array().cast("array<bigint>")
    return full.select(
        "c",
        "fp",
        "more",
        "n",
        (den * both >= num * (F.col("n") + F.col("m") - both)).alias("linked"),
        F.when(F.col("more"), F.array_except("_x", "_c")).otherwise(none).alias("adds"),
        F.when(F.col("more"), F.array_except("_c", "_x")).otherwise(none).alias("lacks"),
    )


def _plausible(pairs: DataFrame, bound: float) -> DataFrame:
    schema = T.StructType([pairs.schema[c] for c in ("c", "fp", "more", "n", "m")])

    def run(batch: dict) -> Iterator[dict]:
        if not batch["fp"]:
            return
        a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, REGISTERS) for c in ("registers", "other"))
        n, m = (np.array(batch[c], np.float64) for c in ("n", "m"))
        best, sure = similarity((a > b).sum(1), (a < b).sum(1), n, m, bound)
        possible = (np.minimum(n, m) >= bound * np.maximum(n, m) - 1e-6) & ~((best < bound) & (sure > CERTAIN))
        keep = np.flatnonzero(possible | np.array(batch["more"], bool)).tolist()
        yield {f.name: [batch[f.name][i] for i in keep] for f in schema}

    return map_batches(pairs, run, schema)


# --- operators -----------------------------------------------------------------


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` (id = that one).

    A text with fewer than five words is one shingle; a null text or one without words has none and links with nothing.
    Texts of equal sets link.  A null id is larger than any other, so a component of null ids only has a null id, and
    its rows count as kept.  Repeated rows fall into one component.
    """
    rows = id_text(docs, id_col, text_col)
    rows = rows.select(*row_key(F.col("_hl_id"), F.col("_hl_text")), "_hl_id", "_hl_text")
    found = stage(sketches(rows), "sketches")
    roots = classes(found, rows, similar)
    members = found.filter("n > 0").groupBy("fp").agg(F.min("_hl_id").alias("least")).join(roots, "fp", "left")
    members = stage(members.withColumn("root", F.coalesce("root", "fp")), "members")
    of_root = members.groupBy("root").agg(F.min("least").alias("component"))
    named = members.join(of_root, "root").select("fp", "component")
    joined = found.select("_hl_id", "fp", "n").join(stage(named, "named"), "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_hl_id"))
    return joined.select(
        F.col("_hl_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_hl_id").eqNullSafe(component).alias("kept"),
    )
