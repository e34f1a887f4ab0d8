"""Merkle manifest of a table, its trees stored block by block in van Emde Boas order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from hourloom.llm.common import arrow_schema, ascii_lower, field, map_partition, stage

#: Children of a node.
FAN = 8
#: Levels of hashing within a block: 4096 leaves, about 150 KB.
HEIGHT = 4
DIGEST = 32
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of three documents one is tampered with in the audit.
TAMPERED = 3


# --- address arithmetic --------------------------------------------------------


def _nodes(levels: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Place in the layout of the nodes ``index`` (left to right) at ``depth`` below the root.

    A tree of ``levels`` levels is cut at half its height: first comes the upper tree, then its lower trees from left to
    right, each laid out in the same way.  A path from a leaf to the root thus touches few stretches of memory whatever
    the size of a page, and no page size is a parameter.
    """
    index = np.asarray(index, np.int64)
    base = np.zeros_like(index)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = FAN ** (depth - upper)
        base = base + _nodes(upper) + index // below * _nodes(levels - upper)
        index, depth, levels = index % below, depth - upper, levels - upper
    return base


@lru_cache(maxsize=64)
def _row(depth: int, levels: int) -> np.ndarray:
    """Addresses of all nodes at a depth."""
    return address(depth, np.arange(FAN**depth), levels)


class Block:
    """An aligned subtree; ``nodes`` holds its digests in layout order, zeros where the tree ends earlier."""

    def __init__(self, nodes: bytearray | bytes, leaves: int, height: int):
        self.nodes, self.leaves, self.height = nodes, leaves, height

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        block = cls(bytearray(DIGEST * _nodes(height + 1)), len(leaves), height)
        block._write(height, leaves)
        below = leaves
        for depth in range(height - 1, -1, -1):
            hexed = [d.hex() for d in below]
            below = [sha256("".join(hexed[i : i + FAN]).encode()).digest() for i in range(0, len(hexed), FAN)]
            block._write(depth, below)
        return block

    def _write(self, depth: int, digests: list[bytes]) -> None:
        for at, digest in zip(_row(depth, self.height + 1).tolist(), digests):
            self.nodes[DIGEST * at : DIGEST * at + DIGEST] = digest

    def at(self, depth: int) -> list[str]:
        """The digests at a depth from left to right, as hex text."""
        count = -(-self.leaves // FAN ** (self.height - depth))
        return [bytes(self.nodes[DIGEST * a : DIGEST * a + DIGEST]).hex() for a in _row(depth, self.height + 1)[:count].tolist()]

    def paths(self) -> list[tuple[list[str], list[str]]]:
        """For each leaf the texts left and right of it in its run, level by level up to the block's root."""
        lefts: list[list[str]] = [[] for _ in range(self.leaves)]
        rights: list[list[str]] = [[] for _ in range(self.leaves)]
        for up in range(self.height):
            row = self.at(self.height - up)
            sides = []
            for i in range(len(row)):
                run = i - i % FAN
                sides.append(("".join(row[run:i]), "".join(row[i + 1 : run + FAN])))
            for leaf in range(self.leaves):
                left, right = sides[leaf // FAN**up]
                lefts[leaf].append(left)
                rights[leaf].append(right)
        return list(zip(lefts, rights))


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(lefts, rights):
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


# --- trees of any number of groups ------------------------------------------------


def forest(leaves: DataFrame, root_as: str = "root", height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """``(blocks, ways)`` of one tree per ``grp``; ``leaves`` has ``grp``, ``pos`` (0, 1, ...), ``size`` and ``digest``.

    ``blocks`` holds the lowest blocks: ``grp``, ``block``, ``size`` (of the group), ``n`` (leaves here), ``height`` and
    ``nodes``.  ``ways`` has for each of them the way on from its root: ``grp``, ``block``, ``lefts``, ``rights`` and
    ``root_as``, the root of the group.  Block roots are the leaves of the next round, until every group has one block:
    a group of n leaves takes log(n) / log(8 ** height) rounds, and no task holds more than a block.
    """
    span, rounds = FAN**height, [stage(_blocks(leaves, height), "blocks")]
    largest = rounds[0].agg(F.max("size")).first()[0] or 0
    while largest > span:
        largest = -(-largest // span)
        crowded = rounds[-1].filter(F.col("size") > span)
        roots = crowded.select("grp", F.col("block").alias("pos"), F.ceil(F.col("size") / span).alias("size"), _root().alias("digest"))
        rounds.append(stage(_blocks(roots, height), "blocks"))
    none = F.array().cast("array<string>")
    ways = higher = None
    for blocks in reversed(rounds):
        top = blocks.filter(F.col("size") <= span).select("grp", "block", none.alias("lefts"), none.alias("rights"), F.lower(F.hex(_root())).alias(root_as))
        ways = stage(top if ways is None else top.unionByName(_ways(higher.join(ways, ["grp", "block"]), root_as, height)), "ways")
        higher = blocks
    return rounds[0], ways


def _root() -> Column:
    return F.substring("nodes", 1, DIGEST)  # the root comes first in the layout of any height


def _block(height: int) -> Column:
    return F.floor(F.col("pos") / FAN**height).alias("block")


def _blocks(leaves: DataFrame, most: int) -> DataFrame:
    schema = T.StructType(
        [
            field(leaves, "grp"),
            T.StructField("block", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("height", T.IntegerType()),
            T.StructField("nodes", T.BinaryType()),
        ]
    )

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        grp, block, size = (rows[c][0].as_py() for c in ("grp", "block", "size"))
        made = Block.build(rows["digest"].to_pylist(), _height(size, most))
        values = {"grp": grp, "block": block, "size": size, "n": made.leaves, "height": made.height, "nodes": bytes(made.nodes)}
        return pa.Table.from_pylist([values], arrow_schema(schema))

    return leaves.select("grp", _block(most), "pos", "size", "digest").groupBy("grp", "block").applyInArrow(run, schema)


def _height(size: int, most: int) -> int:
    """Levels of hashing of a block in a round whose group has ``size`` leaves: as many as are left, ``most`` at most."""
    height = 0
    while size > 1 and height < most:
        size, height = -(-size // FAN), height + 1
    return height


def _ways(blocks: DataFrame, root_as: str, most: int) -> DataFrame:
    """From blocks that know their own way up, that of each of their leaves, which are the blocks below."""
    text = T.ArrayType(T.StringType())
    fields = [T.StructField("lefts", text), T.StructField("rights", text), T.StructField(root_as, T.StringType())]
    schema = T.StructType([field(blocks, "grp"), T.StructField("block", T.LongType()), *fields])
    names = ("grp", "block", "n", "height", "nodes", "lefts", "rights", root_as)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for grp, block, n, height, nodes, lefts, rights, root in zip(*(batch[c] for c in names)):
                own = Block(nodes, n, height).paths()
                first = block * FAN**most
                ways = {"lefts": [a + lefts for a, _ in own], "rights": [b + rights for _, b in own]}
                yield {"grp": [grp] * n, "block": list(range(first, first + n))} | ways | {root_as: [root] * n}

    return map_partition(blocks.select(*names), run, schema)


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of a row in its ``grp`` by ``order``, and ``size``, the rows of the group.

    Rows are dealt by ranges of (group, order), so that a group may span any number of tasks; a row's place is the
    number of rows of its group in earlier ranges and its place in its own.  The dealt rows are written first, since
    both uses must see the same ranges.
    """
    own = Window.partitionBy("_part", "grp").orderBy(*order)
    dealt = rows.repartitionByRange("grp", *order).withColumn("_part", F.spark_partition_id())
    dealt = stage(dealt.withColumn("_at", F.row_number().over(own)), "dealt")
    counts = dealt.groupBy("grp", "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("grp", "_part", before.alias("_before"), F.sum("_n").over(group).alias("size"))
    joined = dealt.join(offsets, ["grp", "_part"])
    return joined.withColumn("pos", F.col("_before") + F.col("_at") - 1).drop("_part", "_at", "_before")


# --- the manifest of a table of documents ------------------------------------------


def _piece(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(columns: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_piece(columns[c]) for c in LEAF_COLUMNS]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``grp`` (the lang; null first), ``doc_id``, ``digest`` and ``tampered``, null where nothing is tampered with."""
    own = {c: F.col(c) for c in LEAF_COLUMNS}
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("")).alias("grp"),
        F.col("doc_id"),
        _leaf(own).alias("digest"),
        F.when(chosen, _leaf(own | {"text": ascii_lower(F.col("text"))})).alias("tampered"),
    )


def audit(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Each row of ``docs`` is a leaf of
    the tree of its lang, in the order of doc_id (null first; rows of one id by digest), and the langs' roots are the
    leaves of the whole tree.  The leaf is hashed again, from tampered text where crc32 of the decimal id is divisible
    by three, and folded with the stored siblings; ``verified`` says whether that gives the root.  Nulls in any column
    have a defined leaf; a null id is never tampered with.  Repeated rows are leaves of their own.  Without rows there
    is no root and no row.
    """
    rows = stage(positions(leaves(docs), ["doc_id", "digest"]), "leaves")
    blocks, ways = forest(rows, "subroot", height)
    subroots = ways.filter("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("lang"), F.unhex("subroot").alias("digest"))
    listed = stage(positions(subroots, ["lang"]), "subroots")
    tops, above = forest(listed, height=height)
    final = _ways(tops.join(above, ["grp", "block"]), "root", height).select(F.col("block").alias("pos"), F.col("lefts").alias("lefts2"), F.col("rights").alias("rights2"), "root")
    final = stage(listed.select("pos", F.col("lang").alias("grp")).join(final, "pos").drop("pos"), "lang-ways")
    whole = blocks.join(ways, ["grp", "block"]).join(final, "grp")
    whole = whole.select("grp", "block", "n", "height", "nodes", F.concat("lefts", "lefts2").alias("lefts"), F.concat("rights", "rights2").alias("rights"), "subroot", "root")
    text = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = T.StructType([field(docs, "doc_id"), *text, T.StructField("verified", T.BooleanType())])

    def run(entries: pa.Table, stored: pa.Table) -> pa.Table:
        entries, held = entries.sort_by("pos"), stored.to_pylist()[0]
        block, lefts, rights = Block(held["nodes"], held["n"], held["height"]), held["lefts"], held["rights"]
        upper = "".join(a + b for a, b in zip(lefts, rights)).encode()
        again = [None if d is None else d.hex() for d in entries["tampered"].to_pylist()]
        leaf, proofs, roots = block.at(block.height), [], []
        for own, other, (low, high) in zip(leaf, again, block.paths()):
            proof = sha256("".join(a + b for a, b in zip(low, high)).encode())
            proof.update(upper)
            proofs.append(proof.hexdigest())
            roots.append(fold(fold(own if other is None else other, low, high), lefts, rights))
        n, root = held["n"], held["root"]
        columns = [entries["doc_id"].combine_chunks(), leaf, [held["subroot"]] * n, [root] * n, proofs, roots, [r == root for r in roots]]
        wanted = arrow_schema(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wanted)], schema=wanted)

    entries = rows.select("grp", _block(height), "pos", "doc_id", "tampered").groupBy("grp", "block")
    return entries.cogroup(whole.groupBy("grp", "block")).applyInArrow(run, schema)
