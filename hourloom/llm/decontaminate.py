"""Benchmark decontamination with built-in functions only: a broadcast set of test n-grams met by training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from hourloom.llm.common import K1, K2, ascii_lower, row_key

WINDOW_WORDS = 10
#: Test windows up to which their table is sent to every executor (about 200 bytes each); beyond it both sides shuffle.
BROADCAST_WINDOWS = 250_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Words of the lower-cased text: runs of digits, a-z and anything beyond ASCII.  Null has none."""
    words = F.array_remove(F.split(ascii_lower(text), _BETWEEN), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def test_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = WINDOW_WORDS) -> DataFrame:
    """``(size, code, words, items)``: each distinct test window with the items (as strings) that hold it.

    An item shorter than a window, but not empty, is one window of its own length.
    """
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), normal_words(F.col(text_col)).alias("all"))
    rows = rows.filter(F.size("all") > 0).withColumn("size", F.least(F.size("all"), F.lit(n)))
    starts = F.explode(F.sequence(F.lit(1), F.size("all") - F.col("size") + 1)).alias("at")
    rows = rows.select("item", "size", "all", starts).withColumn("words", F.slice("all", F.col("at"), F.col("size")))
    grouped = rows.groupBy("size", "words").agg(F.collect_set(F.coalesce("item", F.lit(""))).alias("items"))
    return grouped.select("size", F.xxhash64("words").alias("code"), "words", "items")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW_WORDS) -> DataFrame:
    """Verified occurrences: ``(_hl_k1, _hl_k2, start, size, items)`` by row key, with 1-based word positions.

    Every word of every text starts a window whose hash probes the set of test windows; hits are compared word by word.
    The set is broadcast up to ``BROADCAST_WINDOWS`` (counted first); a larger one meets the windows by a shuffle.
    """
    tests = test_windows(benchmark, item_col, item_text, n)
    shape = tests.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # n rows at most
    sizes = sorted(r["size"] for r in shape) or [n]
    if sum(r["n"] for r in shape) <= BROADCAST_WINDOWS:
        tests = F.broadcast(tests)
    id_column, text_column = F.col(id_col), F.col(text_col)
    rows = docs.select(*row_key(id_column, text_column), normal_words(text_column).alias("all"))
    rows = rows.select(K1, K2, "all", F.posexplode("all").alias("before", "first"))
    one = F.lit(sizes[0]) if len(sizes) == 1 else F.explode(F.array(*map(F.lit, sizes)))
    rows = rows.select(K1, K2, "all", "before", one.alias("size")).filter(F.col("before") + F.col("size") <= F.size("all"))
    window = F.slice("all", F.col("before") + 1, F.col("size"))
    rows = rows.select(K1, K2, (F.col("before") + 1).alias("start"), "size", window.alias("own"), F.xxhash64(window).alias("code"))
    met = rows.join(tests, ["size", "code"]).filter("own = words")
    return met.select(K1, K2, "start", "size", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW_WORDS) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_hit``, ``spans`` (1-based word ranges), ``items``, ``contaminated``.

    ``n_hit`` counts words inside an occurrence of a test window, ``items`` lists the items concerned, sorted as strings.
    Null and empty texts have no words and are clean; an empty benchmark hits nothing.  Repeated rows get equal results.
    """
    found = hits(docs, benchmark, id_col, text_col, item_col, item_text, n)
    end = (F.col("start") + F.col("size") - 1).alias("end")
    per_row = found.groupBy(K1, K2).agg(
        F.array_sort(F.collect_set(F.struct("start", end))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    rows = docs.select(
        F.col(id_col), *row_key(F.col(id_col), F.col(text_col)), F.size(normal_words(F.col(text_col))).cast("long").alias("n_words")
    )
    joined = rows.join(per_row, [K1, K2], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = _merged(F.coalesce("runs", none))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"] + 1)
    out = joined.withColumn("spans", spans).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(id_col, "n_words", hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows without any occurrence of a test window, with their columns as they are."""
    found = hits(docs, benchmark, id_col, text_col, **names).select(K1, K2).distinct()
    keyed = docs.withColumns(dict(zip((K1, K2), row_key(F.col(id_col), F.col(text_col)))))
    return keyed.join(found, [K1, K2], "left_anti").drop(K1, K2)


def _merged(runs: Column) -> Column:
    """Sorted ranges, with those that overlap made one."""

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (run["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, F.array().cast("array<struct<start:int,end:int>>"), add)
