"""URL filter: explicit rules first, then naive Bayes over the words of segmented hosts and paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import ascii_lower, map_batches, stage

#: (verdict, host and path): fits the host and its subdomains where the path begins like the rule's.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words that mark an address as unwanted when the classifier is fitted; a fixed parameter.
SEEDS = ("ads", "adserver", "adult", "bet", "bets", "betting", "bonus", "casino", "cheap", "escort", "gambling", "jackpot", "loan", "lottery", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx")
MAX_WORD = 20


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty for null or without ``://``."""
    parts = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)([^?#]*)", 2)
    return ascii_lower(parts), path


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null."""
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        site, slash, start = rule.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(slash + start)
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(chosen)
    return chosen


def unigrams(texts: DataFrame, text_col: str) -> DataFrame:
    """``(word, n)`` over all texts: runs of a-z of up to ``MAX_WORD`` letters, in lower case."""
    words = F.split(ascii_lower(F.col(text_col)), r"[^a-z]+")
    rows = texts.select(F.explode(words).alias("word")).filter(F.length("word").between(1, MAX_WORD))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segmented(hosts: DataFrame, lexicon: DataFrame, seeds=()) -> DataFrame:
    """``(host, words)`` for distinct hosts: each run of letters split by unigram Viterbi.

    Seed words count as words of the lexicon, once in 100,000 words at least.

    Only the substrings of hosts meet the lexicon, by a join, so neither side has to fit anywhere.
    """
    total = lexicon.agg(F.sum("n")).first()[0] or 1
    least = dict.fromkeys(seeds, total // 100_000 + 1)
    runs = F.explode(F.array_distinct(F.split("host", r"[^a-z]+"))).alias("run")
    names = stage(hosts.select("host", runs).filter("run != ''"), "names")
    ends = F.sequence(F.col("i"), F.least(F.col("i") + (MAX_WORD - 1), F.length("run")))
    cuts = names.select("run").distinct().select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    cuts = cuts.select("run", F.explode(F.transform(ends, lambda j: F.col("run").substr(F.col("i"), j - F.col("i") + 1))).alias("word")).distinct()
    known = cuts.join(lexicon, "word", "left").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    schema = T.StructType([T.StructField("run", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def split(batch: dict) -> Iterator[dict]:
        counts = [least | {k["word"]: max(k["n"], least.get(k["word"], 0)) for k in known if k["n"]} for known in batch["known"]]
        yield {"run": batch["run"], "words": [viterbi(run, own, total) for run, own in zip(batch["run"], counts)]}

    words = map_batches(known, split, schema)
    return names.join(words, "run").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))


def viterbi(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split into words; an unknown word costs ten times more for each of its letters."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = []
        for start in range(max(0, end - MAX_WORD), end):
            n = counts.get(run[start:end], 0)
            cost = math.log(total / n) if n else math.log(total) + (end - start) * math.log(10.0)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    words, end = [], len(run)
    while end:
        start = best[end][1]
        words.append(run[start:end])
        end = start
    return words[::-1]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str | None = "html", rules=RULES, seeds=SEEDS) -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule``, ``log_odds`` and ``verdict``.

    The longest rule that fits decides.  Without a rule a multinomial naive Bayes classifier does: words of the
    segmented host and of the path, counted over all pages, with pages that hold a seed word as the blocked class;
    positive log odds block.  The lexicon of the segmentation is counted over ``text_col`` of all pages.  Null and odd
    urls have empty parts and no words, so the prior decides; repeated rows count and are judged each.
    """
    host, path = address(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_hl_id"), host.alias("host"), path.alias("path"))
    shape = F.regexp_replace(ascii_lower(F.col("path")), r"[0-9]+", "0").alias("shape")
    kinds = stage(rows.select("host", shape).groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")), "addresses")
    lexicon = stage(unigrams(pages, url_col if text_col is None else text_col), "lexicon")
    words = segmented(kinds.select("host").distinct(), lexicon, seeds)
    of_path = F.filter(F.split("shape", r"[^a-z0-9]+"), lambda w: w != "")
    every = F.concat(F.coalesce("words", F.array().cast("array<string>")), of_path).alias("words")
    kinds = kinds.join(words, "host", "left").select("host", "shape", "n", every)
    bad = F.coalesce(F.arrays_overlap("words", F.array(*map(F.lit, seeds))), F.lit(False))
    kinds = stage(kinds.withColumn("bad", bad.cast("long")), "worded")
    tokens = kinds.select(F.explode("words").alias("word"), "n", "bad")
    counts = tokens.groupBy("word").agg(F.sum(F.col("n") * F.col("bad")).alias("b"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("a"))
    sums = counts.agg(F.sum("b"), F.sum("a"), F.count(F.lit(1))).first()
    classes = kinds.agg(F.sum(F.col("n") * F.col("bad")), F.sum("n")).first()
    n_bad, n_good, size = sums[0] or 0, sums[1] or 0, sums[2] or 1
    prior = math.log(((classes[0] or 0) + 1) / ((classes[1] or 0) - (classes[0] or 0) + 1))
    weight = F.log((F.col("b") + 1) / float(n_bad + size)) - F.log((F.col("a") + 1) / float(n_good + size))
    scored = kinds.select("host", "shape", F.explode("words").alias("word")).join(counts.select("word", weight.alias("w")), "word")
    scored = scored.groupBy("host", "shape").agg(F.round(F.sum("w") + F.lit(prior), 9).alias("log_odds"))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    joined = rows.withColumn("shape", shape).join(scored, ["host", "shape"], "left").withColumn("found", rule)
    odds = F.coalesce("log_odds", F.lit(prior))
    verdict = F.coalesce("found.verdict", F.when(odds > 0, "block").otherwise("allow"))
    return joined.select(F.col("_hl_id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), odds.alias("log_odds"), verdict.alias("verdict"))
