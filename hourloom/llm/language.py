"""Language of words in mixed text by a linear-chain conditional random field."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import field, id_text, map_batches, map_partition, slices
from hourloom.llm.toxicity import held_out

#: Bounds of the training sample: texts of each language, passages of a text and words of a passage.
TEXTS, PASSAGES, PASSAGE_WORDS = 400, 2, 40
FEATURE_BITS = 16
LEXICON_WORDS = 300
EPOCHS, RATE = 6, 0.3
CHAIN = 64
UNIT_CHARS = 40
AFFIXES = (1, 2, 3, 4)
MEMO_WORDS = 200_000
BATCH_CHARS = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of distinct words, one word after the other, and their number for each word.

    The word, its first and last bytes in UTF-8, the language in whose lexicon it is, and all 2- and 3-grams of bytes;
    two zero bytes between words stand for the edge of a word in the n-grams.
    """
    low = [w.lower() for w in words]
    raw = [w.encode("utf-8", "surrogatepass") for w in low]
    text = np.frombuffer(b"\0\0" + b"\0\0".join(raw) + b"\0\0" + bytes(max(AFFIXES)), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raw], np.int64)
    firsts = np.cumsum(sizes + 2) - sizes
    whole = np.array([zlib.crc32(r) for r in raw], np.uint64)
    listed = np.array([lexicon.get(w, -1) + 1 for w in low], np.uint64)
    fixed, head, tail, none = [_code(whole, 1), _code(listed, 2)], np.zeros_like(whole), np.zeros_like(whole), np.uint64(0)
    for i in range(max(AFFIXES)):
        head = head << np.uint64(8) | np.where(i < sizes, text[firsts + i], none)
        tail = tail << np.uint64(8) | np.where(i < sizes, text[firsts + np.maximum(sizes - 1 - i, 0)], none)
        if i + 1 in AFFIXES:
            fixed += [_code(head, 10 + i), _code(tail, 20 + i)]
    total = len(text) - 2 - max(AFFIXES)
    last, before = text[2 : 2 + total], text[1 : 1 + total]
    two = before << np.uint64(8) | last
    counts = len(fixed) + 2 * (sizes + 2)
    at = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int64)
    for i, codes in enumerate(fixed):
        flat[at + i] = codes
    place = np.repeat(at + len(fixed) - 2 * (firsts - 2), sizes + 2) + 2 * np.arange(total)
    flat[place], flat[place + 1] = _code(two, 3), _code(text[:total] << np.uint64(16) | two, 4)
    return flat, counts


def _code(value: np.ndarray, kind: int) -> np.ndarray:
    return ((value + np.uint64(kind << 40)) * _FACTOR >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def words_of(text: str | None) -> list[str]:
    """Words with a letter, parted by white space; a longer word, as in scripts without spaces, is several units."""
    words = (text or "").split()
    if max(map(len, words), default=0) > UNIT_CHARS:
        words = [w[i : i + UNIT_CHARS] for w in words for i in range(0, len(w), UNIT_CHARS)]
    return [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def _emissions(words: list[str], weights: np.ndarray, lexicon: dict) -> np.ndarray:
    flat, sizes = features(words, lexicon)
    return np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes) / np.sqrt(sizes, dtype=weights.dtype)[:, None]


def marginals(emissions: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over a batch of chains: the probability of each label at each word, and expected transitions."""
    n, steps, k = emissions.shape
    local = np.exp(emissions - emissions.max(2, keepdims=True))
    move = np.exp(transitions)
    ahead, behind = np.empty_like(local), np.empty_like(local)
    now = local[:, 0] / local[:, 0].sum(1, keepdims=True)
    ahead[:, 0] = now
    for t in range(1, steps):
        new = (now @ move) * local[:, t]
        now = np.where(mask[:, t, None], new / new.sum(1, keepdims=True), now)
        ahead[:, t] = now
    back = np.full((n, k), 1.0 / k)
    behind[:, -1] = back
    for t in range(steps - 2, -1, -1):
        new = (back * local[:, t + 1]) @ move.T
        back = np.where(mask[:, t + 1, None], new / new.sum(1, keepdims=True), back)
        behind[:, t] = back
    each = ahead * behind
    each /= each.sum(2, keepdims=True)
    pairs = np.einsum("nti,ij,ntj->ntij", ahead[:, :-1], move, local[:, 1:] * behind[:, 1:])
    pairs /= pairs.sum((2, 3), keepdims=True)
    return each * mask[:, :, None], (pairs * mask[:, 1:, None, None]).sum((0, 1))


def _label_marginals(emissions: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The labels' part of ``marginals``, without the transitions' memory."""
    steps, k = emissions.shape[1:]
    local = np.exp(emissions - emissions.max(2, keepdims=True))
    move = np.exp(transitions)
    ahead = np.empty_like(local)
    now = local[:, 0] / local[:, 0].sum(1, keepdims=True)
    ahead[:, 0] = now
    for t in range(1, steps):
        new = (now @ move) * local[:, t]
        now = np.where(mask[:, t, None], new / new.sum(1, keepdims=True), now)
        ahead[:, t] = now
    back = np.full(now.shape, 1.0 / k, local.dtype)
    for t in range(steps - 2, -1, -1):
        new = (back * local[:, t + 1]) @ move.T
        back = np.where(mask[:, t + 1, None], new / new.sum(1, keepdims=True), back)
        ahead[:, t] *= back
    ahead /= ahead.sum(2, keepdims=True)
    return ahead * mask[:, :, None]


def fit(passages: list[list[str]], labels: list[str], seed: int = 1) -> dict:
    """The field from passages of one language each; a third of the chains are two passages of any languages in a row."""
    names = sorted(set(labels))
    if not names:
        return {"names": [], "weights": None, "transitions": None, "lexicon": {}}
    rng, k = np.random.default_rng(seed), len(names)
    counts = [Counter() for _ in names]
    for words, label in zip(passages, labels):
        counts[names.index(label)].update(w.lower() for w in words)
    total = sum(counts, Counter())
    lexicon = {w: j for j, own in enumerate(counts) for w, n in own.most_common(LEXICON_WORDS) if n >= 3 and 2 * n > total[w]}
    distinct = {w: i for i, w in enumerate(sorted({w for p in passages for w in p}))}
    flat, sizes = features(list(distinct), lexicon) if distinct else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    found = np.split(flat, np.cumsum(sizes)[:-1])
    codes = [np.array([distinct[w] for w in p]) for p in passages]
    gold = [names.index(x) for x in labels]
    weights, transitions = np.zeros((1 << FEATURE_BITS, k)), np.eye(k)
    seen, seen_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(passages))
        for a in range(0, len(order), 64):
            chains = [(codes[i], np.full(len(codes[i]), gold[i])) for i in order[a : a + 64]]
            for j in range(0, len(chains) - 1, 3):
                chains[j] = tuple(np.concatenate(x) for x in zip(chains[j], chains[j + 1]))
            steps = max(len(c) for c, _ in chains)
            table, mask, want = np.zeros((len(chains), steps), np.int64), np.zeros((len(chains), steps), bool), np.zeros((len(chains), steps), np.int64)
            for i, (c, y) in enumerate(chains):
                table[i, : len(c)], mask[i, : len(c)], want[i, : len(c)] = c, True, y
            used, table = np.unique(table, return_inverse=True)
            table = table.reshape(mask.shape)
            own = [found[i] for i in used]
            sizes, flat = np.array([len(f) for f in own]), np.concatenate(own)
            emissions = np.add.reduceat(weights[flat], np.concatenate(([0], np.cumsum(sizes)[:-1]))) / np.sqrt(sizes)[:, None]
            each, moves = marginals(emissions[table], mask, transitions)
            slope = each - np.eye(k)[want] * mask[:, :, None]
            per_word = np.zeros((len(used), k))
            np.add.at(per_word, table.ravel(), slope.reshape(-1, k))
            spread = np.repeat(per_word / np.sqrt(sizes)[:, None], sizes, 0)
            g = np.stack([np.bincount(flat, spread[:, j], 1 << FEATURE_BITS) for j in range(k)], 1) + 1e-4 * weights
            step_gold = np.zeros((k, k))
            np.add.at(step_gold, (want[:, :-1][mask[:, 1:]], want[:, 1:][mask[:, 1:]]), 1)
            g_t = moves - step_gold
            seen += g * g
            seen_t += g_t * g_t
            weights -= RATE * g / np.sqrt(seen)
            transitions -= RATE * g_t / np.sqrt(seen_t)
    return {"names": names, "weights": weights.astype(np.float32), "transitions": transitions.astype(np.float32), "lexicon": lexicon}


class Memo:
    """Emissions of words seen before, up to a bound."""

    def __init__(self, model: dict):
        self.model, self.place, self.rows = model, {}, None

    def table(self, words: list[str]) -> np.ndarray:
        """A row of emissions per word."""
        if self.rows is None or len(self.place) > MEMO_WORDS:
            self.place, self.rows = {}, np.zeros((0, len(self.model["names"])), np.float32)
        new = [w for w in words if w not in self.place]
        made = [_emissions(new[a : a + 8192], self.model["weights"], self.model["lexicon"]) for a in range(0, len(new), 8192)]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.rows = np.concatenate([self.rows, *made]).astype(np.float32)
        return self.rows[[self.place[w] for w in words]]


def label_texts(texts: list[str | None], model: dict, memo: Memo | None = None) -> list[tuple[str, float]]:
    """The language with the largest mean probability over the words of each text, and that mean."""
    memo = memo or Memo(model)
    names, split = model["names"], [words_of(t) for t in texts]
    words = [w for own in split for w in own]
    if not words or not names:
        return [("und", 0.0)] * len(texts)
    codes, distinct = pd.factorize(np.array([*words, None], object)[:-1])
    emissions = memo.table(list(distinct))
    sizes = np.array([len(s) for s in split])
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    starts = np.array([s for a, n in zip(firsts.tolist(), sizes.tolist()) for s in range(a, a + n, CHAIN)])
    owner = np.searchsorted(firsts[1:], starts, "right")
    sums = np.zeros((len(texts), len(names)))
    for a in range(0, len(starts), 2048):
        steps = starts[a : a + 2048, None] + np.arange(CHAIN)
        mask = steps < firsts[owner[a : a + 2048] + 1][:, None]
        each = _label_marginals(emissions[codes[np.minimum(steps, len(codes) - 1)]], mask, model["transitions"])
        np.add.at(sums, owner[a : a + 2048], each.sum(1, dtype=np.float64))
    means = sums / np.maximum(sizes, 1)[:, None]
    best = means.argmax(1)
    return [(names[j], float(min(1.0, means[i, j]))) if sizes[i] else ("und", 0.0) for i, j in enumerate(best)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Fit on a bounded sample of rows with a language, outside the held-out part (crc32 of the id mod 3 = 1).

    About ``TEXTS`` texts of each language, however rare, chosen by a hash of the id; of each up
    to ``PASSAGES`` passages of ``PASSAGE_WORDS`` words, spread over the text, are cut out where the text lies.
    """
    rows = docs.select(F.col(id_col).alias("_hl_id"), F.col(text_col).alias("_hl_text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("_hl_text").isNotNull() & F.col("_hl_id").isNotNull() & ~held_out(F.col("_hl_id"), 3, 1))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return fit([], [])
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, TEXTS / r["n"])))])
    order = F.xxhash64(F.lit("sample"), F.col("_hl_id").cast("string"))
    rows = rows.withColumn("o", order).filter(F.pmod("o", F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")) * 1_000_000)
    schema = T.StructType([T.StructField("o", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def passages(batch: dict) -> Iterator[dict]:
        out: dict[str, list] = {"o": [], "lang": [], "words": []}
        for text, lang, o in zip(batch["_hl_text"], batch["lang"], batch["o"]):
            words = words_of(text)
            spread = max(PASSAGE_WORDS, len(words) // PASSAGES)
            for a in range(0, min(len(words), spread * PASSAGES), spread):
                for column, value in zip(out.values(), (o, lang, words[a : a + PASSAGE_WORDS])):
                    column.append(value)
        yield out

    sample = map_batches(rows.select("_hl_text", "lang", "o"), passages, schema)
    sample = sample.orderBy("o", "lang", "words").limit(2 * PASSAGES * TEXTS * len(counts)).collect()
    return fit([r["words"] for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, ``held_out``, ``lang_pred`` and ``score``.

    Every word of the whole text is labelled in chains of ``CHAIN`` words; the text gets the language with the largest
    mean probability, which is the score.  ``und`` with score 0 for null texts, texts without a letter, and where no row
    has a language to learn from.
    """
    model = train(docs, id_col, text_col, lang_col)
    rows = id_text(docs, id_col, text_col)
    schema = T.StructType([field(rows, "_hl_id", id_col), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        memo = Memo(model)
        for batch in batches:
            texts = batch["_hl_text"]
            for a, b in slices([t or "" for t in texts], BATCH_CHARS):
                found = label_texts(texts[a:b], model, memo)
                yield {id_col: batch["_hl_id"][a:b], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_partition(rows, run, schema).select(id_col, held_out(F.col(id_col), 3, 1).alias("held_out"), "lang_pred", "score")
