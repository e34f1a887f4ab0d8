"""Quality rules on repetition: how much of a text lies inside n-grams and lines that it repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hourloom.llm.common import field, id_text, map_batches, slices, to_bytes

#: Largest share of a text's word characters that may lie in repeated n-grams, by words per n-gram.
COVERAGE_LIMITS = {5: 0.30, 7: 0.25, 10: 0.20}
#: Largest share of a text's word characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 0.30
#: Most characters of ``#*$%&|<>`` for each word.
SYMBOL_LIMIT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BATCH_BYTES = 2 << 20
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 21

MEASURES = T.StructType(
    [
        *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        T.StructField("dup_line_share", T.DoubleType()),
        *[T.StructField(f"dup_{n}gram_share", T.DoubleType()) for n in COVERAGE_LIMITS],
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, counts, shares inside repeated n-grams and lines, and ``kept``.

    Words are runs without ASCII white space.  A text is kept unless it has under ``MIN_WORDS`` words, or over half of
    its words lie in 3-word windows found twice, or a share or the number of symbols per word is over its limit.  Null and empty texts have no words and
    are not kept.  Repeated rows each get their own result; other columns are not read.
    """
    rows = id_text(docs, id_col, text_col)
    schema = T.StructType([field(rows, "_hl_id", id_col), *MEASURES.fields])

    def score(batch: dict) -> Iterator[dict]:
        texts = [to_bytes(t) for t in batch["_hl_text"]]
        for a, b in slices(texts, BATCH_BYTES):
            yield {id_col: batch["_hl_id"][a:b], **measure(texts[a:b])}

    return map_batches(rows, score, schema)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns as they are."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [to_bytes(t) for t in batch.column(at).to_pylist()]
            kept = [measure(texts[a:b])["kept"] for a, b in slices(texts, BATCH_BYTES)]
            yield batch.filter(np.concatenate([*kept, np.zeros(0, bool)]))

    return docs.mapInArrow(run, schema)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text, computed together over all words of the batch."""
    words, n_words, char_counts, symbols = [], [], [], []
    dup_lines, dup_line_chars = [], []
    for text in texts:
        own = text.split()
        words += own
        n_words.append(len(own))
        raw = np.frombuffer(text, np.uint8)
        spaces = int(_SPACES[raw].sum())
        char_counts.append(int(((raw & 0xC0) != 0x80).sum()) - spaces)
        symbols.append(int(_SYMBOLS[raw].sum()))
        n, chars = _repeated_lines(text)
        dup_lines.append(n)
        dup_line_chars.append(chars)
    counts = np.array(n_words, np.int64)
    word_chars = np.array(char_counts, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    codes, distinct = pd.factorize(np.array(words + [None], object)[:-1]) if words else (np.zeros(0, np.int64), [])
    lengths = np.array([len(w.decode("utf-8", "replace")) for w in distinct], np.int64)
    lengths = lengths[codes] if len(codes) else codes
    out = {"n_words": counts, "word_chars": word_chars, "n_symbols": np.array(symbols, np.int64)}
    out["n_dup_lines"] = np.array(dup_lines, np.int64)
    repeated = _covered(_found_twice_exactly(codes.astype(np.int64), len(distinct), doc), 3)
    out["n_repeat_words"] = np.bincount(doc[repeated], minlength=len(texts)).astype(np.int64)
    total = np.maximum(word_chars, 1)
    out["dup_line_share"] = np.array(dup_line_chars) / total
    bad = (out["dup_line_share"] > LINE_LIMIT) | (out["n_symbols"] > SYMBOL_LIMIT * counts)
    for n, starts in _rolling(codes, doc):
        inside = _covered(starts, n)
        share = np.bincount(doc[inside], weights=lengths[inside], minlength=len(texts)) / total
        out[f"dup_{n}gram_share"] = share
        bad |= share > COVERAGE_LIMITS[n]
    out["base_failed"] = (counts < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * counts)
    out["kept"] = ~(out["base_failed"] | bad)
    return out


def _repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the word characters in them."""
    seen, n, chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
            chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        elif line.strip():
            seen.add(line)
    return n, chars


def _found_twice_exactly(codes: np.ndarray, n_codes: int, doc: np.ndarray) -> np.ndarray:
    """Starts of 3-word windows whose words appear again in the same text, by exact keys."""
    size = len(codes)
    starts = np.zeros(size, bool)
    if size < 3:
        return starts
    inside = doc[:-2] == doc[2:]
    if n_codes < 1 << _BITS:
        keys = (codes[:-2] << 2 * _BITS) | (codes[1:-1] << _BITS) | codes[2:]
    else:
        pairs = np.unique((codes[:-1] << 31) | codes[1:], return_inverse=True)[1]
        keys = (pairs[:-1] << 31) | codes[2:]
    at = np.flatnonzero(inside)
    at = at[np.argsort(keys[at], kind="stable")]  # equal keys stay in order of place, so of text
    same = (keys[at[1:]] == keys[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
    starts[at[1:][same]] = True
    starts[at[:-1][same]] = True
    return starts


def _rolling(codes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n-gram length, the starts of n-grams whose rolling hash appears again in the same text."""
    word = _mixed(codes.astype(np.uint64) + np.uint64(1))
    own = _mixed(doc.astype(np.uint64) + np.uint64(1 << 40))
    rolled = word.copy()
    for n in range(2, max(COVERAGE_LIMITS) + 1):
        starts = np.zeros(len(codes), bool)
        if len(rolled) > 1 and len(codes) >= n:
            rolled = rolled[:-1] * _FACTOR + word[n - 1 :]
        else:
            rolled = rolled[:0]
        if n not in COVERAGE_LIMITS:
            continue
        if len(rolled):
            at = np.flatnonzero(doc[: len(rolled)] == doc[n - 1 :])
            keys = rolled[at] ^ own[at]
            ordered = np.sort(keys)
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            if len(twice):
                place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
                starts[at[twice[place] == keys]] = True
        yield n, starts


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in an n-gram that begins at a marked word."""
    sums = np.concatenate(([0], np.cumsum(starts)))
    ends = np.arange(1, len(starts) + 1)
    return sums[ends] > sums[np.maximum(ends - n, 0)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
