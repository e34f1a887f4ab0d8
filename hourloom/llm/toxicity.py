"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, over characters and words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import field, id_text, map_batches, slices, to_bytes

WINDOW, STRIDE = 32, 24
#: Bounds of the training sample: labelled rows of each class, and bytes of a text in it.
POSITIVE_ROWS, NEGATIVE_ROWS, SAMPLE_BYTES = 2000, 3000, 1 << 15
UNIT_BYTES = 24
CHAR_SIZE, WORD_SIZE, HIDDEN = 8, 12, 8
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 240, 64, 0.015
BATCH_BYTES = 1 << 20
MEMO_WORDS = 150_000
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def units(text: bytes) -> list[bytes]:
    """Words in lower case without ASCII punctuation; a longer word is several units."""
    words = text.translate(_PLAIN).split()
    if max(map(len, words), default=0) <= UNIT_BYTES:
        return words
    return [w[i : i + UNIT_BYTES] for w in words for i in range(0, len(w), UNIT_BYTES)]


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n units."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def held_out(id_column: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts == part, F.lit(False))


# --- the network -------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool) -> tuple[np.ndarray, list]:
    """States after each step, zero where masked; x holds the inputs of the three gates."""
    n, steps, h = x.shape[0], x.shape[1], u.shape[0]
    state, out, trace = np.zeros((n, h), x.dtype), np.zeros((n, steps, h), x.dtype), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        gates = _sigmoid(x[:, t, : 2 * h] + state @ u[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        c = np.tanh(x[:, t, 2 * h :] + (r * state) @ u[:, 2 * h :])
        m = mask[:, t, None]
        trace.append((t, state, z, r, c, m))
        state = state + m * z * (c - state)
        out[:, t] = state * m
    return out, trace


def _gru_back(d_out: np.ndarray, trace: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of u."""
    n, steps, h = d_out.shape
    dx, du, d = np.zeros((n, steps, 3 * h), d_out.dtype), np.zeros_like(u), np.zeros((n, h), d_out.dtype)
    for t, state, z, r, c, m in reversed(trace):
        d = d + d_out[:, t] * m
        dz = d * m * (c - state) * z * (1 - z)
        dc = d * m * z * (1 - c * c)
        drs = dc @ u[:, 2 * h :].T
        dr = drs * state * r * (1 - r)
        dzr = np.concatenate((dz, dr), 1)
        dx[:, t, : 2 * h], dx[:, t, 2 * h :] = dzr, dc
        du[:, : 2 * h] += state.T @ dzr
        du[:, 2 * h :] += (r * state).T @ dc
        d = d * (1 - m * z) + drs * r + dzr @ u[:, : 2 * h].T
    return dx, du


def _both(x: np.ndarray, mask: np.ndarray, p: dict, name: str) -> tuple[np.ndarray, tuple]:
    """Bidirectional states pooled by attention."""
    h = p[f"{name}_uf"].shape[0]
    ahead, trace_f = _gru(x[:, :, : 3 * h], mask, p[f"{name}_uf"], False)
    behind, trace_b = _gru(x[:, :, 3 * h :], mask, p[f"{name}_ub"], True)
    states = np.concatenate((ahead, behind), 2)
    score = np.where(mask > 0, states @ p[f"{name}_a"], -1e9)
    weight = np.exp(score - score.max(1, keepdims=True))
    weight = weight / weight.sum(1, keepdims=True) * mask
    return np.einsum("bt,bth->bh", weight, states), (states, weight, trace_f, trace_b)


def _both_back(d_pool: np.ndarray, kept: tuple, p: dict, g: dict, name: str) -> np.ndarray:
    states, weight, trace_f, trace_b = kept
    h = states.shape[2] // 2
    d_weight = np.einsum("bh,bth->bt", d_pool, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
    d_states = weight[:, :, None] * d_pool[:, None] + d_score[:, :, None] * p[f"{name}_a"]
    g[f"{name}_a"] = np.einsum("bt,bth->h", d_score, states)
    dx_f, g[f"{name}_uf"] = _gru_back(d_states[:, :, :h], trace_f, p[f"{name}_uf"])
    dx_b, g[f"{name}_ub"] = _gru_back(d_states[:, :, h:], trace_b, p[f"{name}_ub"])
    return np.concatenate((dx_f, dx_b), 2)


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, words))
    table = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)
    return table.astype(np.int64), (np.arange(width) < np.array([len(w) for w in words])[:, None]).astype(np.float32)


def _word_inputs(words: list[bytes], p: dict, vocabulary: dict) -> tuple[np.ndarray, tuple]:
    """A vector per distinct word: its letters' pooled states beside its embedding (a common one for unknown words)."""
    letters, mask = _letters(words)
    x = (p["char_e"] @ p["char_w"] + p["char_b"])[letters]
    pooled, kept = _both(x, mask, p, "char")
    known = np.array([vocabulary.get(w, 0) for w in words])
    return np.concatenate((pooled, p["word_e"][known]), 1), (letters, kept, known)


def _parameters(words: int, seed: int) -> dict:
    rng, h = np.random.default_rng(seed), HIDDEN

    def normal(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"char_e": normal(256, CHAR_SIZE) * 8, "word_e": normal(words + 1, WORD_SIZE) * 0.1 * np.float32(np.sqrt(words + 1))}
    for name, size in (("char", CHAR_SIZE), ("word", 2 * h + WORD_SIZE)):
        p |= {f"{name}_w": normal(size, 6 * h), f"{name}_b": np.zeros(6 * h, np.float32), f"{name}_a": normal(2 * h)}
        p |= {f"{name}_uf": normal(h, 3 * h), f"{name}_ub": normal(h, 3 * h)}
    return p | {"out_w": normal(2 * h), "out_b": np.zeros(1, np.float32)}


def _step(windows: list[list[bytes]], y: np.ndarray, p: dict, vocabulary: dict) -> dict:
    """Gradients of the mean log loss over windows."""
    place: dict[bytes, int] = {}
    codes = np.zeros((len(windows), WINDOW), np.int64)
    mask = np.zeros((len(windows), WINDOW), np.float32)
    for i, window in enumerate(windows):
        codes[i, : len(window)] = [place.setdefault(w, len(place)) for w in window]
        mask[i, : len(window)] = 1
    vectors, (letters, kept_char, known) = _word_inputs(list(place), p, vocabulary)
    inputs = vectors @ p["word_w"] + p["word_b"]
    pooled, kept = _both(inputs[codes], mask, p, "word")
    d = ((_sigmoid(pooled @ p["out_w"] + p["out_b"]) - y) / len(y)).astype(np.float32)
    g = {"out_w": pooled.T @ d, "out_b": d.sum(keepdims=True)}
    dx = _both_back(d[:, None] * p["out_w"], kept, p, g, "word") * mask[:, :, None]
    d_inputs = np.zeros_like(inputs)
    np.add.at(d_inputs, codes.ravel(), dx.reshape(-1, dx.shape[2]))
    g["word_w"], g["word_b"] = vectors.T @ d_inputs, d_inputs.sum(0)
    d_vectors = d_inputs @ p["word_w"].T
    g["word_e"] = np.zeros_like(p["word_e"])
    np.add.at(g["word_e"], known, d_vectors[:, 2 * HIDDEN :])
    dx = _both_back(d_vectors[:, : 2 * HIDDEN], kept_char, p, g, "char")
    per_byte = np.zeros((256, dx.shape[2]), np.float32)
    np.add.at(per_byte, letters.ravel(), dx.reshape(-1, dx.shape[2]))
    g["char_w"], g["char_b"] = p["char_e"].T @ per_byte, per_byte.sum(0)
    g["char_e"] = per_byte @ p["char_w"].T
    return g


class Scorer:
    """Largest window log odds of each text, turned into a score by the calibration of the model."""

    def __init__(self, model: dict):
        self.p, self.vocabulary, self.scale, self.shift, self.prior = (model[k] for k in ("p", "vocabulary", "scale", "shift", "prior"))
        self.memo: dict[bytes, int] = {}
        self.inputs = np.zeros((0, 6 * HIDDEN), np.float32)

    def scores(self, texts: list[bytes]) -> list[float]:
        if self.p is None:
            return [self.prior] * len(texts)
        odds = self.odds(texts)
        return [float(_sigmoid(np.float64(self.scale * o + self.shift))) for o in odds]

    def odds(self, texts: list[bytes]) -> np.ndarray:
        split = [units(t) for t in texts]
        words = [w for own in split for w in own]
        best = np.full(len(texts), float(self.p["out_b"][0]))  # a text without words: no evidence
        if not words:
            return best
        codes = self._codes(words)
        sizes = np.array([len(s) for s in split])
        firsts = np.concatenate(([0], np.cumsum(sizes)))
        starts = np.array([f + s for f, n in zip(firsts.tolist(), sizes.tolist()) if n for s in window_starts(n)])
        owner = np.searchsorted(firsts[1:], starts, "right")
        steps = starts[:, None] + np.arange(WINDOW)
        mask = (steps < firsts[owner + 1][:, None]).astype(np.float32)
        table = codes[np.minimum(steps, len(codes) - 1)]
        found = np.full(len(texts), -np.inf)
        for a in range(0, len(starts), 2048):
            pooled, _ = _both(self.inputs[table[a : a + 2048]], mask[a : a + 2048], self.p, "word")
            np.maximum.at(found, owner[a : a + 2048], pooled @ self.p["out_w"] + self.p["out_b"])
        return np.where(sizes > 0, found, best)

    def _codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.inputs = {}, self.inputs[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        made = [self.inputs]
        for a in range(0, len(new), 8192):
            part = sorted(new[a : a + 8192], key=len)
            for b in range(0, len(part), 1024):  # words of like length together
                vectors, _ = _word_inputs(part[b : b + 1024], self.p, self.vocabulary)
                made.append(vectors @ self.p["word_w"] + self.p["word_b"])
            self.memo.update(zip(part, range(len(self.memo), len(self.memo) + len(part))))
        self.inputs = np.concatenate(made)
        return np.array([self.memo[w] for w in words])


# --- fitting and scoring -----------------------------------------------------


def fit(texts: list[bytes], labels: list[int], seed: int = 1) -> dict:
    """The model from a sample that fits in memory.

    A toxic text says only that some window is toxic, so training starts from the window with the most telling words
    (smoothed log odds over the sample) and later takes the window that the network itself scores highest.  One text in
    six is kept apart to calibrate the score on whole texts.
    """
    y = np.array(labels)
    prior = float(y.mean()) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        return {"p": None, "vocabulary": {}, "scale": 1.0, "shift": 0.0, "prior": prior}
    rng = np.random.default_rng(seed)
    split = [units(t) for t in texts]
    apart = rng.permutation(len(y)) % 6 == 0
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(y), bool)
    learn = np.flatnonzero(~apart)
    in_bad, in_good = Counter(), Counter()
    for i in learn:
        (in_bad if y[i] else in_good).update(set(split[i]))
    bad, good = y[learn].sum(), (1 - y[learn]).sum()
    telling = {w: np.log((n + 0.1) / (bad + 0.2)) - np.log((in_good[w] + 0.1) / (good + 0.2)) for w, n in in_bad.items()}
    counts = in_bad + in_good
    vocabulary = {w: i + 1 for i, w in enumerate(w for w, n in counts.items() if n >= 3)}
    p = _parameters(len(vocabulary), seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    model = {"p": p, "vocabulary": vocabulary, "scale": 1.0, "shift": 0.0, "prior": prior}
    per_epoch = sum(1 if y[i] else min(2, len(window_starts(len(split[i])))) for i in learn) / BATCH
    epochs, t = max(EPOCHS, int(LEAST_STEPS / per_epoch) + 1), 0
    for epoch in range(epochs):
        windows, targets, scorer = [], [], Scorer(model)
        for i in learn:
            own = [split[i][s : s + WINDOW] for s in window_starts(len(split[i])) if split[i]]
            if not own:
                continue
            if y[i] and 2 * epoch < epochs:
                own.sort(key=lambda w: -max(in_bad[x] >= 2 and telling[x] for x in w if x in telling))
                windows.append(own[0])
            elif y[i]:
                windows.append(own[int(np.argmax(scorer.odds([b" ".join(w) for w in own])))] if len(own) > 1 else own[0])
            else:
                for j in rng.choice(len(own), min(len(own), 2), replace=False):
                    windows.append(own[j])
            targets += [y[i]] * (len(windows) - len(targets))
        order = rng.permutation(len(windows))
        target = np.array(targets, np.float32)
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            g = _step([windows[j] for j in part], target[part], p, vocabulary)
            t += 1
            for k, v in g.items():  # Adam
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                p[k] -= (RATE / (1 + EPOCHS * epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    check = np.flatnonzero(apart) if apart.any() else learn
    odds = Scorer(model).odds([texts[i] for i in check])
    model["scale"], model["shift"] = _calibrated(odds, y[check])
    return model


def _calibrated(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logistic regression on one variable, with smoothed targets, by Newton steps."""
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 0.5, 0.0
    for _ in range(50):
        q = _sigmoid(a * odds + b)
        w = q * (1 - q) + 1e-6
        gradient = np.array([((q - goal) * odds).sum() + 1e-3 * a, (q - goal).sum()])
        curve = np.array([[(w * odds * odds).sum() + 1e-3, (w * odds).sum()], [(w * odds).sum(), w.sum()]])
        move = np.clip(np.linalg.solve(curve, gradient), -1, 1)
        a, b = a - move[0], b - move[1]
    return max(float(a), 1e-3), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Fit on a bounded sample of labelled rows outside the held-out part (crc32 of the id mod 5 = 0).

    At most ``POSITIVE_ROWS`` and ``NEGATIVE_ROWS`` labelled ids, in the order of a hash of the id, whose texts have at
    most ``SAMPLE_BYTES`` bytes.  Null labels and ids are not used; contradicting labels of one id count as 1.
    """
    rows = labels.select(F.col(id_col).alias("_hl_id"), F.col(label_col).cast("int").alias("y")).dropna()
    rows = rows.filter(~held_out(F.col("_hl_id"), 5, 0) & F.col("y").isin(0, 1)).groupBy("_hl_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.col("_hl_id").cast("string"))
    chosen = None
    for y, n in ((1, POSITIVE_ROWS), (0, NEGATIVE_ROWS)):
        part = rows.filter(F.col("y") == y).orderBy(order, "_hl_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = id_text(docs, id_col, text_col).filter(F.octet_length("_hl_text") <= SAMPLE_BYTES)
    sample = texts.join(F.broadcast(chosen), "_hl_id").orderBy(order, "_hl_id", "_hl_text").limit(POSITIVE_ROWS + NEGATIVE_ROWS).collect()
    return fit([to_bytes(r["_hl_text"]) for r in sample], [r["y"] for r in sample])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: id, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    The score is the calibrated largest log odds over all overlapping windows of the whole text.  Null and empty texts
    have no window and get the score of no evidence; without labels of both classes the score is the share of label 1.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    rows = id_text(docs, id_col, text_col)
    schema = T.StructType([field(rows, "_hl_id", id_col), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            texts = [to_bytes(t) for t in batch.column(1).to_pylist()]
            scores = [x for a, b in slices(texts, BATCH_BYTES) for x in scorer.scores(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=schema.names)

    scored = rows.mapInArrow(run, schema)
    return scored.select(id_col, held_out(F.col(id_col), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
