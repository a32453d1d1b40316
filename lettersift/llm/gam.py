"""Quality classifier: an additive model of binned features with pairwise interactions."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettersift.llm import textkit as K
from lettersift.llm.common import held_out, map_texts
from lettersift.llm.labelled import sample_labels, sigmoid
from lettersift.llm.rules import measure_words

#: labelled rows of each class that the model is trained on, at most about
TRAIN_ROWS = 10_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, RATE, LEAVES = 120, 0.1, 4
THRESHOLD = 0.5

FEATURES = (
    "words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "top_word_rate", "upper_rate",
    "digit_rate", "punct_rate", "line_words", "next_same_rate", "longest_word", "space_rate", "lone_mark_rate", "end_mark_rate",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES a text; a text without words is a row of zeros."""
    x = K.Texts(column)
    a, b, doc = x.spans(K.INK)
    h, values = x.names(a, b)
    base = measure_words(x, b, doc, h)
    n = base["n_words"]
    per = np.maximum(1, n)
    size = np.maximum(1, x.at[1:] - x.at[:-1])
    ascii_letters = np.maximum(1, x.counts(_UPPER[x.buf] | _LOWER[x.buf]))
    key = doc * (len(values) + 1) + h
    _, first, c = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(doc[first], minlength=x.n)
    top = np.zeros(x.n, np.int64)
    np.maximum.at(top, doc[first], c)
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) if len(h) else np.zeros(0, bool)
    longest = np.zeros(x.n, np.int64)
    np.maximum.at(longest, doc, b - a)
    lone = (b - a == 1) & _PUNCT[x.buf[a]] if len(a) else np.zeros(0, bool)
    end = _END[x.buf[b - 1]] if len(a) else np.zeros(0, bool)
    out = np.column_stack(
        [
            np.log1p(n),
            base["word_chars"] / per,
            base["n_symbols"] / per,
            base["n_dup_lines"] / np.maximum(1, base["n_lines"]),
            base["n_repeat_words"] / per,
            distinct / per,
            top / per,
            x.counts(_UPPER[x.buf]) / ascii_letters,
            x.counts(_DIGIT[x.buf]) / size,
            x.counts(_PUNCT[x.buf]) / size,
            np.log1p(n / np.maximum(1, base["n_lines"])),
            np.bincount(doc[1:][same], minlength=x.n) / per if len(h) else np.zeros(x.n),
            np.log1p(longest),
            x.counts(K.SPACE[x.buf]) / size,
            np.bincount(doc[lone], minlength=x.n) / per,
            np.bincount(doc[end], minlength=x.n) / per,
        ]
    )
    out[n == 0] = 0
    return out


@dataclass
class Model:
    """Bin edges, one table of additions for each feature and one for each pair of features."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, k], "right")]
        small = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for p in self.pairs for k in p[:2]}
        for i, j, t in self.pairs:
            z += t[small[i], small[j]]
        return z


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) if len(v) else np.zeros(0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Newton step of each bin from a tree of at most ``leaves`` leaves over ordered bins.

    ``g``, ``h``: sums of gradients and curvatures by bin.  The leaf whose best
    cut gains most is split next; leaves keep a curvature of ``least``.
    """
    gain = lambda s, c: s * s / (c + ridge)
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]

    def best(lo: int, hi: int):
        if hi - lo < 2:
            return 0.0, -1
        m = np.arange(lo + 1, hi)
        lg, lh, rg, rh = cg[m] - cg[lo], ch[m] - ch[lo], cg[hi] - cg[m], ch[hi] - ch[m]
        v = gain(lg, lh) + gain(rg, rh) - gain(cg[hi] - cg[lo], ch[hi] - ch[lo])
        v[(lh < least) | (rh < least)] = 0
        k = int(v.argmax())
        return float(v[k]), int(m[k])

    parts = [(0, len(g), *best(0, len(g)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        lo, hi, v, m = parts[k]
        if v <= 1e-9:
            break
        parts[k : k + 1] = [(lo, m, *best(lo, m)), (m, hi, *best(m, hi))]
    out = np.zeros(len(g))
    for lo, hi, _, _ in parts:
        out[lo:hi] = -(cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _grid_step(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton step of a tree that cuts a pair's grid once along each axis, where it gains most."""
    cg, ch = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, cut = -1.0, (1, 1)
    quads = lambda c, i, j: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            v = sum(s * s / (c + ridge) for s, c in zip(quads(cg, i, j), quads(ch, i, j)))
            if v > best:
                best, cut = v, (i, j)
    i, j = cut
    out = np.zeros_like(g)
    q = [-s / (c + ridge) for s, c in zip(quads(cg, i, j), quads(ch, i, j))]
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = q
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = ROUNDS, pairs: int = PAIRS) -> Model:
    """Cyclic boosting: in each round every feature in turn gets one shallow tree.

    The pairs whose grid explains most of what the single features left are then
    boosted in the same way.  Tables are centred on the training rows.
    """
    m = Model()
    w = np.ones(len(y)) if weight is None else weight
    if not len(y) or y.min() == y.max():
        p = np.clip((w * y).sum() / w.sum() if len(y) else 0.5, 1e-4, 1 - 1e-4)
        m.intercept = float(np.log(p / (1 - p)))
        return m
    p = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
    m.intercept = float(np.log(p / (1 - p)))
    m.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(len(y), m.intercept)
    for _ in range(rounds):
        for k, b in enumerate(bins):
            q = sigmoid(z)
            n = len(m.tables[k])
            step = RATE * shallow_tree(np.bincount(b, w * (q - y), n), np.bincount(b, w * q * (1 - q), n), LEAVES)
            m.tables[k] += step
            z += step[b]
    m.pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    small = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(m.pair_edges)]
    q = sigmoid(z)
    strength = []
    for i, j in combinations(range(x.shape[1]), 2):
        s = (len(m.pair_edges[i]) + 1, len(m.pair_edges[j]) + 1)
        cell = small[i] * s[1] + small[j]
        g, h = np.bincount(cell, w * (q - y), s[0] * s[1]), np.bincount(cell, w * q * (1 - q), s[0] * s[1])
        strength.append((float((g * g / (h + 1)).sum()), i, j, s))
    chosen = [(i, j, s, small[i] * s[1] + small[j], np.zeros(s)) for _, i, j, s in sorted(strength, key=lambda v: (-v[0], v[1], v[2]))[:pairs] if min(s) > 1]
    for _ in range(rounds // 3):
        for _, _, s, cell, t in chosen:
            q = sigmoid(z)
            g = np.bincount(cell, w * (q - y), s[0] * s[1]).reshape(s)
            step = RATE * _grid_step(g, np.bincount(cell, w * q * (1 - q), s[0] * s[1]).reshape(s))
            t += step
            z += step.ravel()[cell]
    for k, b in enumerate(bins):
        c = float(np.average(m.tables[k][b], weights=w))
        m.tables[k] -= c
        m.intercept += c
    m.pairs = [(i, j, t) for i, j, _, _, t in chosen]
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", keep: Column | None = None) -> Model:
    """Fit on a bounded sample of labelled rows, about TRAIN_ROWS of each class; ``keep``: which ids may be learned from."""
    chosen, weight = sample_labels(labels, label, TRAIN_ROWS, keep, id)
    named = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    rows = named.join(F.broadcast(chosen.select(F.col(id).alias("_id"), "y")), "_id")  # 2 * TRAIN_ROWS ids

    def fn(_, texts):
        f = features(texts)
        return {n: f[:, k] for k, n in enumerate(FEATURES)}

    got = map_texts(rows, "_text", ", ".join(f"{n} double" for n in FEATURES), fn, ["_id", "y"]).toPandas()
    # row order must not matter
    got = got.assign(_o=[crc32(str(i).encode()) for i in got["_id"]]).sort_values(["_o", "y", *FEATURES], kind="stable")
    y = got["y"].to_numpy(float)
    return fit(got[list(FEATURES)].to_numpy(float), y, np.where(y == 1, weight.get(1, 1.0), weight.get(0, 1.0)))


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    return sigmoid(model.logits(features(texts)))


def classify(docs: DataFrame, model: Model, carry: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text by bin additions: (carry..., score, predicted).

    Null and empty texts have features 0 and score as such; repeated rows score
    alike; an empty table gives no rows.  Map-only: one scan, no shuffle.
    """

    def fn(_, texts):
        s = score_texts(model, texts)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_texts(docs, text, "score double, predicted int", fn, carry)


def quality(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1) -> DataFrame:
    """Train on rows outside the held-out fold and score all: (doc_id, held_out, score, predicted).

    Extra columns are left out.
    """
    model = train(docs, labels, keep=~held_out("doc_id", mod, rest))
    got = classify(docs.select(F.col("doc_id").alias("_id"), "text"), model, ["_id"])
    return got.select(F.col("_id").alias("doc_id"), held_out("_id", mod, rest).alias("held_out"), "score", "predicted")
