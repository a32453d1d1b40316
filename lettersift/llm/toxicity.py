"""Toxicity by compression distance: two zstandard dictionaries and calibrated thresholds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettersift.llm import textkit as K
from lettersift.llm.common import held_out, map_texts
from lettersift.llm.labelled import logistic, sample_labels, sigmoid
from lettersift.session import stored

#: labelled rows of each class that the model is trained on, at most about
TRAIN_ROWS = 4000
#: bytes of windows that a dictionary may hold; a compressor looks no further back
DICT_BYTES = 1 << 16
#: a window is in a dictionary if it has so many surroundings at least
RECURS = 3
#: windows expected in the toxic dictionary by chance alone
CHANCE = 1.0
#: each byte is written as so many, so that a match of few letters shows in the length
DILATION = 4
THRESHOLD = 0.3
_TABLE = np.random.Generator(np.random.PCG64(5)).integers(0, 256, (256, DILATION), dtype=np.uint8)
#: windows whose distance a worker remembers
_MEMO = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: the worst windows of a text that are features
WORST = 4
#: distances from which on windows are counted
CUTS = (4, 6, 8, 12, 16)


@dataclass
class Model:
    """Windows of either class, the most telling last, and the weights of the calibrated decision."""

    toxic: bytes
    ordinary: bytes
    weights: list[float] = field(default_factory=list)


def _dilate(b: bytes) -> bytes:
    return _TABLE[np.frombuffer(b, np.uint8)].tobytes()


class Distance:
    """Compressed length with the ordinary dictionary less that with the toxic one, window by window."""

    def __init__(self, model: Model):
        import zstandard as zs

        how = zs.ZstdCompressionParameters(
            window_log=20, hash_log=17, chain_log=17, search_log=5, min_match=5, target_length=64, strategy=zs.STRATEGY_BTOPT,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        self.tools = []
        for content in (model.ordinary, model.toxic):
            d = zs.ZstdCompressionDict(_dilate(content or b"\0" * 8), dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.tools.append(zs.ZstdCompressor(compression_params=how, dict_data=d))
        self.known: dict[bytes, int] = {}

    def _lengths(self, tool, data: bytes, cuts: np.ndarray) -> np.ndarray:
        import zstandard as zs

        got = tool.multi_compress_to_buffer(zs.BufferWithSegments(data, cuts.tobytes()))
        return np.fromiter((len(got[k]) for k in range(len(got))), np.int64, len(got))

    def _learn(self, new: list[bytes]) -> None:
        """Compress windows, each between two spaces."""
        if len(self.known) + len(new) > _MEMO:
            self.known.clear()
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            wide = _dilate(b"".join(b" " + w + b" " for w in some))
            size = (np.fromiter(map(len, some), np.int64, len(some)) + 2) * DILATION
            cuts = np.column_stack([np.cumsum(size) - size, size]).astype(np.uint64)
            ordinary, toxic = (self._lengths(t, wide, cuts) for t in self.tools)
            self.known.update(zip(some, (ordinary - toxic).tolist()))

    def windows(self, x: K.Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the windows [a, b), which ascend; each distinct one is compressed once."""
        if not len(a):
            return np.zeros(0)
        ids, values = x.names(a, b)
        used = np.unique(ids)
        names = values.take(pa.array(used)).to_pylist()
        d = np.zeros(len(values))
        got = [self.known.get(w) for w in names]
        new = [w for w, v in zip(names, got) if v is None]
        if new:
            before = dict(zip(names, got))
            self._learn(new)
            got = [self.known[w] if before[w] is None else before[w] for w in names]
        d[used] = got
        return d[ids]


def features(tool: Distance, column: pa.Array) -> np.ndarray:
    """A row a text: the largest distances, how many windows reach the cuts, and how many there are."""
    x = K.Texts(column, K.LOWER)
    a, b, doc = x.spans(_LETTER)
    d = tool.windows(x, a, b)
    n = np.bincount(doc, minlength=x.n)
    begin = np.cumsum(n) - n
    order = np.lexsort((-d, doc))
    out = np.zeros((x.n, WORST + len(CUTS) + 1))
    for k in range(WORST):
        has = n > k
        out[has, k] = np.maximum(0, d[order[begin[has] + k]])
    for k, c in enumerate(CUTS, WORST):
        out[:, k] = np.log1p(np.bincount(doc[d >= c], minlength=x.n))
    out[:, -1] = np.log1p(n)
    return out


def _design(f: np.ndarray) -> np.ndarray:
    f = np.column_stack([f[:, :WORST] / 8, f[:, WORST:]])
    return np.column_stack([f, f[:, :2] ** 2, f[:, :1] * f[:, -1:]])


def score_features(f: np.ndarray, weights: list[float]) -> np.ndarray:
    w = np.array(weights)
    return sigmoid(w[0] + _design(f) @ w[1:])


def surroundings(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Each text's distinct windows and the neighbours of their first place, as a hash.

    Copies and near copies have a window in the same surroundings, so those
    count once however many copies there are.
    """
    x = K.Texts(column, K.LOWER)
    a, b, doc = x.spans(_LETTER)
    ids, values = x.names(a, b)
    if not len(a):
        return [], np.zeros(0, np.int64)
    h = K.hashes_of(values)[ids]
    around = h * K.PLACE[2]
    same = doc[1:] == doc[:-1]
    around[1:] += np.where(same, h[:-1], np.uint64(0)) * K.PLACE[0]
    around[:-1] += np.where(same, h[1:], np.uint64(0)) * K.PLACE[1]
    _, first = np.unique(doc * np.int64(len(values)) + ids, return_index=True)
    return values.take(pa.array(ids[first])).to_pylist(), K.mix(around[first]).view(np.int64)


def window_counts(rows: DataFrame) -> DataFrame:
    """Of rows (_y, _fold, _text): (y, fold, window, n), n distinct surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, fold = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for k in range(batch.num_rows):
                got, around = surroundings(batch.column(2).slice(k, 1))
                cols = [pa.array(np.full(len(got), v[k], np.int32)) for v in (y, fold)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.binary()), pa.array(around)], names=["y", "fold", "window", "around"])

    seen = rows.select("_y", "_fold", "_text").mapInArrow(run, "y int, fold int, window binary, around long")
    return seen.distinct().groupBy("y", "fold", "window").agg(F.count("*").alias("n"))


def _content(scored: list[tuple[int, bytes]]) -> bytes:
    """Windows between spaces, the most usual last, where offsets are short."""
    whole = b"".join(b" " + w + b" " for _, w in sorted(scored))
    return whole[-DICT_BYTES // DILATION :]


def train_dictionaries(toxic: dict[bytes, int], ordinary: dict[bytes, int], total: tuple[int, int], kinds: int) -> Model:
    """The contents of both dictionaries, from counts of surroundings.

    The ordinary one holds the windows that recur in ordinary text.  The toxic
    one holds those that recur in toxic text far more than in ordinary text:
    against a Poisson count at the ordinary rate the tail is so thin that of
    all ``kinds`` of windows CHANCE would pass by accident.  ``total``: all
    surroundings of toxic and of ordinary text.
    """
    bad = []
    for w, k in toxic.items():
        mean = (ordinary.get(w, 0) + 0.5) / max(1, total[1]) * total[0]
        if k >= RECURS and k > mean and k - mean - k * np.log(k / mean) < np.log(CHANCE / max(1, kinds)):
            bad.append((k, w))
    return Model(_content(bad), _content([(k, w) for w, k in ordinary.items() if k >= RECURS]))


def _dictionaries(counts: DataFrame) -> list[Model]:
    """Dictionaries of either fold, and of both."""
    wide = counts.groupBy("window").agg(
        *[F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("fold") == f), F.col("n"))), F.lit(0)).alias(f"n{y}{f}") for y in (0, 1) for f in (0, 1)]
    )
    total = counts.groupBy("y", "fold").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()  # four rows
    n = {(r["y"], r["fold"]): r["n"] for r in total}
    kinds = {r["fold"]: r["kinds"] for r in total if r["y"] == 1}
    both = sum(kinds.values())
    some = wide.filter((F.col("n00") + F.col("n01") >= RECURS) | (F.col("n10") + F.col("n11") >= RECURS)).toArrow()  # windows that recur in the sample
    names = some["window"].to_pylist()
    c = {k: some[f"n{k}"].to_numpy() for k in ("00", "01", "10", "11")}
    parts = [(c["10"], c["00"], (n.get((1, 0), 0), n.get((0, 0), 0)), kinds.get(0, 0)), (c["11"], c["01"], (n.get((1, 1), 0), n.get((0, 1), 0)), kinds.get(1, 0))]
    parts.append((c["10"] + c["11"], c["00"] + c["01"], tuple(sum(p[2][k] for p in parts) for k in (0, 1)), both))
    of = lambda v: {w: int(k) for w, k in zip(names, v) if k}
    return [train_dictionaries(of(t), of(o), tot, k) for t, o, tot, k in parts]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", keep: Column | None = None) -> Model:
    """Fit on a bounded sample of labelled rows, TRAIN_ROWS of each class; ``keep``: which ids may be learned from.

    The rows are cut in two folds by id; thresholds are calibrated on each fold
    with the dictionaries of the other one, and the model gets the dictionaries
    of all rows.  Windows are counted and features made on the executors; the
    driver gets the windows that recur and a row of features for each example.
    Without an example of one class every text scores the share of toxic
    examples.
    """
    chosen, weight = sample_labels(labels, label, TRAIN_ROWS, keep, id)
    words = chosen.select(F.col(id).alias("_id"), F.col("y").alias("_y"), F.pmod(F.xxhash64(F.col(id), F.lit(7)), F.lit(2)).cast("int").alias("_fold"))
    thin = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    rows = stored(thin.join(F.broadcast(words), "_id").select("_y", "_fold", "_text").filter("_text is not null"))  # 2 * TRAIN_ROWS ids
    *folds, model = _dictionaries(stored(window_counts(rows)))
    tools: dict[int, Distance] = {}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.asarray(batch.column(1))
            for f in (0, 1):
                part = batch.filter(pa.array(fold == f))
                if f not in tools:
                    tools[f] = Distance(folds[1 - f])
                for i, j in K.chunks(part.column(2)):
                    x = features(tools[f], part.column(2).slice(i, j - i))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.select("_y", "_fold", "_text").mapInArrow(measure, "y int, x array<double>").toArrow()
    y = np.asarray(got["y"].to_numpy(), float)
    x = np.array(got["x"].to_pylist()).reshape(len(y), WORST + len(CUTS) + 1)
    if 0 < y.sum() < len(y):
        # in one order, whatever the layout
        order = np.lexsort((*x.T, y))
        x, y = x[order], y[order]
        w = np.where(y == 1, weight.get(1, 1.0), weight.get(0, 1.0))
        model.weights = logistic(_design(x), y, weight=w).tolist()
    else:
        p = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        width = _design(np.zeros((1, WORST + len(CUTS) + 1))).shape[1]
        model.weights = [float(np.log(p / (1 - p)))] + [0.0] * width
    return model


def classify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: (id, score, predicted, worst distance).

    Windows are the runs of letters and digits of the lower-cased text, each
    between two spaces; wider ones hide one toxic word among several others.  A
    window's distance is its compressed length with the ordinary dictionary less
    that with the toxic one.  The calibrated decision takes the largest
    distances and the numbers of windows above the cuts.

    Null and empty texts have no window and score as such; repeated rows score
    alike; an empty table gives no rows; extra columns are left out.  Map-only.
    """
    tools: list[Distance] = []

    def fn(_, texts):
        if not tools:
            tools.append(Distance(model))
        f = features(tools[0], texts)
        s = score_features(f, model.weights)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32), "worst_distance": f[:, 0].astype(np.int32)}

    named = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return map_texts(named, "_text", "score double, predicted int, worst_distance int", fn, ["_id"]).withColumnRenamed("_id", id)


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2) -> DataFrame:
    """Train on rows outside the held-out fold and score all: adds ``held_out``."""
    model = train(docs, labels, keep=~held_out("doc_id", mod, rest))
    return classify(docs, model).select("doc_id", held_out("doc_id", mod, rest).alias("held_out"), "score", "predicted", "worst_distance")
