"""Language identification: known words first, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettersift.llm import textkit as K
from lettersift.llm.common import held_out, map_texts
from lettersift.session import stored

#: training rows of each language, at most about
TRAIN_ROWS = 8000
#: the model keeps the most usual words and n-grams of each language
WORDS, GRAMS = 60_000, 40_000
#: lengths of the n-grams in bytes, longest first; a word has a space at either end
ORDERS = (5, 4, 3, 2)
#: what a step down to shorter n-grams costs
BACKOFF = float(np.log(0.4))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: longest word in bytes that the table of words keeps; longer ones teach and are scored by their n-grams
LONGEST = 48
#: sums of n-gram weights are kept in whole parts of so much, so that they don't depend on the order of adding
_PARTS = 1 << 16


@dataclass
class Model:
    """``tables[0]``: hashes of words, then for each order the n-grams' bytes as numbers; sorted, with a row of log rates."""

    langs: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray


def train_rows(docs: DataFrame, bound: int, id: str, text: str, lang: str, keep: Column | None) -> DataFrame:
    """(lang, text) of about ``bound`` rows of each language, drawn by a hash of id and language."""
    thin = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{lang}`").alias("_lang"), F.col(f"`{text}`").alias("_text"))
    thin = thin.filter("_lang is not null and _text is not null")
    if keep is not None:
        thin = thin.filter(keep)
    n = {r["_lang"]: r["count"] for r in thin.groupBy("_lang").count().collect()}  # a row a language
    rate = F.lit(0.0)
    for k, c in n.items():
        rate = F.when(F.col("_lang") == k, F.lit(min(1.0, bound / c))).otherwise(rate)
    r = F.xxhash64("_id", "_lang").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return thin.filter(r < rate).select("_lang", "_text")


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n): partial counts in the scan, summed after; the empty word stands for the language itself, with n 0."""

    def count(batches):
        for batch in batches:
            langs = batch.column(0)
            for i, j in K.chunks(batch.column(1)):
                x = K.Texts(batch.column(1).slice(i, j - i), K.LOWER)
                a, b, doc = x.spans(_LETTER)
                names = langs.slice(i, j - i).dictionary_encode()
                own = np.asarray(names.indices)[doc].astype(np.int64)
                ids, values = x.names(a, b)
                _, first, n = np.unique(ids * (len(names.dictionary) + 1) + own, return_index=True, return_counts=True)
                words = values.take(pa.array(ids[first])).to_pylist()
                every = np.arange(len(names.dictionary))
                yield pa.RecordBatch.from_arrays(
                    [
                        names.dictionary.take(pa.array(np.concatenate([own[first], every]))),
                        pa.array(words + [b""] * len(every), pa.binary()), pa.array(np.concatenate([n, 0 * every])),
                    ],
                    names=["lang", "word", "n"],
                )

    return rows.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _gram_sums(words: pa.Array, lang: np.ndarray, n: np.ndarray):
    """For each order: its length, and hash, language and summed weight of the distinct n-grams of some types of words."""
    x = K.Texts(words)
    x, a, b = _between_spaces(x.buf, x.at[:-1], x.at[1:])
    # types of words count by the log of their number, so that a few usual words don't rule the n-grams
    weight = np.rint((1 + np.log(n)) * _PARTS)
    for k in ORDERS:
        at, word = grams_of(x, a, b, k)
        h = x.packed(at, k)
        own = lang[word]
        # under 2^40 times a language
        _, first, inv = np.unique(h * np.uint64(own.max(initial=0) + 1) + own.astype(np.uint64), return_index=True, return_inverse=True)
        yield k, h[first], own[first], np.bincount(inv, weight[word], len(first)).astype(np.int64)


def gram_counts(types: DataFrame, langs: list[str]) -> DataFrame:
    """(k, lang, h, n): weight of each n-gram over all types of words, whatever their length or number; ``lang`` is a place in ``langs``."""

    def sums(held):
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lang = np.array([langs.index(v) for v in t.column(0).dictionary_encode().dictionary.to_pylist()], np.int64)[np.asarray(t.column(0).dictionary_encode().indices)]
        for i, j in K.chunks(t.column(1)):
            for k, h, own, n in _gram_sums(t.column(1).slice(i, j - i), lang[i:j], np.asarray(t.column(2))[i:j]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(own.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["k", "lang", "h", "n"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= K.CHUNK:
                yield from sums(held)
                held, size = [], 0
        if size:
            yield from sums(held)

    return types.filter("n > 0").select("lang", "word", "n").mapInArrow(count, "k int, lang int, h long, n long").groupBy("k", "lang", "h").agg(F.sum("n").alias("n"))


def _table(hashes: np.ndarray, lang: np.ndarray, n: np.ndarray, total: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the ``most`` usual entries of each language, or of all, with log rates by language.

    ``total``: of each language, also of what isn't kept.  What a language hasn't
    has the same rate in all, so that one with little text doesn't draw the
    words of others.
    """
    u, inv = np.unique(hashes, return_inverse=True)
    count = np.zeros((len(u), len(total)))
    np.add.at(count, (inv, lang), n)
    keep = np.full(len(u), most is None)
    for k in range(len(total) if most is not None else 0):
        order = np.lexsort((u, -count[:, k]))[:most]
        keep[order[count[order, k] > 0]] = True
    rates = np.log(count[keep] / np.maximum(1, total) + 0.1 / max(1, total.max(initial=0)))
    return u[keep], rates.astype(np.float32)


def grams_of(x: K.Texts, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-grams of the words [a, b) with the byte before and after: start and word number."""
    lo, hi = a - 1, b + 1
    many = np.maximum(0, hi - lo - k + 1)
    word = np.repeat(np.arange(len(a)), many)
    at = np.repeat(lo, many) + np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
    return at, word


def _between_spaces(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[K.Texts, np.ndarray, np.ndarray]:
    """The words [a, b) side by side, a space before and after each."""
    size = b - a
    at = np.cumsum(size + 2) - size - 1
    out = np.full(int((size + 2).sum()), 32, np.uint8)
    k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + k] = raw[np.repeat(a, size) + k]
    x = K.Texts(pa.array([out.tobytes()], pa.large_binary()))
    return x, at, at + size


def _model(langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    floor = np.array([t[1].min(0) if len(t[1]) else np.zeros(len(langs)) for t in tables]).min(0) if langs else np.zeros(0)
    return Model(langs, tables, floor)


def _word_table(words: pa.Array, lang: np.ndarray, n: np.ndarray, total: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    x = K.Texts(words)
    x, a, b = _between_spaces(x.buf, x.at[:-1], x.at[1:])
    return _table(x.hashes(a, b), lang, n, total, most)


def fit(counts: list[tuple[str, bytes, int]], words: int = WORDS, grams: int = GRAMS) -> Model:
    """The model of (lang, word, n) counts, here; ``train`` counts the n-grams on the executors."""
    langs = sorted({r[0] for r in counts})
    counts = [r for r in counts if r[2] > 0]
    lang = np.array([langs.index(r[0]) for r in counts], np.int64)
    n = np.array([r[2] for r in counts], np.int64)
    names = pa.array([r[1] for r in counts], pa.binary())
    usual = np.array([r[2] > 1 and len(r[1]) <= LONGEST for r in counts], bool)
    total = np.bincount(lang, n, len(langs))
    tables = [_word_table(names.filter(pa.array(usual)), lang[usual], n[usual], total, words)]
    for _, h, own, m in _gram_sums(names, lang, n):
        tables.append(_table(h, own, m / _PARTS, np.bincount(own, m / _PARTS, len(langs)), grams))
    return _model(langs, tables)


def _lookup(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, rates = table
    at = np.searchsorted(keys, h)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == h[hit]
    return hit, rates[at[hit]]


def word_scores(model: Model, x: K.Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log rates of each word by language; unknown ones back off through their n-grams.

    Of an unknown word the longest order with any known n-gram is taken: the
    mean over its known n-grams, less ``BACKOFF`` for each step.
    """
    out = np.zeros((len(a), len(model.langs)), np.float64)
    hit, rates = _lookup(model.tables[0], x.hashes(a, b))
    out[hit] = rates
    left = np.flatnonzero(~hit)
    y, p, q = _between_spaces(x.buf, a[left], b[left])
    open_ = np.arange(len(left))
    for step, k in enumerate(ORDERS, 1):
        if not len(open_):
            break
        at, word = grams_of(y, p[open_], q[open_], k)
        seen, rates = _lookup(model.tables[step], y.packed(at, k))
        got = np.zeros((len(open_), len(model.langs)))
        np.add.at(got, word[seen], rates)
        m = np.bincount(word[seen], minlength=len(open_))
        done = m > 0
        out[left[open_[done]]] = got[done] / m[done][:, None] + BACKOFF * step
        open_ = open_[~done]
    return out


def predict_texts(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Best language and its share of the likelihood, per mean word, for each text."""
    x = K.Texts(column, K.LOWER)
    a, b, doc = x.spans(_LETTER)
    n = np.bincount(doc, minlength=x.n)
    total = np.zeros((x.n, max(1, len(model.langs))))
    if len(a) and model.langs:
        _, first, inv = np.unique(x.names(a, b)[0], return_index=True, return_inverse=True)
        s = word_scores(model, x, a[first], b[first])
        # a type in a text counts by its number of places
        key = doc.astype(np.int64) * len(first) + inv
        pair, m = np.unique(key, return_counts=True)
        for k in range(len(model.langs)):
            total[:, k] = np.bincount(pair // len(first), m * s[pair % len(first), k], x.n)
    has = _has_letter(column, n)
    best = total.argmax(1)
    z = (total - total.max(1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
    share = 1 / np.exp(z).sum(1)
    names = [model.langs[k] if ok and model.langs else "und" for k, ok in zip(best.tolist(), has.tolist())]
    return names, np.where(has, share, 0.0)


def _has_letter(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """Whether a text has a letter; bytes from 0x80 on may be others, so those texts are looked at."""
    out = n > 0
    x = K.Texts(column)
    ascii_ = x.counts(((x.buf | 0x20) >= 0x61) & ((x.buf | 0x20) <= 0x7A))
    for k in np.flatnonzero(out & (ascii_ == 0)):
        out[k] = any(c.isalpha() for c in column[int(k)].as_py())
    return out


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", keep: Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` rows of each language: all languages of the rows, and the n-grams of all their words.

    Words longer than LONGEST and those seen once, which carry no rate of their
    own, are left out of the table of words only.  In languages written without
    spaces these are whole clauses and nearly all there is.
    """
    types = stored(word_counts(train_rows(docs, rows, id, text, lang, keep)))
    said = {r["lang"]: r["n"] for r in types.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    langs = sorted(said)
    got = types.filter((F.col("n") > 1) & (F.length("word") <= LONGEST)).toArrow().combine_chunks()
    place = {k: i for i, k in enumerate(langs)}
    own = np.array([place[v] for v in got["lang"].to_pylist()], np.int64)
    word = pa.concat_arrays(got["word"].chunks) if got.num_rows else pa.array([], pa.binary())
    tables = [_word_table(word, own, got["n"].to_numpy(), np.array([said[k] for k in langs], float), WORDS)]
    grams = stored(gram_counts(types, langs))
    sums = {(r["k"], r["lang"]): r["n"] for r in grams.groupBy("k", "lang").agg(F.sum("n").alias("n")).collect()}  # a row a language and order
    best = F.row_number().over(Window.partitionBy("k", "lang").orderBy(F.col("n").desc(), "h"))
    chosen = grams.withColumn("_r", best).filter(F.col("_r") <= GRAMS).select("k", "h").distinct()
    kept = stored(grams.join(chosen, ["k", "h"], "left_semi"))
    for k in ORDERS:
        t = kept.filter(F.col("k") == k).select("lang", "h", "n").toArrow()
        total = np.array([sums.get((k, i), 0) for i in range(len(langs))]) / _PARTS
        tables.append(_table(t["h"].to_numpy().view(np.uint64), t["lang"].to_numpy().astype(np.int64), t["n"].to_numpy() / _PARTS, total))
    return _model(langs, tables)


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Predict the language of every whole text: (id, lang_pred, score).

    Words are runs of letters of the A-Z lower-cased text.  A known word adds
    its log frequency in each language; an unseen one adds that of its longest
    known character n-grams.  ``score`` is the softmax of the sums over the
    root of the number of words.

    Null texts and texts without a letter are ``und`` with score 0; without any
    training language all are.  Repeated rows are predicted alike; an empty table
    gives no rows; extra columns are left out.  Map-only.
    """

    def fn(_, texts):
        names, score = predict_texts(model, texts)
        return {"lang_pred": pa.array(names, pa.string()), "score": score}

    named = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return map_texts(named, "_text", "lang_pred string, score double", fn, ["_id"]).withColumnRenamed("_id", id)


def language_id(docs: DataFrame, mod: int = 4, rest: int = 2) -> DataFrame:
    """Train on rows outside the held-out fold and predict all: adds ``held_out``."""
    model = train(docs, keep=~held_out("_id", mod, rest))
    return identify(docs, model).select("doc_id", held_out("doc_id", mod, rest).alias("held_out"), "lang_pred", "score")
