"""Benchmark decontamination with a positional inverted index of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettersift.llm import textkit as K
from lettersift.session import stored

#: words of a phrase
WINDOW = 10
#: places by which each word may be off in a proximity match
SLACK = 2
#: windows that one pass over the index looks up; larger test sets take several passes
BLOCK = 500_000
#: candidate places that are held at once within a segment
_CANDIDATES = 1 << 20


def _planes(v: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane: the upper planes are nearly all zero and compress away."""
    return np.ascontiguousarray(v.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index, a row for each segment of about a megabyte of whole texts.

    Columns: ``segment``, ``ids`` and ``sizes`` (words) of its documents;
    ``terms`` and ``widths``: its distinct words and their bytes; ``counts``:
    postings of each term; ``postings``: the words' places in the segment,
    ascending within each term.  Words are stored and looked up as they are, so
    no two are taken for one.  Documents are what a segment is partitioned by, so neither building
    nor intersecting moves postings.
    """
    kind = docs.schema[id].dataType.simpleString()
    thin = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in K.chunks(batch.column(1)):
                x = K.Texts(batch.column(1).slice(i, j - i), K.LOWER)
                a, b, doc = x.spans(K.ALNUM)
                ids, values = x.names(a, b)
                counts = np.bincount(ids, minlength=len(values))
                used = np.flatnonzero(counts)  # the others are what stands between words
                terms = values.take(pa.array(used))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(batch.schema.field(0).type)),
                        pa.array([np.bincount(doc, minlength=x.n)], pa.list_(pa.int64())),
                        pa.array([b"".join(terms.to_pylist())], pa.binary()),
                        pa.array([_planes(pc.binary_length(terms).to_numpy(zero_copy_only=False))], pa.binary()),
                        pa.array([_planes(counts[used])], pa.binary()),
                        pa.array([_planes(np.argsort(ids, kind="stable"))], pa.binary()),
                    ],
                    names=["ids", "sizes", "terms", "widths", "counts", "postings"],
                )

    built = thin.mapInArrow(run, f"ids array<{kind}>, sizes array<long>, terms binary, widths binary, counts binary, postings binary")
    return stored(built.withColumn("segment", F.monotonically_increasing_id()))


@dataclass
class Phrases:
    """Distinct windows of a block of test items.

    ``terms``: all their words; ``word`` (windows x width):
    term numbers, -1 beyond a short window; ``size``; ``item``: pairs (window,
    item number), sorted by window, as ``item_at`` slices.
    """

    terms: pa.Array
    word: np.ndarray
    size: np.ndarray
    item: np.ndarray
    item_at: np.ndarray
    order: np.ndarray | None = None

    def rank(self, df: np.ndarray) -> None:
        """Look the rarest words of each window up first."""
        cost = np.where(self.word >= 0, df[self.word], np.iinfo(np.int64).max)
        self.order = np.argsort(cost, axis=1, kind="stable")


def phrases(texts: list[str | None], window: int = WINDOW, block: int = BLOCK) -> Iterator[Phrases]:
    """Windows of the test items, in blocks; item numbers count through ``texts``."""
    x = K.Texts(pa.array(texts, pa.large_string()), K.LOWER)
    a, b, doc = x.spans(K.ALNUM)
    h, values = x.names(a, b)
    n = np.bincount(doc, minlength=x.n)
    begin = np.cumsum(n) - n
    size = np.minimum(n, window)
    many = np.where(n > 0, np.maximum(1, n - window + 1), 0)
    item = np.repeat(np.arange(x.n), many)
    at = begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    for k in range(0, len(item), block):
        it, st = item[k : k + block], at[k : k + block]
        sz = size[it]
        place = st[:, None] + np.arange(window)
        inside = np.arange(window) < sz[:, None]
        rows = np.where(inside, h[np.minimum(place, len(h) - 1)], 0)
        key = np.column_stack([rows, sz])
        _, first, inv = np.unique(key, axis=0, return_index=True, return_inverse=True)
        pair = np.unique(np.column_stack([inv.ravel(), it]), axis=0)
        terms = np.unique(rows[inside])
        word = np.where(inside[first], np.searchsorted(terms, rows[first]), -1)
        yield Phrases(values.take(pa.array(terms)), word, sz[first], pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(first) + 1)))


def _found(p_terms: pa.Array, terms: bytes, widths: bytes) -> np.ndarray:
    """The place of each test term among a segment's terms, -1 if it isn't there."""
    cuts = np.zeros(len(widths) // 4 + 1, np.int64)
    np.cumsum(_from_planes(widths), out=cuts[1:])
    own = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(terms)])
    return pc.fill_null(pc.index_in(p_terms.cast(pa.large_binary()), value_set=own), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def frequencies(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """Postings of each of the terms in the whole index; reads three of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for t, w, c in zip(*(batch.column(k) for k in range(3))):
                at = _found(terms, t.as_py(), w.as_py())
                total[at >= 0] += _from_planes(c.as_py())[at[at >= 0]]
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    got = index.select("terms", "widths", "counts").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms), np.int64)
    df[got["k"].to_numpy()] = got["n"].to_numpy()
    return df


def _decode(p: Phrases, terms: bytes, widths: bytes, counts: bytes, postings: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a segment: term number at each place (-1: no test word), postings, and each test term's slice of them.

    None where no test term occurs.
    """
    k = _found(p.terms, terms, widths)
    hit = np.flatnonzero(k >= 0)
    if not len(hit):
        return None
    c, pos = _from_planes(counts), _from_planes(postings)
    lo, n = np.zeros(len(p.terms), np.int64), np.zeros(len(p.terms), np.int64)
    n[hit] = c[k[hit]]
    lo[hit] = np.cumsum(c)[k[hit]] - n[hit]
    own = np.full(len(c), -1, np.int32)
    own[k[hit]] = hit
    at = np.empty(len(pos), np.int32)
    at[pos] = np.repeat(own, c)
    return at, pos, lo, n


def intersect(p: Phrases, at: np.ndarray, pos: np.ndarray, lo: np.ndarray, n: np.ndarray, bound: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Matches in one segment: (window, start, exact).

    The postings of a window's rarest word, less its offset, are the first
    list of starts; the others' postings are intersected with it from rare to
    usual.  ``bound``: first place of each document, and the end.  A start
    lives while every word so far is within ``slack`` of its place in the same
    document; it is exact if each is at its place.  Windows of fewer words than
    a phrase match exactly only.
    """
    wide = p.word.shape[1]
    first = p.order[:, 0]
    many = n[p.word[np.arange(len(first)), first]]
    todo = np.flatnonzero(many)
    cost = np.cumsum(many[todo])
    i = 0
    while i < len(todo):
        j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + _CANDIDATES, "right")))
        w = todo[i:j]
        i = j
        m = many[w]
        r = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        w = np.repeat(w, m)
        start = pos[lo[p.word[w, first[w]]] + r] - first[w]
        doc = np.searchsorted(bound, start + first[w], "right") - 1
        begin, end = bound[doc], bound[doc + 1]
        exact = (start >= begin) & (start + p.size[w] <= end)
        live = exact | (p.size[w] == wide)
        w, start, begin, end, exact = (v[live] for v in (w, start, begin, end, exact))
        for k in range(1, wide):
            if not len(w):
                break
            off = p.order[w, k]
            need = p.word[w, off]
            done = need < 0
            place = start + off
            here = (place >= begin) & (place < end)
            here &= at[np.where(here, place, 0)] == need
            exact &= here | done
            near = here | done
            full = (p.size[w] == wide) & ~near
            for d in range(1, slack + 1):
                for q in (place - d, place + d):
                    ok = full & (q >= begin) & (q < end)
                    near |= ok & (at[np.where(ok, q, 0)] == need)
            w, start, begin, end, exact = (v[near] for v in (w, start, begin, end, exact))
        yield w, start, exact


def _merge(doc, item, start, stop, exact):
    """Runs of overlapping spans of one document, item and kind."""
    o = np.lexsort((start, exact, item, doc))
    doc, item, start, stop, exact = (v[o] for v in (doc, item, start, stop, exact))
    if not len(doc):
        return doc, item, start, stop, exact
    # windows of one item are of one size, so stops ascend with starts
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (exact[1:] != exact[:-1]) | (start[1:] > stop[:-1])]
    k = np.flatnonzero(new)
    last = np.r_[k[1:], len(doc)] - 1
    return doc[k], item[k], start[k], stop[last], exact[k]


def lookup(index: DataFrame, p: Phrases, slack: int = SLACK) -> DataFrame:
    """Exact and proximity matches of a block: (segment, row, item, start, stop, exact), places in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, sizes, *held in zip(*(batch.column(k) for k in range(6))):
                decoded = _decode(p, *(v.as_py() for v in held))
                if decoded is None:
                    continue
                at, pos, lo, n = decoded
                bound = np.r_[0, np.cumsum(np.array(sizes.as_py(), np.int64))].astype(np.int64)
                found = []
                # empty documents share their bound with the next one; the last such has the words
                for w, start, exact in intersect(p, at, pos, lo, n, bound, slack):
                    many = p.item_at[w + 1] - p.item_at[w]
                    r = np.repeat(np.arange(len(w)), many)
                    item = p.item[np.repeat(p.item_at[w], many) + np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)]
                    mid = start[r] + p.order[w[r], 0]
                    doc = np.searchsorted(bound, mid, "right") - 1
                    a, b = np.maximum(start[r], bound[doc]), np.minimum(start[r] + p.size[w[r]], bound[doc + 1])
                    found.append(np.column_stack([doc, item, a - bound[doc], b - bound[doc], exact[r]]))
                if not found:
                    continue
                doc, item, a, b, exact = _merge(*np.concatenate(found).astype(np.int64).T)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), seg.as_py())), pa.array(doc), pa.array(item), pa.array(a), pa.array(b), pa.array(exact.astype(bool))],
                    names=["segment", "row", "item", "start", "stop", "exact"],
                )

    return index.select("segment", "sizes", "terms", "widths", "counts", "postings").mapInArrow(
        run, "segment long, row long, item long, start long, stop long, exact boolean"
    )


def _union_size(spans: DataFrame, name: str) -> DataFrame:
    """Places that the spans of each (segment, row) cover."""
    before = Window.partitionBy("segment", "row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("stop").over(before), F.lit(0))
    new = F.greatest(F.col("stop") - F.greatest("start", seen), F.lit(0))
    return spans.select("segment", "row", new.alias("_new")).groupBy("segment", "row").agg(F.sum("_new").alias(name))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, slack: int = SLACK, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Documents and matches: (id, segment, row, n_words, n_hit, n_near, items) and (segment, row, item id, start, stop, exact).

    Texts are lower-cased (A-Z); words are runs of letters, digits and bytes
    from 0x80 on.  A test item's phrases are its runs of ``window`` words, or all
    of it where it has fewer.  ``n_hit`` counts the words inside exact
    occurrences, ``n_near`` those inside proximity matches; ``items`` are the
    sorted ids, as strings, with exact occurrences.

    Null and empty texts and items have no words and no matches.  Repeated rows
    and items are matched alike; an item with a null id marks words but isn't
    listed.  An empty table gives no rows, an empty benchmark no matches; extra
    columns are left out.  The test set is the query set: its texts go to the
    driver, and blocks of ``block`` windows at a time to the tasks.
    """
    tests = benchmark.select(F.col(f"`{item}`").alias("_i"), F.col(f"`{item_text}`").alias("_t")).filter("_t is not null").toArrow()  # the query set
    names = [None if v is None else str(v) for v in tests["_i"].to_pylist()]
    index = build_index(docs, id, text)
    found = None
    for p in phrases(tests["_t"].to_pylist(), window, block):
        p.rank(frequencies(index, p.terms))
        got = stored(lookup(index, p, slack))
        found = got if found is None else found.unionByName(got)
    spark = docs.sparkSession
    if found is None:
        found = spark.createDataFrame([], "segment long, row long, item long, start long, stop long, exact boolean")
    # a row for each test item
    called = spark.createDataFrame([(k, v) for k, v in enumerate(names)], "item long, item_id string")
    found = found.join(called, "item").drop("item")
    exact = found.filter("exact")
    marks = _union_size(exact, "n_hit").join(exact.groupBy("segment", "row").agg(F.array_sort(F.collect_set("item_id")).alias("items")), ["segment", "row"])
    near = _union_size(found.filter("not exact"), "n_near")
    rows = index.select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("row", "_z"))
    rows = rows.select("segment", F.col("row").cast("long").alias("row"), F.col("_z.ids").alias(id), F.col("_z.sizes").alias("n_words"))
    out = rows.join(marks, ["segment", "row"], "left").join(near, ["segment", "row"], "left")
    zero = F.lit(0).cast("long")
    return (
        out.select(
            id, "segment", "row", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_near", zero).alias("n_near"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ),
        found,
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id") -> DataFrame:
    """The digest of ``contamination``: (id, n_words, n_hit, n_items, items_sha256, contaminated, n_near).

    ``n_near``: words inside proximity matches, which contaminate no document.
    """
    got, _ = contamination(docs, benchmark, id)
    return got.select(
        id, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )


#: DuckDB SQL for the digest
SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as g
       from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct k from bw),
dw as (select r, i, k, array_to_string(w[i : i + k - 1], ' ') as g
       from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k)),
hits as (select r, i, dw.k, item_id from dw join bw on dw.g = bw.g and dw.k = bw.k),
places as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from (select distinct r, i, k from hits)) group by r),
df as (select t, count(*) as c from (select unnest(w) as t from d) group by t),
whole as (select g, string_split(g, ' ') as ws from (select distinct g from bw where k = 10)),
off as (select g, ws, j, ws[j + 1] as t from (select g, ws, unnest(range(10)) as j from whole)),
rare as (select g, any_value(ws) as ws, arg_min(j, coalesce(c, 0) * 16 + j) as j from off left join df using (t) group by g),
pos as (select r, q, w[q] as t from (select r, w, unnest(range(1, len(w) + 1)) as q from d)),
cand as (select r, ws, q - j as s from pos join (select ws, j, ws[j + 1] as t from rare) using (t)),
close_ as (select r, s, len(w) as n from cand join d using (r) where not (s >= 1 and s + 9 <= len(w) and w[s : s + 9] = ws)
           and len(list_filter(range(10), lambda j: s + j + 2 >= 1 and list_contains(w[greatest(s + j - 2, 1) : s + j + 2], ws[j + 1]))) = 10),
nears as (select r, count(distinct p) as n_near from (select r, unnest(range(greatest(s, 1), least(s + 10, n + 1))) as p from close_) group by r),
items as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, cast(coalesce(n_near, 0) as bigint) as n_near
from d left join places using (r) left join items using (r) left join nears using (r)
"""
