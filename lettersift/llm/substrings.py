"""Substring dedup by suffix trees: variable-length prefixes deal the suffixes to groups, each sorted with common prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettersift.llm import textkit as K
from lettersift.session import sql_partitions, stored

#: words of a repeat, at least
WINDOW = 13
#: words of a minimiser; a window holds WINDOW - SEED + 1 of them
SEED = 6
#: prefix lengths in words, tried in this order until a prefix is rare enough
LEVELS = (1, 2, 3, 4, SEED)
#: text bytes of a group, about
GROUP_BYTES = 32 << 20
#: text bytes of a chunk: what one task looks at together
_CHUNK = 3 << 20
_MAX = (1 << 63) - 1
#: kinds of exchanged rows: seeds or runs of windows, decided places, a chunk's documents, usual prefixes
ENTRY, PLACE, DOCS, PREFIX = range(4)
_COLS = ["g", "chunk", "kind", "k", "lo", "doc", "pos", "ids"]
_SCHEMA = "g int, chunk long, kind int, k binary, lo binary, doc binary, pos binary, ids binary"


def _pack(v: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(v.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _unpack(b: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


class Suffixes:
    """The suffixes of some texts that are WINDOW words long at least."""

    def __init__(self, column: pa.Array, window: int = WINDOW):
        self.x = K.Texts(column)
        self.a, self.b, self.doc = self.x.spans(K.INK)
        self.ids, self.values = self.x.names(self.a, self.b)
        self.h = K.hashes_of(self.values)[self.ids] if len(self.a) else np.zeros(0, np.uint64)
        self.n = np.bincount(self.doc, minlength=self.x.n)
        self.first = np.cumsum(self.n) - self.n
        self.at = np.flatnonzero(K.inside(self.doc, window))

    def minimisers(self, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of the least SEED-word hash in each window, the leftmost of equal ones."""
        seeds = K.ngrams(self.h, SEED)
        last = window - SEED
        at = self.at + last
        best = seeds[at]
        for j in range(last - 1, -1, -1):
            c = seeds[self.at + j]
            low = c <= best
            best = np.where(low, c, best)
            at = np.where(low, self.at + j, at)
        return best, at


def ranks(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of the WINDOW words from each start on, and of the 1, 2, 4 and 8 words from each place on.

    Prefix doubling: the rank of twice as many words is that of a pair of
    ranks, so equal ranks mean equal words and ranks ascend in word order.
    """
    level = [ids]
    for n in (1, 2, 4):
        r = level[-1]
        level.append(K.pairs(r[:-n], r[n:]) if len(r) > n else np.zeros(0, np.int64))
    return K.pairs(level[3][starts], level[3][starts + WINDOW - 8]) if len(starts) else np.zeros(0, np.int64), level


def suffix_array(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts``, WINDOW words of each, in order, and each one's common words with the one before.

    These are the leaves of the group's tree and the depths of the inner nodes
    between them; nodes below depth WINDOW aren't told apart here, as a longer
    repeat is a run of windows.
    """
    r, level = ranks(ids, starts)
    order = np.argsort(r, kind="stable")
    lcp = np.zeros(len(order), np.int64)
    if len(order):
        i, j = starts[order[1:]], starts[order[:-1]]
        n = np.zeros(len(i), np.int64)
        for k in (3, 2, 1, 0):
            p, q = np.minimum(i + n, len(level[k]) - 1), np.minimum(j + n, len(level[k]) - 1)
            n += np.where(level[k][p] == level[k][q], 1 << k, 0)
        lcp[1:] = np.where(r[order[1:]] == r[order[:-1]], WINDOW, np.minimum(n, WINDOW - 1))
    return order, lcp


def _represent(key: np.ndarray, rank: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks: entries of each key's least rank, of larger ranks, and of keys of several documents.

    Equal keys are brought together here, before any shuffle, so a hot repeat
    leaves a chunk once, however many copies are in it.
    """
    o = np.lexsort((doc, rank, key))
    k, r, d = key[o], rank[o], doc[o]
    least, later, shared = (np.zeros(len(o), bool) for _ in range(3))
    if len(o):
        new = np.r_[True, k[1:] != k[:-1]]
        start, node = np.flatnonzero(new), np.cumsum(new) - 1
        least[o] = r == r[start][node]
        later[o] = r > r[start][node]
        shared[o] = np.logical_or.reduceat(d != d[start][node], start)[node]
    return least, later, shared


def _cuts(v: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cut = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]).tolist() if len(v) else []
    yield from zip(cut, [*cut[1:], len(v)])


def _seed_rows(chunk: int, s: Suffixes, mine: np.ndarray, key, place, group, rank: np.ndarray, _) -> Iterator[tuple]:
    """Seeds as a row for each group: sorted keys as differences, byte plane by byte plane."""
    key, place, group = key[mine], place[mine], group[mine]
    o = np.lexsort((key, group))
    key, place, group = key[o], place[o], group[o]
    doc = s.doc[place]
    for p, q in _cuts(group):
        k = key[p:q].copy()
        k[1:] -= key[p : q - 1]
        yield int(group[p]), chunk, ENTRY, _pack(k, 8), None, _pack(doc[p:q], 4), _pack(place[p:q] - s.first[doc[p:q]], 4), None


def _window_rows(chunk: int, s: Suffixes, mine: np.ndarray, key, place, group, rank: np.ndarray, anchor: np.ndarray) -> Iterator[tuple]:
    """Windows as a row for each group: the words of runs of neighbouring windows, so that each is written about once.

    ``k``: the words between spaces; ``lo``: windows of each run; ``doc`` and
    ``pos``: where the run starts; ``ids``: ranks of the group's documents,
    ascending by place in the chunk.
    """
    place, group, anchor = place[mine], group[mine], anchor[mine]
    o = np.lexsort((place, group))
    place, group, anchor = place[o], group[o], anchor[o]
    if not len(place):
        return
    new = np.r_[True, (place[1:] != place[:-1] + 1) | (group[1:] != group[:-1]) | (anchor[1:] != anchor[:-1])]
    first = np.flatnonzero(new)
    many = np.diff(np.r_[first, len(place)])
    start, group = place[first], group[first]
    n = many + WINDOW - 1
    word = np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    size = s.b[word] - s.a[word]
    stop = np.cumsum(size + 1)
    text = np.full(int(stop[-1]), 32, np.uint8)
    k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(stop - size - 1, size) + k] = s.x.buf[np.repeat(s.a[word], size) + k]
    raw, end = text.tobytes(), np.r_[0, stop[np.cumsum(n) - 1]]
    doc = s.doc[start]
    for p, q in _cuts(group):
        d = doc[p:q]
        yield int(group[p]), chunk, ENTRY, raw[end[p] : end[q]], _pack(many[p:q], 2), _pack(d, 4), _pack(start[p:q] - s.first[d], 4), rank[np.unique(d)].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)], names=_COLS)


def _scan(docs: DataFrame, entries: Callable, write: Callable, groups: int, ids: list[str], symmetric: bool) -> DataFrame:
    """Exchange rows of ``docs`` (columns ``ids``, text, more): ``entries(suffixes, batch)`` gives keys to
    compare and ``write`` the rows of those that must be compared with other chunks'.

    Keys that several documents of a chunk share are decided for all but the least
    of them, and for that too if ``symmetric``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.schema.get_field_index("text")
            for i, j in K.chunks(batch.column(t), _CHUNK):
                rows = batch.slice(i, j - i)
                s = Suffixes(rows.column(t))
                if not len(s.at):
                    continue
                names = np.column_stack([np.asarray(rows.column(k)) for k in range(len(ids))]).astype(np.int64)
                # from what is in the chunk: the same on every attempt
                chunk = int(K.mix((names.view(np.uint64) * K.PLACE[: len(ids)]).sum(1) + np.arange(len(names)).astype(np.uint64)).sum() >> np.uint64(1))
                key, place, group, anchor, prefixes = entries(s, rows)
                mine, later, shared = _represent(key, names[s.doc[place], 0], s.doc[place])
                other = shared if symmetric else later
                doc = s.doc[place]
                pos = place - s.first[doc]
                home = chunk % groups
                out = [(home, chunk, DOCS, None, None, None, None, names.tobytes())]
                if other.any():
                    out.append((home, chunk, PLACE, None, None, _pack(doc[other], 4), _pack(pos[other], 4), None))
                if prefixes is not None:
                    out.append((home, chunk, PREFIX, prefixes[0].tobytes(), None, None, _pack(prefixes[1], 4), None))
                out += write(chunk, s, mine, key, place, group, names[:, 0], anchor)
                yield _batch(out)

    return docs.mapInArrow(run, _SCHEMA)


def _by(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of a sorted partition, a group at a time."""
    held: dict[str, list] | None = None
    for batch in batches:
        cols = batch.to_pydict()
        k = cols[key]
        p = 0
        for q in range(1, len(k) + 1):
            if q == len(k) or k[q] != k[p]:
                part = {c: v[p:q] for c, v in cols.items()}
                if held is not None and held[key][0] == part[key][0]:
                    for c in held:
                        held[c] += part[c]
                else:
                    if held is not None:
                        yield held
                    held = part
                p = q
    if held is not None:
        yield held


def _seeds_elsewhere(entries: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, doc, pos) of the seeds whose hash is in several chunks."""
    key = np.concatenate([np.cumsum(_unpack(e[1], 8)) for e in entries])
    doc, pos = (np.concatenate([_unpack(e[k], 4) for e in entries]) for k in (3, 4))
    chunk = np.repeat([e[0] for e in entries], [len(e[3]) // 4 for e in entries])
    o = np.argsort(key, kind="stable")
    key, doc, pos, chunk = key[o], doc[o], pos[o], chunk[o]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    apart = np.minimum.reduceat(chunk, start) != np.maximum.reduceat(chunk, start)
    hit = np.repeat(apart, np.diff(np.r_[start, len(key)]))
    return chunk[hit], doc[hit], pos[hit]


def _later_leaves(entries: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, doc, pos) of the leaves below nodes of depth WINDOW that aren't of the node's least document."""
    x = K.Texts(pa.array([b"".join(e[1] for e in entries)], pa.large_binary()))
    ids, values = x.names(*x.spans(K.INK)[:2])
    # numbers in the order of the words
    ids = pc.rank(values, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)[ids]
    many = np.concatenate([_unpack(e[2], 2) for e in entries]).astype(np.int64)
    n = many + WINDOW - 1
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    starts = np.repeat(np.cumsum(n) - n, many) + inner
    doc, pos, rank = [], [], []
    for _, _, _, d, p, names in entries:
        d = _unpack(d, 4)
        doc.append(d)
        pos.append(_unpack(p, 4))
        rank.append(np.frombuffer(names, np.int64)[np.searchsorted(np.unique(d), d)])
    doc, pos, rank = (np.repeat(np.concatenate(v), many) for v in (doc, pos, rank))
    chunk = np.repeat(np.repeat([e[0] for e in entries], [len(e[3]) // 4 for e in entries]), many)
    order, lcp = suffix_array(ids, starts)
    first = np.flatnonzero(lcp < WINDOW)
    least = np.repeat(np.minimum.reduceat(rank[order], first), np.diff(np.r_[first, len(order)]))
    hit = order[rank[order] > least]
    return chunk[hit], doc[hit], pos[hit] + inner[hit].astype(np.uint32)


def _decide(rows: DataFrame, decide: Callable, parts: int) -> DataFrame:
    """Bring each group together and tell the chunks which of their places it decides; the other kinds of rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _by("g", batches):
            out, entries = [], []
            for chunk, kind, k, lo, doc, pos, ids in zip(g["chunk"], g["kind"], g["k"], g["lo"], g["doc"], g["pos"], g["ids"]):
                if kind == ENTRY:
                    entries.append((chunk, k, lo, doc, pos, ids))
                else:
                    out.append((0, chunk, kind, k, None, doc, pos, ids))
            if entries:
                chunk, doc, pos = decide(entries)
                o = np.argsort(chunk, kind="stable")
                doc, pos, chunk = doc[o], pos[o], chunk[o]
                out += [(0, int(chunk[p]), PLACE, None, None, _pack(doc[p:q], 4), _pack(pos[p:q], 4), None) for p, q in _cuts(chunk)]
            if out:
                yield _batch(out)

    return rows.repartition(parts, "g").sortWithinPartitions("g", "chunk", "kind").mapInArrow(run, _SCHEMA)


def _places(decided: DataFrame, parts: int) -> DataFrame:
    """Decided places of each document: (kid, th, places), 32-bit and ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _by("chunk", batches):
            doc = [_unpack(b, 4) for b, kind in zip(g["doc"], g["kind"]) if kind == PLACE]
            pos = [_unpack(b, 4) for b, kind in zip(g["pos"], g["kind"]) if kind == PLACE]
            if not doc:
                continue
            names = np.frombuffer(next(b for b, kind in zip(g["ids"], g["kind"]) if kind == DOCS), np.int64).reshape(-1, 2)
            both = np.unique(np.concatenate(doc).astype(np.uint64) << np.uint64(32) | np.concatenate(pos).astype(np.uint64))
            doc = (both >> np.uint64(32)).astype(np.int64)
            pos = (both & np.uint64(0xFFFFFFFF)).astype("<u4")
            cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            u = doc[cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[u, 0]), pa.array(names[u, 1]), pa.array([pos[p:q].tobytes() for p, q in zip(cut, [*cut[1:], len(doc)])], pa.binary())],
                names=["kid", "th", "places"],
            )

    thin = decided.filter(F.col("kind") != PREFIX).select("chunk", "kind", "doc", "pos", "ids")
    got = thin.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, "kid long, th long, places binary")
    # repeated rows have the same places
    return got.groupBy("kid", "th").agg(F.max("places").alias("places"))


def usual_prefixes(s: Suffixes, at: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Prefixes that begin more than half of ``share`` of the suffixes at ``at``, and how many."""
    keys, counts = [], []
    least = max(8, len(at) * share / 2)
    for n in LEVELS:
        u, inv, c = np.unique(K.ngrams(s.h, n, 40)[at], return_inverse=True, return_counts=True)
        big = c > least
        if not big.any():
            break
        keys.append(u[big])
        counts.append(c[big])
        at = at[big[inv]]
    return (np.concatenate(keys), np.concatenate(counts)) if keys else None


def prefix_groups(s: Suffixes, place: np.ndarray, at: np.ndarray, heavy: np.ndarray, groups: int) -> np.ndarray:
    """Group of each window: the shortest prefix of the suffix at ``at`` that isn't heavy decides, all words of the window at the last."""
    out = K.ngrams(s.h, WINDOW, 40)[place] if len(place) else np.zeros(0, np.uint64)
    open_ = np.arange(len(at))
    for n in LEVELS:
        k = K.ngrams(s.h, n, 40)[at[open_]] if len(open_) else np.zeros(0, np.uint64)
        p = np.searchsorted(heavy, k)
        big = p < len(heavy)
        big[big] = heavy[p[big]] == k[big]
        out[open_[~big]] = k[~big]
        open_ = open_[big]
    return (K.mix(out) % np.uint64(groups)).astype(np.int64)


def repeated_places(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(keyed texts, places): where windows start that a document with a smaller id has too.

    1. Each window's anchor, the least of its runs of SEED words by hash, goes
       to its hash group as 48 bits; there are about a fifth as many as words.
       Windows whose anchor is in no other document can't repeat and are out.
    2. The other windows go to the group of a prefix of the suffix that starts
       at their anchor: equal windows have equal ones, and neighbours share
       theirs, so that a run of windows is sent as one piece of text instead of
       once a suffix.  A prefix grows word by word until it begins a bounded
       share of all anchored suffixes, so groups have one size however usual a
       word is.
    3. A group sorts its suffixes by prefix doubling, finds the common words of
       neighbours, and takes the nodes of depth WINDOW: their leaves, but for
       those of the least document, are repeats.  Words are compared as they
       are, not by hashes.  Windows next to each other join to the maximal
       repeats, which are the deeper nodes.
    """
    spark = docs.sparkSession
    parts = sql_partitions(spark)
    groups = 4 * parts
    keyed = docs.select(
        F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_MAX)).alias("kid"),
        F.xxhash64(F.col(f"`{text}`"), F.col(f"`{id}`").isNull()).alias("th"),
        F.col(f"`{text}`").alias("text"), F.col(f"`{id}`").isNull().alias("none"),
    )
    share = 1.0 / groups

    def seeds(s: Suffixes, _):
        best, at = s.minimisers()
        place, first = np.unique(at, return_index=True)
        key = best[first] >> np.uint64(16)
        return key, place, (K.mix(key) % np.uint64(groups)).astype(np.int64), None, usual_prefixes(s, place, share)

    first = stored(_decide(_scan(keyed.drop("none"), seeds, _seed_rows, groups, ["kid", "th"], True), _seeds_elsewhere, parts))
    # at most groups * 2 prefixes of each length
    usual = first.filter(F.col("kind") == PREFIX).select("k", "pos").mapInArrow(_prefix_counts, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
    chunks = first.filter(F.col("kind") == DOCS).count()
    # a word has about six bytes, an anchor is every fourth
    heavy = np.sort(np.array([r["p"] for r in usual.filter(F.col("n") > chunks * _CHUNK * share / 24).collect()], np.int64).view(np.uint64))
    some = _places(first, parts).withColumnRenamed("places", "seeds")
    trees = max(groups, chunks * _CHUNK // GROUP_BYTES)

    def windows(s: Suffixes, rows: pa.RecordBatch):
        _, at = s.minimisers()
        marked = np.zeros(len(s.h) + 1, bool)
        for d, b in enumerate(rows.column(rows.schema.get_field_index("seeds")).to_pylist()):
            marked[s.first[d] + np.frombuffer(b, "<u4").astype(np.int64)] = True
        open_ = marked[at]
        place, at = s.at[open_], at[open_]
        return ranks(s.ids, place)[0], place, prefix_groups(s, place, at, heavy, trees), at, None

    # sorted by key on both sides, so that a chunk is the same on every attempt
    texts = keyed.repartition(parts, "kid", "th")
    held = texts.hint("merge").join(some, ["kid", "th"]).select("kid", "th", "text", "seeds")
    return texts, _places(_decide(_scan(held, windows, _window_rows, trees, ["kid", "th"], False), _later_leaves, parts), parts)


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(_unpack(n, 4).astype(np.int64))], names=["p", "n"])


def keep_words(column: pa.Array, places: list[bytes | None], window: int = WINDOW) -> dict[str, object]:
    """Words, removed words and the digest of the kept words, of each text."""
    x = K.Texts(column)
    a, b, doc = x.spans(K.INK)
    n = np.bincount(doc, minlength=x.n)
    first = np.cumsum(n) - n
    starts = [first[d] + np.frombuffer(p, "<u4").astype(np.int64) for d, p in enumerate(places) if p]
    gone = K.cover(np.concatenate(starts), window, len(a)) if starts else np.zeros(len(a), bool)
    keep = ~gone
    a, b, kept = a[keep], b[keep], np.bincount(doc[keep], minlength=x.n)
    size = b - a
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    to = np.cumsum(size + 1) - size - 1
    k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + k] = x.buf[np.repeat(a, size) + k]
    raw = out.tobytes()
    end = np.r_[0, to + size + 1]
    stop = np.cumsum(kept)
    lo, hi = end[stop - kept].tolist(), end[stop].tolist()
    texts = [raw[p : q - 1] if q > p else b"" for p, q in zip(lo, hi)]
    return {"n_words": n, "n_removed": n - kept, "kept": texts}


def dedup_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """Remove every word in a window of WINDOW words that also starts in a document with a smaller id.

    Returns (id, n_words, n_removed, kept_sha256) and with ``texts`` also the kept
    text (words joined by one space) and the removed spans (start, stop in words).
    Words are runs without white space, unchanged; windows are judged on the
    input.  Null and empty texts have no words; texts shorter than a window keep
    all.  A null id counts as the largest and equal to other nulls.
    Repeated rows (id and text) are treated alike, one row each; an empty table
    gives no rows; extra columns are left out.  Ids are whole numbers; null
    takes the place of the largest one in the order.
    """
    keyed, places = repeated_places(docs, id, text)
    kind = docs.schema[id].dataType.simpleString()
    both = keyed.join(places, ["kid", "th"], "left").select("kid", "text", "places", "none")
    more = ", text string, spans array<struct<start:int,stop:int>>" if texts else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in K.chunks(batch.column(1)):
                rows = batch.slice(i, j - i)
                p = rows.column(2).to_pylist()
                got = keep_words(rows.column(1), p)
                cols = [pc.if_else(rows.column(3), pa.scalar(None, pa.int64()), rows.column(0)), pa.array(got["n_words"]), pa.array(got["n_removed"]), pa.array([sha256(t).hexdigest() for t in got["kept"]])]
                names = ["kid", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    cols += [pa.array([t.decode() for t in got["kept"]], pa.string()), pa.array([_spans(b) for b in p], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
                    names += ["text", "spans"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = both.mapInArrow(run, f"kid long, n_words long, n_removed long, kept_sha256 string{more}")
    return out.withColumn("kid", F.col("kid").cast(kind)).withColumnRenamed("kid", id)


def _spans(places: bytes | None) -> list[dict[str, int]]:
    if not places:
        return []
    p = np.frombuffer(places, "<u4").astype(np.int64)
    cut = np.flatnonzero(np.r_[True, p[1:] > p[:-1] + WINDOW])
    return [{"start": int(p[i]), "stop": int(p[j - 1]) + WINDOW} for i, j in zip(cut, [*cut[1:], len(p)])]


#: DuckDB SQL for the digest
SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, doc_id, i, array_to_string(w[i : i + 12], ' ') as g from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
least_ as (select g, min(doc_id) as m from win group by g),
gone as (select distinct r, p from (select r, unnest(range(i, i + 13)) as p from win join least_ using (g) where m < coalesce(doc_id, 9223372036854775807))),
word as (select r, p, w[p] as t from (select r, w, unnest(range(1, len(w) + 1)) as p from d)),
kept as (select r, string_agg(t, ' ' order by p) as s from word anti join gone using (r, p) group by r),
cnt as (select r, count(*) as n from gone group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join kept using (r) left join cnt using (r)
"""
