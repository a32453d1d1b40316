"""SimHash fingerprints and a binary-trie self-join under a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettersift.llm import textkit as K
from lettersift.llm.common import map_texts
from lettersift.operators.components import connected_components
from lettersift.session import sql_partitions, stored

SHINGLE, SEED, BUDGET = 3, 42, 3
#: fingerprints of one trie; larger ones are split by further equal bits
TRIE = 4096
#: node pairs with no more fingerprint pairs are compared directly
LEAF = 32
#: fingerprints with over 1/HOT of the rows join by broadcast
HOT = 1000


def fingerprint_texts(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Signed 64-bit views of the fingerprints: a bit is set if over half the shingle hashes have it."""
    from xxhash import xxh64_intdigest as xxh

    x = K.Texts(column, K.LOWER)
    a, b, doc = x.spans(K.INK)
    out = np.zeros(x.n, np.uint64)
    if not len(a):
        return out.view(np.int64)
    # the words again, one space apart
    size = b - a
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    shift = np.repeat(start - a, size)
    ink = np.flatnonzero(K.INK[x.buf])
    joined = np.full(int(stop[-1]) + 1, 32, np.uint8)
    joined[ink + shift] = x.buf[ink]
    joined = joined.tobytes()
    n = np.bincount(doc, minlength=x.n)
    first = np.cumsum(n) - n
    # shingles of texts with fewer words: the whole sequence
    each = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    at = np.flatnonzero(np.arange(len(a)) - first[doc] < each[doc])
    last = np.minimum(at + shingle - 1, (first + n - 1)[doc[at]])
    h = np.array([xxh(joined[p:q], seed) for p, q in zip(start[at].tolist(), stop[last].tolist())], np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(each)
    begin = (np.cumsum(each) - each)[full]
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    set_ = (2 * ones > each[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    return map_texts(docs, text, f"`{name}` long", lambda _, t: {name: fingerprint_texts(t)}, carry)


def blocks_of(path: tuple[int, ...]) -> list[int]:
    """Masks of the four blocks below ``path``: each step fixes one block of the bits still open."""
    open_ = list(range(64))
    for step in (*path, None):
        cut = [round(i * len(open_) / 4) for i in range(5)]
        parts = [open_[cut[i] : cut[i + 1]] for i in range(4)]
        if step is None:
            return [sum(1 << k for k in p) for p in parts]
        open_ = [k for i, p in enumerate(parts) if i != step for k in p]
    raise AssertionError


def fixed(path: tuple[int, ...]) -> int:
    return sum(blocks_of(path[:i])[path[i]] for i in range(len(path)))


def earlier(path: tuple[int, ...]) -> list[int]:
    """Blocks in which a pair must differ to belong to this path and no earlier one."""
    return [m for i in range(len(path)) for m in blocks_of(path[:i])[: path[i]]]


def trie_pairs(fp: np.ndarray, group: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of one group within ``budget`` bits; sorted by (group, fp).

    All groups' binary tries are walked together, level by level: a node is a
    range of the sorted fingerprints, a pair of nodes carries the bits in which
    it differs so far and ends where they exceed the budget.  Small node pairs
    are compared directly.
    """
    n = len(fp)
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    lo, hi = edge, np.r_[edge[1:], n].astype(np.int64) if n else edge
    many = hi - lo > 1
    al, ah, bl, bh = lo[many], hi[many], lo[many], hi[many]
    diff = np.zeros(len(al), np.int64)
    left, right = [], []
    ones = np.zeros(n + 1, np.int64)
    for bit in range(63, -2, -1):
        small = (ah - al) * (bh - bl) <= LEAF if bit >= 0 else np.ones(len(al), bool)
        if small.any():
            w = (bh - bl)[small]
            each = (ah - al)[small] * w
            k = np.repeat(np.arange(len(each)), each)
            r = np.arange(len(k)) - np.repeat(np.cumsum(each) - each, each)
            i, j = al[small][k] + r // w[k], bl[small][k] + r % w[k]
            near = i < j
            i, j = i[near], j[near]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= budget
            left.append(i[near])
            right.append(j[near])
            al, ah, bl, bh, diff = (v[~small] for v in (al, ah, bl, bh, diff))
        if bit < 0 or not len(al):
            break
        np.cumsum(fp >> np.uint64(bit) & np.uint64(1), out=ones[1:])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        self_ = (al == bl) & (ah == bh)
        new = [
            (al, am, bl, bm, diff),
            (am, ah, bm, bh, diff),
            (al, am, bm, bh, diff + 1),
            tuple(v[~self_] for v in (am, ah, bl, bm, diff + 1)),
        ]
        al, ah, bl, bh, diff = (np.concatenate(v) for v in zip(*new))
        keep = (ah > al) & (bh > bl) & (diff <= budget) & ~((al == bl) & (ah - al == 1))
        al, ah, bl, bh, diff = (v[keep] for v in (al, ah, bl, bh, diff))
    if not left:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(left), np.concatenate(right)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each index's component."""
    at = np.arange(n)
    while True:
        new = at.copy()
        low = np.minimum(at[i], at[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def hamming_links(fps: DataFrame, budget: int = BUDGET, trie: int = TRIE) -> DataFrame:
    """For distinct fingerprints (fp, n): rows (fp, near, root).

    ``near`` adds up to the rows of other fingerprints within ``budget`` bits,
    ``root`` links fp to its component within one trie; a fingerprint has a row
    for every trie where it has links.  Within 3 bits two fingerprints agree
    in one of four blocks, so each is put in four tries, of the fingerprints
    with which it shares a block.  A trie of over ``trie`` fingerprints is
    split in the same way by blocks of its other bits, until all fit.  A pair
    counts in the first of its tries only.
    """
    if budget != 3:
        raise ValueError("four blocks serve a budget of 3")
    spark = fps.sparkSession
    paths: list[tuple[int, ...]] = [()]
    rows = fps.select("fp", "n", F.lit(0).alias("_path"), F.lit(0).cast("long").alias("_key"))
    out = None
    while True:
        nxt = [(k, p, i) for k, p in enumerate(paths) for i in range(4)]
        new_paths = [(*p, i) for _, p, i in nxt]
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        masks = [signed(fixed(p)) for p in new_paths]
        deals = F.array(*[F.array(*[F.struct(F.lit(4 * k + i).alias("p"), F.lit(masks[4 * k + i]).cast("long").alias("m")) for i in range(4)]) for k in range(len(paths))])
        dealt = (
            rows.withColumn("_d", F.explode(F.element_at(deals, F.col("_path") + 1)))
            .select("fp", "n", F.col("_d.p").alias("_path"), F.col("fp").bitwiseAND(F.col("_d.m")).alias("_key"))
        )
        heavy = stored(dealt.groupBy("_path", "_key").agg(F.count("*").alias("_c")).filter(F.col("_c") > trie))
        n_heavy = heavy.count()
        light = dealt
        if n_heavy:
            dealt = stored(dealt.join(heavy.drop("_c").withColumn("_heavy", F.lit(True)), ["_path", "_key"], "left"))
            light = dealt.filter("_heavy is null").drop("_heavy")
        bars = [np.array(earlier(p), np.uint64) for p in new_paths]

        def run(batches: Iterator[pa.RecordBatch], bars=bars) -> Iterator[pa.RecordBatch]:
            def walk(path, key, fp, n):
                group = np.cumsum(np.r_[False, (path[1:] != path[:-1]) | (key[1:] != key[:-1])]) if len(fp) else path
                i, j = trie_pairs(fp, group)
                ok = np.ones(len(i), bool)
                d = fp[i] ^ fp[j]
                for p in np.unique(path[i]):
                    of = path[i] == p
                    for m in bars[p]:
                        ok &= ~of | (d & m != 0)
                i, j = i[ok], j[ok]
                near = np.bincount(i, n[j], len(fp)) + np.bincount(j, n[i], len(fp))
                hit = np.flatnonzero(near)
                root = roots(len(fp), i, j)
                return pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)[hit]), pa.array(near[hit].astype(np.int64)), pa.array(fp.view(np.int64)[root[hit]])],
                    names=["fp", "near", "root"],
                )

            held = None
            for batch in batches:
                cols = [np.asarray(batch.column(k)) for k in range(4)]
                if held is not None:
                    cols = [np.concatenate(v) for v in zip(held, cols)]
                path, key = cols[0], cols[1]
                # the last group may go on in the next batch
                cut = int(np.flatnonzero((path != path[-1]) | (key != key[-1])).max(initial=-1)) + 1 if len(path) else 0
                held = [v[cut:] for v in cols]
                if cut:
                    yield walk(path[:cut], key[:cut], cols[2][:cut].view(np.uint64), cols[3][:cut])
            if held is not None and len(held[0]):
                yield walk(held[0], held[1], held[2].view(np.uint64), held[3])

        # unsigned order: a flipped sign bit sorts first
        tries = (
            light.select("_path", "_key", "fp", "n")
            .repartition(sql_partitions(spark), "_path", "_key")
            .sortWithinPartitions("_path", "_key", F.col("fp") < 0, "fp")
            .mapInArrow(run, "fp long, near long, root long")
        )
        out = tries if out is None else out.unionByName(tries)
        if not n_heavy:
            return out
        used = sorted(r[0] for r in heavy.select("_path").distinct().collect())  # 4 per level at most
        paths = [new_paths[k] for k in used]
        place = F.create_map(*[F.lit(x) for i, k in enumerate(used) for x in (k, i)])
        rows = dealt.filter("_heavy").select("fp", "n", place[F.col("_path")].cast("int").alias("_path"), "_key")


def near_groups(prints: DataFrame, id: str) -> DataFrame:
    """Fingerprint classes of rows (id, fp): (fp, n, first_id, near, component)."""
    fps = stored(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(id).alias("first_id")))
    links = stored(hamming_links(fps.select("fp", "n")))
    comps = stored(connected_components(links, "fp", "root"))
    near = links.groupBy("fp").agg(F.sum("near").alias("near"))
    lead = comps.join(fps.select(F.col("fp").alias("node"), "first_id"), "node")
    least = lead.groupBy("component").agg(F.min("first_id").alias("least"))
    of = lead.join(least, "component").select(F.col("node").alias("fp"), "least", F.col("component").alias("_root"))
    return (
        fps.join(near, "fp", "left")
        .join(of, "fp", "left")
        .select(
            "fp", "n", "first_id", F.coalesce("near", F.lit(0)).alias("near"),
            F.coalesce("least", "first_id").alias("component_id"), F.coalesce("_root", "fp").alias("component_fp"),
        )
    )


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate classes by SimHash: (id, fingerprint, n_near, component_id).

    Words are lower-cased (A-Z) runs without white space; XXH64 (seed 42) of
    their 3-word shingles vote on 64 bits.  Fingerprints link at 3 or fewer
    differing bits; ``n_near`` counts the other rows linked directly and
    ``component_id`` is the least id that links lead to.

    Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows are near each other, each with a row of its own; a null id is
    never the least one, and a component of nulls has a null id.  An empty
    table gives no rows; extra columns are left out.  Texts are scanned once;
    shuffles hold fingerprints only, equal ones counted before; fingerprints
    with more than a thousandth of all rows are joined by broadcast.
    """
    named = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    prints = stored(fingerprints(named, ["_id"], "_text"))
    got = with_groups(prints, stored(near_groups(prints, "_id")), prints.count())
    return got.select(
        F.col("_id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        (F.col("n") - 1 + F.col("near")).alias("n_near"), F.col("component_id"),
    )


def with_groups(prints: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Join rows to their fingerprint's class; hot fingerprints, under HOT of them, by broadcast."""
    hot = groups.filter(F.col("n") > max(1, total / HOT))
    keys = hot.select("fp", F.lit(True).alias("_hot"))
    marked = prints.join(F.broadcast(keys), "fp", "left")
    return (
        marked.filter("_hot").join(F.broadcast(hot), "fp")
        .unionByName(marked.filter("_hot is null").join(groups.filter(F.col("n") <= max(1, total / HOT)), "fp"))
        .drop("_hot")
    )
