"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettersift.llm import textkit as K
from lettersift.llm.common import map_texts, salted_join
from lettersift.session import sql_partitions, stored

#: weights of the sources in code point order, repeating
WEIGHTS = (5.0, 2.0, 1.0)
#: a source's target stops at so many times its size, a document's words likewise
MOST = 3
#: documents that one flight balances; any number of flights run side by side
BLOCK = 20_000
_EPS = 1e-9
#: what equal rows have in common
_UNIT = ["source", "_id", "_md5", "_size"]


def targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Target of each row (source, source_size, n_docs): weighted shares of all sizes.

    A target stops at ``most`` times its source's size and the excess is shared
    again by weight.  In order of size/weight the capped sources come first, so
    one pass of running sums finds the level.  The windows without a key run
    over one row per source and spill where those are many.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    everything = Window.partitionBy()
    got = (
        sources.withColumn("_w", F.element_at(w, (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("_cap", most * F.col("source_size").cast("double"))
        .withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_wall", F.sum("_w").over(everything))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_wbefore", F.coalesce(F.sum("_w").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        # the level if the sources before this one are those that stop
        .withColumn("_level", (F.col("_all") - F.col("_before")) / (F.col("_wall") - F.col("_wbefore")))
        .withColumn("_stops", F.col("_level") * F.col("_w") > F.col("_cap"))
    )
    # the first source that doesn't stop gives the level
    first = F.min(F.when(~F.col("_stops"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(everything)
    got = got.withColumn("_lambda", first["_level"])
    return got.select(
        "source", "source_size", "n_docs",
        F.least(F.col("_cap"), F.coalesce(F.col("_lambda"), F.lit(float("inf"))) * F.col("_w")).alias("target"),
    )


def flight(p: np.ndarray, size: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Move inclusion probabilities until at most two are left between 0 and 1.

    Constraints: the number of documents and of words that are taken.  Each step
    takes three open units, moves along the null space of their constraints and
    stops where one of them reaches 0 or 1; both totals stay as they were.
    """
    p = p.astype(float).tolist()
    s = size.astype(float).tolist()
    u = pick.tolist()
    live: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = 0.0 if p[i] <= _EPS else 1.0
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            # v with v_a + v_b + v_c = 0 and s_a v_a + s_b v_b + s_c v_c = 0
            va, vb, vc = s[b] - s[c], s[c] - s[a], s[a] - s[b]
            if va == vb == vc == 0:
                va, vb, vc = 1.0, -1.0, 0.0
            up = down = float("inf")
            for k, v in ((a, va), (b, vb), (c, vc)):
                if v > 0:
                    up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
                elif v < 0:
                    up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
            step = up if u[i] * (up + down) < down else -down
            keep = []
            for k, v in ((a, va), (b, vb), (c, vc)):
                p[k] += step * v
                if p[k] <= _EPS or p[k] >= 1 - _EPS:
                    p[k] = 0.0 if p[k] < 0.5 else 1.0
                else:
                    keep.append(k)
            live = keep
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the few open units so that the words come nearest to what they should be."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    want, docs = float((p[open_] * size[open_]).sum()), float(p[open_].sum())
    best = min(
        range(1 << len(open_)),
        key=lambda m: (
            abs(sum(int(size[k]) for j, k in enumerate(open_) if m >> j & 1) - want),
            abs(bin(m).count("1") - docs),
            m,
        ),
    )
    p = p.copy()
    for j, k in enumerate(open_):
        p[k] = float(best >> j & 1)
    return p


def settle(p: np.ndarray, wanted: np.ndarray, size: np.ndarray, most: int = 8) -> np.ndarray:
    """Change at most ``most`` decided units so that the words come nearest to what ``wanted`` asks for.

    A long document in the landing can miss the words by half its size; each
    change takes or leaves the unit whose size is nearest to what is missing.
    Only units that were open change.
    """
    p = p.copy()
    free = (wanted > _EPS) & (wanted < 1 - _EPS) & (size > 0)
    for _ in range(most):
        miss = float((wanted * size).sum() - (p * size).sum())
        k = np.flatnonzero(free & (p == (0.0 if miss > 0 else 1.0)))
        if not len(k):
            break
        k = k[np.argmin(np.abs(size[k] - abs(miss)))]
        if abs(abs(miss) - size[k]) >= abs(miss):
            break
        p[k] = 1.0 - p[k]
    return p


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_h", "_size"], kind="stable").reset_index(drop=True)
    pick = K.mix(pdf["_h"].to_numpy(np.int64).view(np.uint64)) / 2.0**64
    p = pdf["_p"].to_numpy(float)
    p = flight(p, pdf["_size"].to_numpy(), pick)
    if (pdf["_blocks"] <= 1).all():
        p = settle(land(p, pdf["_size"].to_numpy()), pdf["_p"].to_numpy(float), pdf["_size"].to_numpy())
    return pdf.assign(_p=p)


def mix_units(units: DataFrame, weights=WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """Copies that the mix takes of each unit (source, _id, _md5, _size, _n): adds source_size, target, _base, _extra.

    A unit stands for ``_n`` equal rows; each is taken ``_base`` times and
    ``_extra`` of them once more.  Of the ``_n`` times fraction more, whole ones
    are sure and the rest is the unit's inclusion probability in the flight.
    """
    per = units.groupBy("source").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"), F.sum("_n").alias("n_docs"), F.count("*").alias("_units"))
    plan = targets(per.drop("_units"), weights, most).join(per.select(F.col("source").alias("_s"), "_units"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = stored(
        plan.withColumn("_rate", rate)
        .withColumn("_base", F.floor(F.col("_rate") + _EPS))
        .withColumn("_f", F.greatest(F.col("_rate") - F.col("_base"), F.lit(0.0)))
        .withColumn("_blocks", F.ceil(F.col("_units") / block))
        .drop("_rate", "_units", "n_docs")
    )
    rows = salted_join(units, plan, ["source"], F.struct("_id", "_md5"))
    more = F.col("_n") * F.col("_f")
    rows = (
        rows.withColumn("_h", F.xxhash64("_id", "_md5", "_size"))
        .withColumn("_sure", F.floor(more + _EPS))
        .withColumn("_p", F.greatest(more - F.col("_sure"), F.lit(0.0)).cast("double"))
        .withColumn("_block", F.pmod(F.xxhash64("_h"), F.col("_blocks")))
    )
    cols = [*_UNIT, "_n", "_h", "_p", "_block", "_blocks", "source_size", "target", "_base", "_sure"]
    now = rows.select(*cols)
    schema = now.schema
    fan = max(2, block // 4)
    out = None
    while True:
        now = stored(now.groupBy("source", "_block").applyInPandas(_fly, schema))
        closed = (F.col("_p") == 0) | (F.col("_p") == 1)
        done = now.filter(closed)
        out = done if out is None else out.unionByName(done)
        rest = now.filter(~closed)
        if rest.isEmpty():
            break
        now = rest.withColumn("_block", F.floor(F.col("_block") / fan)).withColumn("_blocks", F.ceil(F.col("_blocks") / fan)).select(*cols)
    extra = (F.col("_sure") + F.col("_p")).cast("long")
    return out.select(*_UNIT, "_n", "source_size", "target", F.col("_base").cast("long").alias("_base"), extra.alias("_extra"))


def _thin(docs: DataFrame, id: str, text: str, source: str, carry: list[str]) -> DataFrame:
    """The columns of _UNIT and ``carry``, as _c0 and on; ids as strings, so that pandas keeps them whole."""
    named = docs.select(
        F.col(f"`{id}`").cast("string").alias("_id"), F.col(f"`{source}`").alias("source"), F.md5(F.col(f"`{text}`").cast("binary")).alias("_md5"),
        F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)],
    )

    def count(_, t):
        x = K.Texts(t)
        return {"_size": np.bincount(x.spans(K.INK)[2], minlength=x.n)}

    return map_texts(named, "_text", "_size long", count, ["_id", "source", "_md5", *[f"_c{k}" for k in range(len(carry))]])


#: equal rows that one task writes
_PIECE = 100_000


def _spread(units: DataFrame) -> DataFrame:
    """A row for each of a unit's equal rows: ``_nth`` from 0; units of many are cut in pieces first, so that none is one task's work."""
    small = units.filter(F.col("_n") <= _PIECE).withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    pieces = units.filter(F.col("_n") > _PIECE).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_PIECE).cast("long"))))
    to = F.least(F.col("_from") + _PIECE, F.col("_n")) - 1
    large = pieces.repartition(sql_partitions(units.sparkSession), "_id", "_md5", "_from").withColumn("_nth", F.explode(F.sequence(F.col("_from"), to))).drop("_from")
    return small.unionByName(large)


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, most: float = MOST, block: int = BLOCK,
) -> DataFrame:
    """Whole copies of documents so that each source has its target of words.

    Every document of a source is taken floor(target / source size) times, and
    once more for a balanced sample with the fraction as inclusion probability:
    the cube method runs in blocks of about ``block`` documents, each leaves at
    most two open units, those fly again together until one block per source is
    left, and its two or fewer units land; a few others change with them where
    that brings the words nearer to what they should be.

    Returns (id, size, source_size, target, taken, copies), a row per input
    row.  Null and empty texts have size 0; they are sampled like others and
    take 0 words.  The null source comes last.  Repeated rows (id, text and
    source), rows without an id too, are counted and fly as one unit, whose
    sure part is taken and whose rest is drawn.  A source of size 0 has target
    0.  An empty table gives no rows; extra columns are left out.  Choices depend
    on ids, texts and sources only, so reruns agree on every layout.  Only
    (id, source, size) rows are shuffled, counted before; a hot source is many
    blocks and a hot row one unit.
    """
    units = stored(_thin(docs, id, text, source, []).groupBy(*_UNIT).agg(F.count("*").alias("_n")))
    got = _spread(mix_units(units, weights, most, block))
    got = got.withColumn("copies", F.col("_base") + (F.col("_nth") < F.col("_extra")).cast("long"))
    return got.select(
        F.col("_id").cast(docs.schema[id].dataType).alias(id), F.col("_size").alias("size"), "source_size", "target",
        (F.col("copies") * F.col("_size")).alias("taken"), "copies",
    )


def mix_rows(
    docs: DataFrame, row: str, id: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, most: float = MOST, block: int = BLOCK,
) -> DataFrame:
    """``mix`` for rows that must be found again: (``row``, copies); ``row`` differs in every row and can be ordered.

    Of equal rows some are taken once more, by a hash of ``row``.
    """
    thin = stored(_thin(docs, id, text, source, [row]))
    drawn = stored(mix_units(thin.groupBy(*_UNIT).agg(F.count("*").alias("_n")), weights, most, block))
    same = lambda a, b: F.expr(" and ".join(f"{a}.{k} <=> {b}.{k}" for k in _UNIT))
    own = thin.alias("t").join(drawn.alias("d"), same("t", "d"))
    own = stored(own.select("t._c0", *[f"d.{k}" for k in _UNIT], "d._n", "d._base", "d._extra"))
    split = (F.col("_extra") > 0) & (F.col("_extra") < F.col("_n"))
    # units of which a part is taken once more: numbered within cells of a bounded size, cells in order
    part = own.filter(split).withColumn("_r", F.pmod(F.xxhash64("_c0"), F.lit(1 << 24)))
    part = part.withColumn("_cell", F.floor(F.col("_r") * F.ceil(F.col("_n") / _PIECE) / (1 << 24)))
    before = Window.partitionBy(*_UNIT).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = part.groupBy(*_UNIT, "_cell").agg(F.count("*").alias("_in")).withColumn("_ahead", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*_UNIT, "_cell").orderBy("_r", "_c0")) - 1
    ranked = part.withColumn("_nth", nth).alias("p").join(cells.alias("c"), same("p", "c") & F.expr("p._cell = c._cell"))
    some = ranked.select("p._c0", (F.col("p._base") + (F.col("p._nth") + F.col("c._ahead") < F.col("p._extra")).cast("long")).alias("copies"))
    rest = own.filter(~split).select("_c0", (F.col("_base") + (F.col("_extra") > 0).cast("long")).alias("copies"))
    return rest.unionByName(some).withColumnRenamed("_c0", row)
