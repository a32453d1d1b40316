"""K-d tree partitioning of documents into shards of near equal bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettersift.llm.common import salted_join
from lettersift.operators.numbering import dense_numbers
from lettersift.session import stored

#: bins of one histogram round of the weighted median search
BINS = 1024
#: a median is found once its bin holds less than this part of a shard
TOLERANCE = 0.001
_TOP = (1 << 63) - 1
#: groups with over 1/HOT of the rows join by broadcast, so that no task gets one whole
HOT = 1000
#: a node of no more units is finished within one task; the driver knows the others only
TASK_UNITS = 1 << 19
DIMS = ("_dlang", "_dsource", "_dsize", "_dcrc")


def _name_numbers(units: DataFrame) -> DataFrame:
    """Adds _dlang and _dsource: the place of the name among all distinct ones, by their bytes; null is 0."""
    pair = F.explode(F.array(F.struct(F.lit(0).alias("_k"), F.col("_lang").alias("_name")), F.struct(F.lit(1).alias("_k"), F.col("_source").alias("_name"))))
    names = units.select(pair.alias("p")).select("p.*").filter(F.col("_name").isNotNull()).distinct()
    names = stored(dense_numbers(names, ["_k", "_name"], "_number", 1))
    for k, (name, number) in enumerate((("_lang", "_dlang"), ("_source", "_dsource"))):
        own = names.filter(F.col("_k") == k).select(F.col("_name").alias(name), F.col("_number").alias(number))
        units = salted_join(units, own, [name], F.col("_tie")).withColumn(number, F.coalesce(number, F.lit(0).cast("long")))
    return units


def _split(units: DataFrame, nodes: dict[int, tuple[str, float, float]]) -> dict[int, tuple[int, int]]:
    """Weighted medians of all nodes together: node -> least (value, tie) of the right side.

    nodes: node -> (dimension, bytes that should go left, tolerance).  Each
    round histograms one integer range per node, on values and then, inside the
    boundary value, on the tie hash, and narrows to the bin with the cut.
    """
    spark = units.sparkSession
    state = {k: {"want": want, "tol": tol, "on": "value", "lo": None, "hi": None} for k, (_, want, tol) in nodes.items()}
    dims = spark.createDataFrame([(k, d) for k, (d, _, _) in nodes.items()], "_node long, _dim string")
    # a row a node that is larger than TASK_UNITS
    rows = units.join(F.broadcast(dims), "_node").withColumn("_v", F.coalesce(*[F.when(F.col("_dim") == d, F.col(d)) for d in DIMS]))
    for r in rows.groupBy("_node").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect():
        state[r["_node"]] |= {"lo": r["lo"], "hi": r["hi"]}
    found: dict[int, tuple[int, int]] = {}
    while len(found) < len(state):
        todo = {k: s for k, s in state.items() if k not in found}
        plan = spark.createDataFrame(
            [(k, s["on"] == "tie", s.get("value", 0), s["lo"], s["hi"], max(1, -(-(s["hi"] - s["lo"] + 1) // BINS)), float(s["want"])) for k, s in todo.items()],
            "_node long, _tied boolean, _at long, _lo long, _hi long, _width long, _want double",
        )
        hist = (
            rows.join(F.broadcast(plan), "_node")
            .filter(~F.col("_tied") | (F.col("_v") == F.col("_at")))
            .withColumn("_x", F.when(F.col("_tied"), F.col("_tie")).otherwise(F.col("_v")))
            .filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
            .groupBy("_node", "_want", F.floor((F.col("_x") - F.col("_lo")) / F.col("_width")).cast("long").alias("_bin"))
            .agg(F.sum("_bytes").alias("w"), F.min("_x").alias("least"), F.max("_x").alias("most"))
        )
        # BINS rows a node
        run = hist.withColumn("upto", F.sum("w").over(Window.partitionBy("_node").orderBy("_bin")))
        cut = run.groupBy("_node").agg(F.min(F.struct(F.col("upto") < F.col("_want"), "_bin", "w", "upto", "least", "most")).alias("c"))
        for r in cut.select("_node", "c.*").collect():
            k, s = r["_node"], state[r["_node"]]
            before = r["upto"] - r["w"]
            if r["w"] <= s["tol"] or (r["least"] == r["most"] and s["on"] == "tie"):
                # left or right of this bin, whichever comes nearer
                right = s["want"] - before < r["upto"] - s["want"]
                at = r["least"] if right else r["most"] + 1
                found[k] = (at, -1) if s["on"] == "value" else (s["value"], at)
            elif r["least"] == r["most"]:
                s |= {"on": "tie", "value": r["least"], "want": s["want"] - before, "lo": 0, "hi": _TOP}
            else:
                s |= {"want": s["want"] - before, "lo": r["least"], "hi": r["most"]}
    return found


def kd_leaves(dims: np.ndarray, tie: np.ndarray, size: np.ndarray, n: int, scale: np.ndarray) -> np.ndarray:
    """Leaf numbers from 0 to n - 1: the tree below a node that fits in a task, by the same law.

    Spreads are compared to six places, so that the order of adding decides nothing.
    """
    out = np.zeros(len(size), np.int64)
    todo = [(np.arange(len(size)), n, 0)]
    while todo:
        at, n, base = todo.pop()
        if n == 1 or not len(at):
            out[at] = base
            continue
        w = size[at].astype(float)
        x = dims[at].astype(float)
        mean = (x * w[:, None]).sum(0) / w.sum()
        var = ((x - mean) ** 2 * w[:, None]).sum(0) / w.sum() / scale
        d = max(range(len(DIMS)), key=lambda k: (round(var[k], 6), DIMS[k]))
        o = at[np.lexsort((tie[at], dims[at, d]))]
        upto = np.cumsum(size[o])
        want = upto[-1] * (n // 2) / n
        k = int(np.searchsorted(upto, want))
        left = k if k == len(o) or (k and want - upto[k - 1] < upto[k] - want) else k + 1
        todo += [(o[:left], n // 2, base), (o[left:], n - n // 2, base + n // 2)]
    return out


def _place(units: DataFrame, leaves: int, total: int, task_units: int) -> DataFrame:
    """(_g, _tie, shard) of all units: split the large nodes level by level, then finish each node in a task."""
    spark = units.sparkSession
    stats = [F.sum("_bytes").alias("w"), F.count("*").alias("n")]
    for d in DIMS:
        x = F.col(d).cast("double")
        stats += [F.sum(F.col("_bytes") * x).alias(f"{d}_1"), F.sum(F.col("_bytes") * x * x).alias(f"{d}_2")]
    var = lambda r, d: max(0.0, r[f"{d}_2"] / r["w"] - (r[f"{d}_1"] / r["w"]) ** 2)
    many, done, scale = {1: leaves}, {}, {d: 1.0 for d in DIMS}
    first = True
    while True:
        of = {r["_node"]: r for r in units.groupBy("_node").agg(*stats).collect()}  # a row a node, twice what TASK_UNITS goes into all units at most
        if first and of:
            scale = {d: var(of[1], d) or 1.0 for d in DIMS}
        first = False
        nodes = {}
        for k, n in many.items():
            if k in done:
                continue
            if n == 1 or k not in of or of[k]["n"] <= task_units:
                done[k] = n
            else:
                widest = max(DIMS, key=lambda d: (round(var(of[k], d) / scale[d], 6), d))
                nodes[k] = (widest, of[k]["w"] * (n // 2) / n, TOLERANCE * total / leaves)
        if not nodes:
            break
        cuts = _split(units, nodes)
        plan = spark.createDataFrame([(k, nodes[k][0], v, h) for k, (v, h) in cuts.items()], "_node long, _dim string, _cut long, _cut_tie long")
        value = F.coalesce(*[F.when(F.col("_dim") == d, F.col(d)) for d in DIMS])
        right = (value > F.col("_cut")) | ((value == F.col("_cut")) & (F.col("_tie") >= F.col("_cut_tie")))
        moved = units.join(F.broadcast(plan), "_node", "left").withColumn(
            "_node", F.when(F.col("_dim").isNull(), F.col("_node")).otherwise(F.col("_node") * 2 + right.cast("long"))
        )
        units = stored(moved.select("_g", "_tie", "_bytes", *DIMS, "_node"))
        for k in nodes:
            n = many.pop(k)
            many[2 * k], many[2 * k + 1] = n // 2, n - n // 2
    rows, base = [], 0
    for k in sorted(done, key=lambda k: bin(k)[3:]):
        rows.append((k, done[k], base))
        base += done[k]
    spread = np.array([scale[d] for d in DIMS])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = kd_leaves(pdf[list(DIMS)].to_numpy(np.int64), pdf["_tie"].to_numpy(np.int64), pdf["_bytes"].to_numpy(np.int64), int(pdf["_n"].iloc[0]), spread)
        return pd.DataFrame({"_g": pdf["_g"], "_tie": pdf["_tie"], "shard": (pdf["_base"].to_numpy() + leaf).astype(np.int32)})

    named = units.join(F.broadcast(spark.createDataFrame(rows, "_node long, _n long, _base long")), "_node")
    whole = named.filter("_n = 1").select("_g", "_tie", F.col("_base").cast("int").alias("shard"))
    return whole.unionByName(named.filter("_n > 1").groupBy("_node").applyInPandas(finish, "_g string, _tie long, shard int"))


def shard(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
    id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", carry: tuple[str, ...] = (), task_units: int = TASK_UNITS,
) -> DataFrame:
    """Lay documents out in shards of near equal bytes, close in metadata.

    ``shards`` leaves, or as many as bring them to ``target_bytes``.  Nodes are
    split, all of a level together, at the weighted median of the dimension
    (language, source, log size, checksum) that is widest in them: the one with
    the largest variance by bytes against that of all rows.  Languages and
    sources are numbered by the order of their whole names.  The median comes
    from histograms with partial sums.  A node of no more than ``task_units``
    groups of texts is split further within one task, by the same law; the
    driver has a row for each larger node only, however many leaves there are.

    Equal texts are one group and stay in one shard, at its own boundaries,
    unless the group alone is larger than a shard: then its rows are dealt by
    id.  Size is the text's UTF-8 bytes plus 1; a null text has size 1 and no
    checksum and is a group with other nulls, apart from empty ones.  Returns
    (id, size, text_crc32, law = 'bytes', shard, slot, grown_shard = null) and
    the columns ``carry``; slots number each shard's rows from 0 without gaps.
    Repeated rows get slots of their own; an empty table gives no rows; extra
    columns are left out.  Texts are read once and never shuffled.
    """
    t = F.col(f"`{text}`")
    thin = stored(
        docs.select(
            F.col(f"`{id}`").alias("_id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("_size"),
            F.crc32(t.cast("binary")).alias("_crc"),
            F.coalesce(F.md5(t.cast("binary")), F.lit("")).alias("_g"),
            F.col(f"`{lang}`").cast("string").alias("_lang"),
            F.col(f"`{source}`").cast("string").alias("_source"),
            *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)],
        ).withColumn("_rid", F.monotonically_increasing_id())
    )
    total, n_rows = thin.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    leaves = shards or max(1, -(-total // (target_bytes or 1 << 27)))
    # under HOT groups have a HOTth of the rows, fewer than there are leaves are larger than a shard
    heavy = stored(
        thin.groupBy("_g").agg(F.sum("_size").alias("w"), F.count("*").alias("n"))
        .withColumn("_hot", F.col("n") > max(1, n_rows / HOT)).withColumn("_cut_up", F.col("w") > total / leaves)
        .filter("_hot or _cut_up").select("_g", "_hot", "_cut_up")
    )
    hot = F.broadcast(heavy.filter("_hot").select("_g", "_cut_up"))
    rest = thin.join(hot.select("_g"), "_g", "left_anti").join(heavy.filter("not _hot").select("_g", "_cut_up"), "_g", "left")
    rows = thin.join(hot, "_g").withColumn("_hot", F.lit(True)).unionByName(rest.withColumn("_hot", F.lit(False)))
    tie = F.xxhash64(F.col("_g"), F.when(F.col("_cut_up"), F.struct("_id", "_rid"))).bitwiseAND(F.lit(_TOP))
    rows = rows.withColumn("_tie", tie)
    units = stored(
        rows.groupBy("_g", "_tie").agg(
            F.sum("_size").alias("_bytes"), F.min("_lang").alias("_lang"), F.min("_source").alias("_source"),
            F.floor(F.log2(F.max("_size")) * (1 << 16)).cast("long").alias("_dsize"),
            F.max(F.coalesce("_crc", F.lit(0))).cast("long").alias("_dcrc"),
        )
    )
    units = stored(_name_numbers(units).select("_g", "_tie", "_bytes", *DIMS, F.lit(1).cast("long").alias("_node")))
    placed = stored(_place(units, leaves, total, task_units))
    one = F.col("_hot") & ~F.coalesce("_cut_up", F.lit(False))
    same = placed.join(F.broadcast(heavy.filter("_hot and not _cut_up").select("_g")), "_g", "left_semi")
    parts = rows.filter(one).join(F.broadcast(same), ["_g", "_tie"]), rows.filter(~one).join(placed, ["_g", "_tie"])  # under HOT rows
    out = stored(parts[0].unionByName(parts[1]).withColumn("_chunk", F.spark_partition_id()))
    # slots: place within a written chunk plus the rows of earlier chunks
    ahead = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = out.groupBy("shard", "_chunk").agg(F.count("*").alias("n")).withColumn("_start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("_id", "_rid")) - 1
    return out.withColumn("_place", place).join(starts, ["shard", "_chunk"]).select(
        F.col("_id").alias(id), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("_start") + F.col("_place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)],
    )
