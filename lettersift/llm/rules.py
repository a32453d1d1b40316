"""Quality rules with thresholds that follow each language and source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettersift.llm import textkit as K
from lettersift.llm.common import map_texts, salted_join
from lettersift.session import stored

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, bool)
_LINE[10] = False

#: metric: (reject above the upper fence, reject below the lower fence, units that one event touches, units)
METRICS = {
    "symbol_rate": (True, False, 1, "n_words"),
    "dup_line_rate": (True, False, 1, "n_lines"),
    "repeat_rate": (True, False, 6, "n_words"),
    "word_length": (True, True, 0, "n_words"),
}
#: sizes whose median tells how much one event weighs in a group
SIZES = ("n_words", "n_lines")
#: widths of interquartile range, and of one event, beyond the quartiles
REACH = 4
#: groups with fewer rows take the thresholds of their language, then of all
LEAST_ROWS = 30


def _per_doc(doc: np.ndarray, flags: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc[flags], minlength=n)


def _repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seen more than once in its text, not the first there) for each key; ``doc`` ascends."""
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order[1:][same]] = True
    later[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many, later


def measure_texts(column: pa.Array) -> dict[str, np.ndarray]:
    x = K.Texts(column)
    a, b, doc = x.spans(K.INK)
    return measure_words(x, b, doc, x.names(a, b)[0])


def measure_words(x: K.Texts, b: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of texts whose words have the numbers ``ids``; lines and windows are compared exactly."""
    n = x.n
    words = np.bincount(doc, minlength=n)
    chars = x.counts(K.INK[x.buf] & ((x.buf & 0xC0) != 0x80))
    symbols = x.counts(_SYMBOL[x.buf])
    la, lb, ldoc = x.spans(_LINE)
    ink = np.zeros(len(x.buf) + 1, np.int64)
    np.cumsum(K.INK[x.buf], out=ink[1:])
    full = ink[lb] > ink[la]
    la, lb, ldoc = la[full], lb[full], ldoc[full]
    _, later = _repeats(x.names(la, lb)[0], ldoc)
    at = np.flatnonzero(K.inside(doc, 3))
    many, _ = _repeats(K.tuples(ids, 3)[at], doc[at])
    covered = K.cover(at[many], 3, len(b)) if len(b) else np.zeros(0, bool)
    return {
        "n_words": words,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_lines": np.bincount(ldoc, minlength=n),
        "n_dup_lines": _per_doc(ldoc, later, n),
        "n_repeat_words": _per_doc(doc, covered, n),
    }


def measure(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The base counts of every whole text, in one scan without a shuffle."""
    schema = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    return map_texts(docs, text, schema, lambda _, t: measure_texts(t), carry)


def sketch_bucket(x: Column) -> Column:
    """The lower end of x's bucket: 16 buckets for each doubling, exact below 32."""
    shift = F.greatest(F.length(F.bin(x)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def sketches(values: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """Quantile sketches as rows (group, metric, bucket, n).

    Merging two sketches is adding their counts, so partial sums before the
    shuffle are merges, sketches of coarser groups are sums of finer ones, and
    the result is the same on every layout of the input.  A sketch has some
    hundred buckets however many rows it saw.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("_x")) for m in metrics]))
    return (
        values.select(*group, pairs.alias("p"))
        .select(*group, "p.metric", sketch_bucket(F.col("p._x")).alias("bucket"))
        .groupBy(*group, "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, group: list[str], qs: dict[str, float]) -> DataFrame:
    """Quantiles (lower bucket ends) of each (group, metric), and the row count."""
    w = Window.partitionBy(*group, "metric")
    run = sketch.select(
        "*",
        F.sum("n").over(w.orderBy("bucket")).alias("_upto"),
        F.sum("n").over(w).alias("_all"),
    )
    return run.groupBy(*group, "metric").agg(
        F.max("_all").alias("n_rows"),
        *[F.min(F.when(F.col("_upto") >= F.col("_all") * q, F.col("bucket"))).alias(k) for k, q in qs.items()],
    )


def fences(sketch: DataFrame, group: list[str], reach: int = REACH) -> DataFrame:
    """One row per group: lower and upper fence of every metric.

    A fence is ``reach`` times the interquartile range beyond the quartile, and
    ``reach`` events more, as a rate of the group's median size: where most
    texts have no event and the range is 0, the fence still follows how long
    the group's texts are.
    """
    q = quantiles(sketch, group, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = q.groupBy(*group).agg(
        F.max("n_rows").alias("n_rows"), *[pick(m, c).alias(f"_{m}_{c}") for m in METRICS for c in ("q1", "q3")], *[pick(m, "q2").alias(f"_{m}") for m in SIZES]
    )
    bounds = []
    for m, (_, _, events, size) in METRICS.items():
        beyond = reach * (F.col(f"_{m}_q3") - F.col(f"_{m}_q1") + F.floor(F.lit(1000 * events) / F.greatest(F.col(f"_{size}"), F.lit(1))))
        bounds += [(F.col(f"_{m}_q1") - beyond).alias(f"{m}_low"), (F.col(f"_{m}_q3") + beyond).alias(f"{m}_high")]
    return wide.select(*group, "n_rows", *bounds)


def adaptive_rules(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    reach: int = REACH, least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """Judge every document by fences of its language and source.

    Base rules: under 50 words, or over half of the words in repeated 3-word
    windows, fail.  The others pass if each metric lies within
    Q1 - reach * (IQR + event) and Q3 + reach * (IQR + event) of its group: the
    quartiles, and the median size that gives the rate of one event, come from
    mergeable sketches over all documents of the group that pass the base rules
    (of the language, then of everything, for groups under ``least_rows``).

    Null and empty texts have no words and fail.  Null languages and sources
    are groups of their own.  Repeated rows are judged alike, one row each; an
    empty table gives none; extra columns are left out.  The only shuffles are
    of bucket counts and of thin count rows; a hot source is split by salt.
    """
    got = docs.select(
        F.col(f"`{id}`").alias("_id"), F.col(f"`{lang}`").alias("_lang"), F.col(f"`{source}`").alias("_source"),
        F.col(f"`{text}`").alias("_text"),
    )
    m = measure(got, ["_id", "_lang", "_source"], "_text")
    words = F.greatest("n_words", F.lit(1))
    m = stored(
        m.withColumns(
            {
                "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
                "symbol_rate": F.floor(1000 * F.col("n_symbols") / words),
                "dup_line_rate": F.floor(1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
                "repeat_rate": F.floor(1000 * F.col("n_repeat_words") / words),
                "word_length": F.floor(100 * F.col("word_chars") / words),
            }
        )
    )
    fine = stored(sketches(m.filter(~F.col("base_failed")), ["_lang", "_source"], [*METRICS, *SIZES]))
    by_lang = fine.groupBy("_lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    of_all = fine.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    cols = [f"{x}_{c}" for x in METRICS for c in ("low", "high")]
    one = fences(fine, ["_lang", "_source"], reach)
    two = fences(by_lang, ["_lang"], reach).select(
        F.col("_lang").alias("_lang2"), F.col("n_rows").alias("n2"), *[F.col(c).alias(f"{c}2") for c in cols]
    )
    three = fences(of_all.withColumn("_any", F.lit(1)), ["_any"], reach).select(*[F.col(c).alias(f"{c}3") for c in cols])
    enough = lambda n: F.coalesce(F.col(n) >= least_rows, F.lit(False))
    fence = (
        one.join(two, one["_lang"].eqNullSafe(two["_lang2"]), "left")
        .join(three, F.lit(True), "left")  # one row
        .select(
            "_lang", "_source",
            *[F.when(enough("n_rows"), F.col(c)).when(enough("n2"), F.col(f"{c}2")).otherwise(F.col(f"{c}3")).alias(c) for c in cols],
        )
    )
    out = salted_join(m, fence, ["_lang", "_source"], F.struct("_id", "word_chars", "n_words"))
    ok = ~F.col("base_failed")
    for x, (above, below, *_) in METRICS.items():
        if above:
            ok &= F.coalesce(F.col(x) <= F.col(f"{x}_high"), F.lit(True))
        if below:
            ok &= F.coalesce(F.col(x) >= F.col(f"{x}_low"), F.lit(True))
    return out.select(
        F.col("_id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", ok.alias("kept")
    )


def oracle(reach: int = REACH, least_rows: int = LEAST_ROWS) -> str:
    """DuckDB SQL for ``adaptive_rules``."""
    rates = {"symbol_rate": "1000 * n_symbols // greatest(n_words, 1)", "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)",
             "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)", "word_length": "100 * word_chars // greatest(n_words, 1)"}
    rate = ", ".join(f"{e} as {m}" for m, e in rates.items())
    long = " union all ".join(f"select lang, source, '{m}' as metric, {m} as x from good" for m in (*METRICS, *SIZES))
    grain = "case metric " + " ".join(f"when '{m}' then {1000 * e} // greatest({s}, 1)" for m, (_, _, e, s) in METRICS.items()) + " end"

    def fence(name: str, keys: str) -> str:
        group = f"{keys}, metric" if keys else "metric"
        part = f"partition by {group}"
        same = " and ".join(f"q.{k} is not distinct from z.{k}" for k in keys.split(", ")) if keys else "true"
        keyed = f"{keys}, " if keys else ""
        sizes = ", ".join(f"max(q2) filter (where metric = '{m}') as {m}" for m in SIZES)
        return f"""
{name}_q as (select {group}, max(total) as n_rows, min(bucket) filter (where upto >= total * 0.25) as q1, min(bucket) filter (where upto >= total * 0.5) as q2,
        min(bucket) filter (where upto >= total * 0.75) as q3
    from (select {group}, bucket, sum(n) over ({part} order by bucket) as upto, sum(n) over ({part}) as total
          from (select {group}, bucket, sum(n) as n from sketch group by {group}, bucket)) group by {group}),
{name}_z as (select {keyed}{sizes} from {name}_q {"group by " + keys if keys else ""}),
{name} as (select {", ".join("q." + k for k in group.split(", "))}, n_rows, q1 - {reach} * (q3 - q1 + {grain}) as low, q3 + {reach} * (q3 - q1 + {grain}) as high
    from {name}_q q join {name}_z z on {same} where metric in ({", ".join(f"'{m}'" for m in METRICS)}))"""

    verdicts = []
    for m, (above, below, *_) in METRICS.items():
        verdicts += [f"coalesce({m} <= {m}_high, true)"] if above else []
        verdicts += [f"coalesce({m} >= {m}_low, true)"] if below else []
    bounds = ", ".join(f"max({c}) filter (where metric = '{m}') as {m}_{c}" for m in METRICS for c in ("low", "high"))
    return rf"""
with w as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select r, l, count(*) as n from (select r, unnest(string_split(text, chr(10))) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r, l),
line as (select r, sum(n) as n_lines, sum(n - 1) as n_dup_lines from lines group by r),
tri as (select r, i, array_to_string(w[i : i + 2], ' ') as g from (select r, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
many as (select r, g from tri group by r, g having count(*) > 1),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 3)) as p from tri semi join many using (r, g)) group by r),
m as (select r, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
      cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
      cast(coalesce(n, 0) as bigint) as n_repeat_words from w left join line using (r) left join rep using (r)),
m2 as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {rate} from m),
good as (select * from m2 where not base_failed),
long as ({long}),
sketch as (select lang, source, metric, (x >> greatest(length(bin(x)) - 5, 0)) << greatest(length(bin(x)) - 5, 0) as bucket, count(*) as n from long group by all),
{fence("one", "lang, source")}, {fence("two", "lang")}, {fence("three", "")},
picked as (select o.lang, o.source, o.metric,
    case when o.n_rows >= {least_rows} then o.low when t.n_rows >= {least_rows} then t.low else a.low end as low,
    case when o.n_rows >= {least_rows} then o.high when t.n_rows >= {least_rows} then t.high else a.high end as high
  from one o left join two t on o.lang is not distinct from t.lang and o.metric = t.metric left join three a on o.metric = a.metric),
bound as (select lang, source, {bounds} from picked group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(verdicts)} as kept
from m2 left join bound on m2.lang is not distinct from bound.lang and m2.source is not distinct from bound.source
"""
