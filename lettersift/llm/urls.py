"""URL filter: host/path rules, then a weighted vocabulary found with Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: one of these rejects
STRICT = (
    "spam", "porn", "porno", "xxx", "xxxvideos", "sexcams", "hardcore", "escort", "escorts", "hookup", "casino", "poker", "roulette", "jackpot",
    "sportsbook", "viagra", "cialis", "levitra", "tramadol", "oxycontin", "steroids", "warez", "keygen", "keygens", "cracked", "nulled", "torrents", "hacked",
    "malware", "phishing", "botnet", "carding", "counterfeit", "fullz", "payday", "ponzi", "doorway", "linkfarm", "webcams",
)
#: distinct ones add their weights; two or more that weigh ``LIMIT`` reject: two telling ones, or several that clean urls use too
SOFT = {
    "pills": 1.5, "pill": 1.5, "pharmacy": 1.25, "rx": 1.25, "meds": 1.25, "diet": 0.75, "slimming": 1.25, "cheap": 1.0, "discount": 0.75, "discounts": 0.75,
    "deal": 0.5, "deals": 0.5, "coupon": 0.75, "promo": 0.75, "bonus": 1.25, "free": 0.75, "gratis": 0.75, "freebie": 1.0, "giveaway": 1.0, "prize": 1.0,
    "bet": 1.25, "bets": 1.25, "betting": 1.5, "win": 0.75, "winner": 0.75, "winners": 0.75, "slots": 1.5, "lottery": 1.5, "lotto": 1.5, "gamble": 1.5,
    "loan": 1.25, "loans": 1.25, "credit": 0.5, "forex": 1.25, "crypto": 0.75, "bitcoin": 0.75, "cash": 0.75, "earn": 0.75, "rich": 0.75, "millionaire": 1.25,
    "click": 0.5, "clickhere": 1.5, "adult": 1.5, "sexy": 1.5, "nude": 1.5, "dating": 1.25, "singles": 1.0, "girls": 1.0, "cams": 1.5, "replica": 1.5,
    "replicas": 1.5, "watches": 0.5, "handbags": 0.75, "outlet": 0.5, "crack": 1.25, "serial": 0.75, "torrent": 1.25, "hack": 1.0, "cheats": 1.0, "seo": 0.75,
    "backlinks": 1.5, "farm": 0.5, "traffic": 0.5, "download": 0.5, "downloads": 0.5, "stream": 0.5, "mp3": 0.5, "ringtones": 1.25, "essay": 1.0, "essays": 1.0,
}
LIMIT = 1.5

_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def automaton(strict, soft):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in soft:
        a.add_word(t, (t, False))
    for t in strict:
        a.add_word(t, (t, True))
    a.make_automaton()
    return a


def bounded_hits(a, text: str) -> tuple[list[str], list[str]]:
    """Every occurrence of strict and of soft terms that no letter or digit adjoins."""
    strict, soft = [], []
    for end, (t, hard) in a.iter(text):
        begin = end - len(t) + 1
        if (begin == 0 or text[begin - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            (strict if hard else soft).append(t)
    return strict, soft


def filter_urls(
    pages: DataFrame, id: str = "page_id", url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, limit: float = LIMIT
) -> DataFrame:
    """Judge every url; one row per input row.

    A rule fits its host and all subdomains where the url's path starts with the
    rule's path; the longest fitting rule decides.  Otherwise the lower-cased
    url is searched for the vocabulary, and it is blocked on one strict hit or
    on two or more distinct soft hits that together weigh ``limit``.  Hits count only
    between characters that aren't letters or digits.

    Null urls and urls without ``://`` have empty host and path, so no rule
    fits; null has no hits and is allowed.  Repeated rows are judged alike, an
    empty table gives no rows, extra columns are left out.  Map-only: reads two
    columns and shuffles nothing; only the automaton runs in Python.
    """
    u = F.col("_url")
    rest = F.when(F.contains(u, F.lit("://")), F.expr("substring(_url, locate('://', _url) + 3)")).otherwise(F.lit(""))
    folded = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = (
        pages.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{url}`").alias("_url"))
        .select("_id", "_url", F.coalesce(rest, F.lit("")).alias("_rest"))
        .select("_id", "_url", "_rest", F.regexp_extract("_rest", "^[^/?#]*", 0).alias("_host"))
        .select(
            "_id", folded(F.coalesce(u, F.lit(""))).alias("_url"), folded(F.col("_host")).alias("host"),
            F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), "^[^?#]*", 0).alias("path"),
        )
    )
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: -len(x[1])):
        name, _, at = r.partition("/")
        fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit("/" + at))
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    strict, soft = tuple(strict), dict(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                hard, light = bounded_hits(found, text)
                kinds = set(light)
                out.append((len(hard), len(light), len(kinds), sum(soft[t] for t in sorted(kinds))))
            cols = list(zip(*out)) if out else [()] * 4
            new = [pa.array(c, k) for c, k in zip(cols, [*[pa.int32()] * 3, pa.float64()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *new], names=["_id", "host", "path", "n_strict", "n_soft", "n_soft_distinct", "soft_weight"])

    kind = pages.schema[id].dataType.simpleString()
    got = parts.mapInArrow(run, f"_id {kind}, host string, path string, n_strict int, n_soft int, n_soft_distinct int, soft_weight double")
    method = F.when((F.col("n_strict") > 0) | ((F.col("n_soft_distinct") > 1) & (F.col("soft_weight") >= limit)), "block").otherwise("allow")
    return got.select(
        F.col("_id").alias(id), "host", "path", (none if rule is None else rule).alias("rule"),
        F.coalesce(none if verdict is None else verdict, method).alias("verdict"), "n_strict", "n_soft", "n_soft_distinct", "soft_weight",
    )


def oracle(rules=RULES, strict=STRICT, soft=SOFT, limit: float = LIMIT) -> str:
    """DuckDB SQL for ``filter_urls``: a bounded hit is a maximal run of letters and digits that is a term."""
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    listed = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    quoted = lambda ts: "[" + ", ".join(f"'{t}'" for t in ts) + "]"
    weight = " + ".join(f"{float(w)}::double * list_contains(light, '{t}')::int" for t, w in sorted(soft.items()))
    return rf"""
with rule_table(v, r, h, p) as (values {listed}),
cut as (select row_number() over () as k, page_id, url, case when contains(url, '://') then substring(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select k, page_id, {fold.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') as path,
          regexp_extract_all({fold.format("coalesce(url, '')")}, '[a-z0-9]+') as runs from cut),
hits as (select *, list_filter(runs, lambda x: list_contains({quoted(strict)}, x)) as hard, list_filter(runs, lambda x: list_contains({quoted(soft)}, x)) as light from parts),
fits as (select k, r, v, row_number() over (partition by k order by length(r) desc) as n from parts, rule_table where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
best as (select k, r, v from fits where n = 1)
select page_id, host, path, r as rule, coalesce(v, case when len(hard) > 0 or (len(list_distinct(light)) > 1 and ({weight}) >= {limit}) then 'block' else 'allow' end) as verdict,
       cast(len(hard) as integer) as n_strict, cast(len(light) as integer) as n_soft, cast(len(list_distinct(light)) as integer) as n_soft_distinct, {weight} as soft_weight
from hits left join best using (k)
"""
