"""Shards are close in source, however much of their names the sources share."""

import random
from collections import Counter

import pytest

from lettersift.llm import sharding


@pytest.mark.parametrize("names", [("common_crawl_a", "common_crawl_b"), ("https://a.example/x", "https://b.example/x"), ("a", "b"), (None, "https://b.example/x")])
def test_sources_with_one_beginning(spark, names):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("abcdef ") for _ in range(rng.randint(50, 400))), "en", names[k % 2], 0) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["shard"], names[r["doc_id"] % 2]) for r in sharding.shard(docs, shards=2).collect())
    assert sum(got.values()) == len(rows)
    for shard in (0, 1):
        mine = [n for (s, _), n in got.items() if s == shard]
        assert max(mine) > 0.95 * sum(mine)
