import random

import numpy as np
import pytest

from plexaform.llm import packing
from plexaform.llm.queries import TOKEN_PATTERN, tokenizer_path


def check(rows, tokens, capacity, separator):
    by, whole = {}, {}
    for r in rows:
        by.setdefault(r["container"], []).append(r)
        whole.setdefault(r["id"], []).append(r)
    for items in by.values():
        used = sum(r["tokens"] for r in items) + separator * (len(items) - 1)
        assert used <= capacity and {r["unused"] for r in items} == {capacity - used}
        assert sorted(r["position"] for r in items) == list(range(len(items)))
    for i, t in enumerate(tokens):
        pieces = sorted(whole[i], key=lambda r: r["piece"])
        assert sum(r["tokens"] for r in pieces) == t and [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert len(pieces) == 1 or t > capacity
    return len(by)


@pytest.mark.parametrize("capacity, separator", [(10, 0), (64, 1), (512, 2)])
def test_shard(capacity, separator):
    rnd = random.Random(capacity)
    tokens = [rnd.choice([0, 1, capacity, capacity + 1, 3 * capacity, rnd.randrange(1, capacity), rnd.randrange(1, 4 * capacity)]) for _ in range(400)]
    rows = packing.pack_shard(np.arange(400), np.array(tokens), capacity, separator).to_dict("records")
    n = check(rows, tokens, capacity, separator)
    items = [t % capacity if t > capacity else t for t in tokens if not (t > capacity and t % capacity == 0)]
    bound = sum(t // capacity for t in tokens if t > capacity) + -(-sum(x + separator for x in items) // (capacity + separator))
    assert bound <= n <= bound * 1.1 + 2


@pytest.mark.parametrize("capacity", [512, 2048])
def test_few_containers(capacity):
    """Texts of about half a capacity, the hard case, and mixed ones: close to the lower bound."""
    rng = np.random.RandomState(capacity)
    sizes = np.r_[rng.normal(capacity * 0.5, capacity * 0.08, 3000), rng.lognormal(np.log(capacity / 8), 0.8, 5000)].astype(np.int64).clip(1, capacity)
    where = packing.balanced(np.sort(sizes)[::-1], capacity, 1)
    assert (np.bincount(where, np.sort(sizes)[::-1] + 1) <= capacity + 1).all()
    assert where.max() + 1 <= 1.01 * (sizes + 1).sum() / (capacity + 1) + 2


def test_lowest_cost_with_room():
    """The longest go to empty sequences, then each to the cheapest one that holds it."""
    assert packing.fill([6, 5, 4, 3, 2, 1], 3, 10, 0) == ([0, 1, 2, 2, 1, 2], [])
    assert packing.fill([6, 6, 6], 2, 10, 0) == ([0, 1, -1], [2])


def test_counts_and_edge_rows(spark):
    long = "word " * 60_000
    rows = [(1, ""), (2, None), (3, "a b c"), (3, "a b c"), (4, long), (5, "\x00 ​ ü")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts = packing.token_counts(df, "doc_id", "text", tokenizer_path(), TOKEN_PATTERN)
    n = sorted((r["id"], r["tokens"]) for r in counts.collect())
    assert n[0] == (1, 0) and n[1] == (2, 0) and n[2] == n[3] == (3, 3) and n[4][1] >= 60_000
    got = packing.pack(counts, [("w", 100, 1)]).collect()
    assert sum(r["tokens"] for r in got) == sum(t for _, t in n)
    assert sum(1 for r in got if r["id"] == 3) == 2
    with pytest.raises(ValueError):
        packing.pack(counts, [("w", 0, 1)])
    assert packing.pack(counts.limit(0), [("w", 10, 1)]).count() == 0


def test_shards_are_bounded(spark):
    counts = spark.range(1000).selectExpr("id", "id % 50 + 1 AS tokens")
    got = packing.pack(counts, [("w", 64, 1)], shard_items=100)
    assert got.select("shard").distinct().count() == 10
    per = got.groupBy("shard", "container").agg({"tokens": "sum", "*": "count"})
    assert per.where("`sum(tokens)` + `count(1)` - 1 > 64").count() == 0
    assert got.count() == 1000
