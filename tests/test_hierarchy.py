import random

import pytest

from plexaform.operators import hierarchy as module
from plexaform.operators.hierarchy import descendants, hierarchy


def brute(links):
    kids = {}
    for v, p in links.items():
        kids.setdefault(p if p in links else None, []).append(v)
    out = {}
    for top in sorted(kids.get(None, [])):
        stack, order = [(top, 0, (top,))], []
        while stack:
            v, d, path = stack.pop()
            order.append((v, d, path))
            stack.extend((c, d + 1, (*path, c)) for c in sorted(kids.get(v, []), reverse=True))
        size = {v: 1 for v, _, _ in order}
        for v, _, path in reversed(order):
            if len(path) > 1:
                size[path[-2]] += size[v]
        for first, (v, d, path) in enumerate(order, len(out)):
            out[v] = (top, d, size[v] - 1, first, first + size[v] - 1, list(path))
    for v in links:
        if v not in out:
            seen, x = [], v
            while x not in seen:
                seen.append(x)
                x = links[x]
            out[v] = (min(seen[seen.index(x):]), -1, None, None, None, None)
    return out


def run(spark, links, rows=None):
    df = spark.createDataFrame(rows or list(links.items()), "v string, p string")
    return {r["node"]: (r["root"], r["depth"], r["descendants"], r["first"], r["last"], r["path"]) for r in hierarchy(df, "v", "p", paths=True).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forest_with_loops(spark, seed):
    rnd = random.Random(seed)
    names = [f"k{i:03d}" for i in range(150)]
    links = {}
    for i, n in enumerate(names):
        r = rnd.random()
        links[n] = None if i == 0 or r < 0.08 else "gone" if r < 0.12 else names[i - 1] if r < 0.6 else rnd.choice(names[:i])
    a, b, c = names[20], names[60], names[100]
    links[a], links[b], links[c] = b, c, a
    links[names[5]] = names[5]
    assert run(spark, links) == brute(links)


def test_many_blocks(spark, monkeypatch):
    """Depths and roots are carried from block to block."""
    monkeypatch.setattr(module, "BLOCK_BITS", 3)
    rnd = random.Random(5)
    names = [f"k{i:03d}" for i in range(120)]
    links = {n: None if i % 40 == 0 else rnd.choice(names[max(0, i - 12):i]) for i, n in enumerate(names)}
    links["x"] = "x"
    want = brute(links)
    assert run(spark, links) == want
    tree = hierarchy(spark.createDataFrame(list(links.items()), "v string, p string"), "v", "p")
    wanted = spark.createDataFrame([(n,) for n in [*names[::7], names[0], "x", "gone", None]], "ancestor string")
    got = sorted((r["ancestor"], r["node"], r["steps"]) for r in descendants(tree, wanted).collect())
    assert got == sorted((a, v, len(w[5]) - 1 - w[5].index(a)) for v, w in want.items() if w[5] for a in set(names[::7]) if a in w[5] and a != v)


def test_long_chain(spark):
    links = {f"c{i:04d}": f"c{i - 1:04d}" if i else None for i in range(200)}
    assert run(spark, links) == brute(links)


def test_loop_only(spark):
    links = {"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "s": "s"}
    assert run(spark, links) == brute(links)


def test_nulls_repeats_empty(spark):
    rows = [("a", None), ("a", None), (None, "a"), ("b", "a"), ("b", "a")]
    assert run(spark, None, rows) == brute({"a": None, "b": "a"})
    assert hierarchy(spark.createDataFrame([], "v string, p string, node string, root int"), "v", "p").count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", None, "x", 1), ("b", "a", "y", 2)], "v string, p string, root string, depth int")
    assert {(r["node"], r["root"], r["depth"]) for r in hierarchy(df, "v", "p").collect()} == {("a", "a", 0), ("b", "a", 1)}


def test_wide_fan_is_bucketed(spark):
    from plexaform.operators.prefix import bucketed_prefix_sum

    rows = [(g, f"t{i}", i) for g in ("x", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, t string, v bigint")
    for buckets in (1, 7):
        got = bucketed_prefix_sum(df, ["g"], "t", "v", "s", buckets).collect()
        assert len(got) == 100
        for g in ("x", None):
            mine = sorted((r["s"], r["v"]) for r in got if r["g"] == g)
            upto = 0
            values = sorted([r for r in got if r["g"] == g], key=lambda r: (r["s"], r["v"] != 0))
            assert sum(v for _, v in mine) == 1225 and max(r["s"] + r["v"] for r in values) == 1225
            assert upto == min(s for s, _ in mine)
