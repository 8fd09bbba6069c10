"""Graph fixpoints, tree totals, plan search, simulation and replay against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plexaform.operators import graph as g
from plexaform.operators import learning
from plexaform.operators import plansearch as ps
from plexaform.operators import resampling as rs
from plexaform.operators import traces as tr
from plexaform.operators.hierarchy import subtree_totals


def reach(edges):
    out = {}
    nodes = {x for e in edges for x in e}
    for v in nodes:
        seen, stack = set(), [v]
        while stack:
            x = stack.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    stack.append(b)
        out[v] = seen
    return out


@pytest.mark.parametrize("seed, n, m", [(1, 30, 45), (2, 25, 60), (3, 12, 10)])
def test_strong_components(spark, seed, n, m):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}
    df = spark.createDataFrame(sorted(edges) + [(None, 1), (1, None)], "s int, d int")
    r = reach(edges)
    nodes = {x for e in edges for x in e} | {1}
    want = {v: min({v} | {u for u in r.get(v, ()) if v in r.get(u, ())}) for v in nodes}
    assert {x["v"]: x["component"] for x in g.strong_components(df, "s", "d").collect()} == want
    got = {x["v"] for x in g.reachable(df, "s", "d", spark.createDataFrame([(0,), (None,)], "q int"), "q").collect()}
    assert got == {0} | r.get(0, set())


def test_long_chain_of_effects(spark):
    """Longer than any bound on rounds that the graph does not set itself."""
    n = 120
    calls = spark.createDataFrame([(i, i + 1) for i in range(n)], "a int, b int")
    own = spark.createDataFrame([(n, "writes")], "n int, e string")
    assert g.effect_closure(own, "n", "e", calls, "a", "b").count() == n + 1


def test_levels_and_critical_path(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z"), (None, "a")], "s string, d string")
    assert {r["v"]: r["level"] for r in g.topological_levels(e, "s", "d").collect()} == {"a": 0, "c": 0, "b": 1, "d": 2, "x": None, "y": None, "z": None}
    w = spark.createDataFrame([("a", 5.0), ("b", 0.0), ("c", 9.0), ("d", None), ("x", 1.0), ("y", 1.0), ("z", 1.0)], "v string, w double")
    assert {r["v"]: r["cost"] for r in g.critical_path(e, "s", "d", w, "v", "w").collect()} == {"a": 5.0, "b": 6.0, "c": 9.0, "d": 10.0}


def test_subtree_totals(spark):
    rnd = random.Random(4)
    names = [f"k{i}" for i in range(70)]
    parent = {n: None if i == 0 or rnd.random() < 0.05 else "gone" if rnd.random() < 0.05 else names[i - 1] if rnd.random() < 0.5 else rnd.choice(names[:i]) for i, n in enumerate(names)}
    parent |= {"p": "q", "q": "p", "below": "p"}
    value = {n: rnd.randrange(10) for n in parent}
    rows = [(n, p, value[n], "clash") for n, p in parent.items()]
    df = spark.createDataFrame(rows + rows[:5] + [(None, "k0", 5, "")], "n string, p string, x int, children string")
    got = {r["node"]: (r["children"], r["total"], r["best"]) for r in subtree_totals(df, "n", "p", {"total": F.col("x").cast("bigint")}, {"best": F.struct(F.col("x"), F.col("n"))}).collect()}

    def below(n):
        return [n] + [d for c, p in parent.items() if p == n for d in below(c)]
    for n in names:
        b = below(n)
        kids, total, best = got[n]
        assert (kids, total, tuple(best)) == (sum(p == n for p in parent.values()), sum(value[d] for d in b), max((value[d], d) for d in b))
    assert set(got) == set(names)


def test_bootstrap_width(spark):
    """The spread of the bootstrap mean is that of theory, sigma / sqrt(n), at any size."""
    for n in (10, 100, 1000):
        d = rs.draws(spark, 400, n, n, 7)
        spread = d.groupBy("round").agg(F.avg("pick").alias("m")).agg(F.stddev_pop("m")).first()[0]
        sigma = ((n * n - 1) / 12) ** 0.5
        assert 0.85 < spread / (sigma / n ** 0.5) < 1.15
    assert d.where("pick < 0 or pick >= 1000").count() == 0


def brute_schedule(durations, after, allowed, queues):
    best, legal = None, 0
    for way in itertools.product(range(len(queues)), repeat=len(durations)):
        if any(a is not None and queues[q] not in a for q, a in zip(way, allowed)):
            continue
        legal += 1
        free, ends = [0.0] * len(queues), []
        for k, q in enumerate(way):
            begin = max([free[q], *(ends[j] for j in after[k] or ())])
            ends.append(begin + durations[k])
            free[q] = ends[k]
        if best is None or max(ends) < best[0] - 1e-12:
            best = (max(ends), ",".join(queues[q] for q in way))
    return (*best, legal) if best else None


def test_schedules(spark):
    rnd = random.Random(3)
    queues = ["a", "b", "c"]
    plans = []
    for p in range(30):
        n = rnd.randrange(1, 6)
        plans.append((p, [float(rnd.randrange(1, 9)) for _ in range(n)], [[j for j in range(k) if rnd.random() < 0.3] or None for k in range(n)], [rnd.choice([None, ["a"], ["b", "c"]]) for _ in range(n)]))
    plans += [(100, [], [], []), (101, None, None, None), (102, [1.0], [None], [["z"]])]
    df = spark.createDataFrame(plans, "plan bigint, durations array<double>, after array<array<int>>, allowed array<array<string>>")
    got = {r["plan"]: (r["makespan"], r["assignment"], r["legal"]) for r in ps.best_schedules(df, queues).collect()}
    assert got == {p: brute_schedule(d, a, q, queues) for p, d, a, q in plans[:30]}


def brute_batches(rows, tile, chunk, wait, rate, step):
    state = {i: [a, p, max(t, 1), []] for a, i, p, t in sorted((r[2], r[1], r[3], r[4]) for r in rows)}
    now = min(r[2] for r in rows)
    while any(s[2] for s in state.values()):
        here = [s for s in state.values() if s[2] and s[0] <= now]
        if not here:
            now = min(s[0] for s in state.values() if s[2])
            continue
        reading = [s for s in here if s[1]][:tile]
        if reading:
            n = 0
            for s in reading:
                n += min(chunk, s[1])
                s[1] -= min(chunk, s[1])
            now += 1e6 * n / rate
            continue
        lanes = here[:tile]
        coming = [s[0] for s in state.values() if s[0] > now]
        if wait and len(lanes) < tile and coming and min(coming) <= now + wait:
            now = min(coming)
            continue
        now += step(len(lanes))
        for s in lanes:
            s[2] -= 1
            s[3].append(now)
    return {i: s[3] for i, s in state.items()}


@pytest.mark.parametrize("wait", [0.0, 300.0])
def test_batches(spark, wait):
    rnd = random.Random(int(wait))
    rows = [(k, 100 * k + i, float(rnd.randrange(40_000)), rnd.randrange(0, 50), rnd.randrange(0, 12)) for k in range(4) for i in range(12)]
    df = spark.createDataFrame(rows, "scenario bigint, id bigint, arrival_us double, prompt_tokens int, generated_tokens int")
    sim = ps.simulate_batches(df, 3, 16, wait, 20_000.0, [(1, 700.0), (2, 900.0)])
    for k in range(4):
        want = brute_batches([r for r in rows if r[0] == k], 3, 16, wait, 20_000.0, lambda n: 700.0 if n == 1 else 900.0 * n / 2)
        for r in sim.where(F.col("scenario") == k).collect():
            times = want[r["id"]]
            assert r["tokens"] == len(times) and r["first_us"] == pytest.approx(times[0]) and r["complete_us"] == pytest.approx(times[-1])
            gaps = sorted(x for gap in r["gaps"] for x in [gap["us"]] * gap["n"])
            assert gaps == pytest.approx(sorted(b - a for a, b in zip(times, times[1:])))
    figures = ps.batch_figures(sim).collect()
    assert len(figures) == 4 and all(r["requests"] == 12 and r["ttft_p50"] <= r["ttft_p99"] and r["gap_p50"] <= r["gap_p99"] for r in figures)


def brute_replay(events, mutations, invalidators, own, scope, atomic):
    out, version, made, valid, told = [], {}, {}, {}, {}
    for seq, ident, event, mutation, scopes in events:
        at = scopes.get(scope)
        if at is None:
            out.append((seq, "candidate scope instance missing"))
            continue
        v, key = version.setdefault(ident, 0), (ident, at)
        everywhere = [k for k in valid if k[0] == ident]
        if event == "construct" and not (valid.get(key) and made.get(key) == v):
            made[key], valid[key], told[key] = v, True, atomic
        elif event == "publish":
            if key in made:
                told[key] = True
            else:
                out.append((seq, "publish before construction"))
        elif event == "mutate" and mutation not in mutations:
            out.append((seq, "undeclared mutation"))
        elif event == "mutate" and mutation in invalidators:
            version[ident] = v + 1
            if mutation in own:
                for k in everywhere:
                    valid[k] = told[k] = False
        elif event == "invalidate":
            for k in everywhere:
                valid[k] = told[k] = False
        elif event in ("retire", "destroy"):
            valid[key] = told[key] = False
        elif event == "consume":
            out.append((seq, "read outside valid realization lifetime" if not valid.get(key) else "read before publication" if not told.get(key) else "stale realization read" if made[key] != v else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, own, atomic", [(1, ["m1"], False), (2, [], False), (3, ["m1", "m2"], True), (4, ["m2"], False)])
def test_replay(spark, seed, own, atomic):
    rnd = random.Random(seed)
    events = [(i, f"u{rnd.randrange(3)}", rnd.choice([*tr.EVENT_KINDS, "construct", "publish", "consume", "consume"]), rnd.choice(["m0", "m1", "m2", "m3", None]), {"s": f"x{rnd.randrange(2)}"} if rnd.random() < 0.95 else {}) for i in range(400)]
    df = spark.createDataFrame([(s, "item", u, e, m, at) for s, u, e, m, at in events], "sequence bigint, information_id string, semantic_identity string, event string, mutation string, scope_instances map<string,string>")
    items = spark.createDataFrame([("item", ["m0", "m1", "m2"], ["m1", "m2"]), ("idle", [], [])], "id string, mutations array<string>, invalidators array<string>")
    mode = "construction_atomic" if atomic else "explicit"
    got = sorted(((r["sequence"], r["reason"]) for r in tr.replay_failures(df, items, "s", own, mode).collect()), key=str)
    want = brute_replay(events, {"m0", "m1", "m2"}, {"m1", "m2"}, own, "s", atomic)
    assert got == want
    verdict = {r["information_id"]: (r["observations"], r["failures"], r["verdict"]) for r in tr.replay(df, items, "s", own, mode).collect()}
    faults = sum(x[1] is not None for x in want)
    assert verdict == {"item": (sum(e == "consume" and bool(at) for _, _, e, _, at in events), faults, "FAIL"), "idle": (0, 0, "PASS")}
    direct = tr.replay_failures(df, items, "s", own, mode, "direct_consumer").where("event = 'consume' and reason is not null").count()
    assert direct == sum(e == "consume" and not at for _, _, e, _, at in events)


def test_searches(spark):
    numbers = spark.range(1, 200).withColumnRenamed("id", "n").select(F.col("n").cast("int").alias("n"))
    start = spark.createDataFrame([(1, 1.0, 1.0, "1"), (1, 1.0, 1.0, "1")], "n int, score double, w double, key string")

    def expand(front):
        kids = front.select(F.explode(F.array(F.col("n") * 2, F.col("n") * 3)).alias("n"))
        kids = kids.join(numbers, "n", "left_semi")
        return kids.select("n", (F.lit(1.0) * (F.col("n") % 10)).alias("score"), F.lit(1.0).alias("w"), F.lpad(F.col("n").cast("string"), 4, "0").alias("key"))

    got = [(r["place"], r["n"]) for r in ps.best_first(start, expand, "score", "w", "key", 1, 8, 100.0).orderBy("place").collect()]
    seen, open_, want = {1}, [1], []
    while open_ and len(want) < 8:
        n = min(open_, key=lambda x: (-(x % 10), f"{x:04d}"))
        open_.remove(n)
        want.append(n)
        for c in (2 * n, 3 * n):
            if c < 200 and c not in seen:
                seen.add(c)
                open_.append(c)
    assert [n for _, n in got] == want and [p for p, _ in got] == list(range(1, 9))
    assert ps.best_first(start, expand, "score", "w", "key", 4, 50, 5.0).count() == 5
    assert ps.best_first(start.limit(0), expand, "score", "w", "key", 4, 50, 5.0).count() == 0
    kept = ps.beam(start, expand, "score", "key", 2, 3).collect()
    assert {(r["step"], r["n"]) for r in kept if r["step"] < 2} == {(0, 1), (1, 2), (1, 3)} and max(r["step"] for r in kept) == 3

    def subsets(front):
        return front.select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("x"), "key", "paths").where(~F.contains("key", F.col("x"))).select(F.array_join(F.array_sort(F.array_append(F.split("key", ""), F.col("x"))), "").alias("key"), "paths")
    seen, steps = ps.canonical_search(spark.createDataFrame([("",)], "key string"), subsets, "key", 5)
    assert {r["key"]: r["paths"] for r in seen.collect()} == {"": 1, "a": 1, "b": 1, "c": 1, "ab": 2, "ac": 2, "bc": 2, "abc": 6}
    assert [tuple(r) for r in steps.orderBy("step").collect()] == [(1, 3, 3, 0), (2, 6, 3, 3), (3, 3, 1, 2), (4, 0, 0, 0)]


def test_shadow_report(spark):
    rows = [("g", i, float(10 - i), float(i == 3), i == 5) for i in range(10)] + [("one", 1, 1.0, 1.0, True), ("bare", 1, 1.0, 1.0, False), ("bare", 2, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, i int, s double, u double, b boolean")
    r = learning.shadow_report(df, "g", "i", "s", "u", "b", 0.1, 2).first()
    assert (r["roots"], r["recall_at_budget"], r["recall_at_1"], r["recall_at_5"], r["recall_at_tenth"], r["largest_regret"], r["median_regret"]) == (1, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0)
    assert r["reduction"] == round(10 / 3, 9)
    empty = learning.shadow_report(df.limit(0), "g", "i", "s", "u", "b", 0.1, 2).first()
    assert empty["roots"] == 0 and empty["reduction"] is None
