"""Graph operators over edge tables. Loops cut lineage by writing each round to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Pile, Scratch
from .components import connected_components


def transitive_closure(edges: DataFrame, src: str, dst: str, tmp: Scratch | None = None) -> DataFrame:
    """Distinct (a, b) with a path of at least one edge; semi-naive, doubling the path length every round."""
    tmp = tmp or Scratch(edges.sparkSession)
    new = total = tmp.keep(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct())
    while True:
        left = new.select("a", F.col("b").alias("m"))
        right = total.select(F.col("a").alias("m2"), "b")
        hops = left.join(right, F.col("m") == F.col("m2")).select("a", "b")
        back = total.select("a", F.col("b").alias("m")).join(new.select(F.col("a").alias("m2"), "b"), F.col("m") == F.col("m2")).select("a", "b")
        fresh = tmp.keep(hops.unionByName(back).distinct().join(total, ["a", "b"], "left_anti"))
        if not fresh.limit(1).count():
            return total
        grown = tmp.keep(total.unionByName(fresh))
        new, total = fresh, grown


def reachable(edges: DataFrame, src: str, dst: str, seeds: DataFrame, seed: str, tmp: Scratch | None = None) -> DataFrame:
    """v: the seeds and everything reached from them, to any depth; only newly reached nodes travel."""
    tmp = tmp or Scratch(edges.sparkSession)
    links = tmp.keep(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null").distinct())
    front = tmp.keep(seeds.select(F.col(seed).alias("v")).where("v is not null").distinct())
    seen = Pile(tmp, front)
    while True:
        step = links.join(front, F.col("s") == F.col("v"), "left_semi").select(F.col("d").alias("v")).distinct()
        front = tmp.keep(step.join(seen.all(), "v", "left_anti"))
        if not front.limit(1).count():
            return seen.all()
        seen.add(front)


def strong_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """v, component (smallest member) of every end of an edge: nodes that reach each other.

    Nodes without a way in or out are alone and are taken off first. Of the rest each takes the greatest node that reaches it
    as its colour; a colour's component is what reaches the node it is named after within the colour. Found components are taken
    off and the rest goes on. Tables stay of the size of the graph, unlike its closure."""
    tmp = Scratch(edges.sparkSession)
    e = tmp.keep(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null and s <> d").distinct())
    nodes = edges.select(F.explode(F.array(src, dst)).alias("v")).where("v is not null").distinct()
    found: list[DataFrame] = []
    left = e.count()
    while left:
        while True:
            both = e.join(e.select(F.col("d").alias("x")).distinct(), F.col("s") == F.col("x"), "left_semi").join(e.select(F.col("s").alias("y")).distinct(), F.col("d") == F.col("y"), "left_semi")
            trimmed = tmp.keep(both)
            n = trimmed.count()
            tmp.drop(e)
            e = trimmed
            if n == left:
                break
            left = n
        if not left:
            break
        colour = tmp.keep(e.select(F.explode(F.array("s", "d")).alias("v")).distinct().withColumn("c", F.col("v")))
        moved = True
        while moved:
            come = e.join(colour, F.col("s") == F.col("v")).groupBy("d").agg(F.max("c").alias("best"))
            new = tmp.keep(colour.join(come, F.col("v") == F.col("d"), "left").select("v", F.greatest("c", "best").alias("c"), (F.col("best") > F.col("c")).alias("moved")))
            moved = new.where("moved").limit(1).count()
            tmp.drop(colour)
            colour = new.select("v", "c")
            colour._plexaform_path = new._plexaform_path
        ends = e.join(colour.select(F.col("v").alias("x"), F.col("c").alias("cs")), F.col("s") == F.col("x")).join(colour.select(F.col("v").alias("y"), F.col("c").alias("cd")), F.col("d") == F.col("y"))
        inside = ends.where("cs = cd").select(F.col("d").alias("s"), F.col("s").alias("d"))
        # backward from every colour's name; edges stay inside one colour, so what is reached belongs to that colour
        part = reachable(inside, "s", "d", colour.where("v = c"), "v", tmp)
        part = tmp.keep(part.join(colour.select(F.col("v").alias("x"), "c"), F.col("v") == F.col("x")).select("v", "c"))
        found.append(part)
        gone = part.select(F.col("v").alias("g"))
        rest = tmp.keep(e.join(gone, F.col("s") == F.col("g"), "left_anti").join(gone, F.col("d") == F.col("g"), "left_anti"))
        tmp.drop(e, colour)
        e, left = rest, rest.count()
    if not found:
        return nodes.select("v", F.col("v").alias("component"))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    names = every.groupBy("c").agg(F.min("v").alias("component"))
    member = every.join(names, "c").select(F.col("v").alias("m"), "component")
    return nodes.join(member, F.col("v") == F.col("m"), "left").select("v", F.coalesce("component", "v").alias("component"))


def recursive_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """component, size of components of several nodes or with a loop."""
    comp = strong_components(edges, src, dst)
    loops = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("l")).distinct()
    marked = comp.join(loops, F.col("v") == F.col("l"), "left")
    return marked.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("l").isNotNull()).alias("loop")).where("size > 1 or loop").select("component", "size")


def effect_closure(own: DataFrame, node: str, effect: str, calls: DataFrame, caller: str, callee: str) -> DataFrame:
    """node, effect: own effects and those of everything called, directly or not: a monotone union up to its fixpoint,
    in which only newly found effects travel. Rounds go on until none is found: nodes x effects is finite, and a NULL
    effect counts as one effect."""
    tmp = Scratch(own.sparkSession)
    fresh = tmp.keep(own.select(F.col(node).alias("n"), F.col(effect).alias("e")).distinct())
    total = Pile(tmp, fresh)
    links = tmp.keep(calls.select(F.col(caller).alias("c"), F.col(callee).alias("d")).distinct())
    while True:
        up = fresh.join(links, F.col("n") == F.col("d")).select(F.col("c").alias("n"), "e").distinct()
        known = total.all().select(F.col("n").alias("kn"), F.col("e").alias("ke"))
        new = tmp.keep(up.join(known, F.col("n").eqNullSafe(F.col("kn")) & F.col("e").eqNullSafe(F.col("ke")), "left_anti"))
        if not new.limit(1).count():
            return total.all().select(F.col("n").alias(node), F.col("e").alias(effect))
        total.add(new)
        fresh = new


def bounded_slice(edges: DataFrame, src: str, dst: str, seeds: DataFrame, seed: str, depth: int, budget: int) -> DataFrame:
    """v, depth, direction, kept: breadth-first callees (out) and callers (in) up to ``depth``; ``kept`` within the first
    ``budget`` nodes of each direction by (depth, v)."""
    tmp = Scratch(edges.sparkSession)
    out = None
    for direction, a, b in (("out", src, dst), ("in", dst, src)):
        seen = front = tmp.keep(seeds.select(F.col(seed).alias("v"), F.lit(0).alias("depth")).distinct())
        for d in range(1, depth + 1):
            step = front.join(edges.select(F.col(a).alias("x"), F.col(b).alias("y")), F.col("v") == F.col("x")).select(F.col("y").alias("v")).distinct()
            front = tmp.keep(step.join(seen, "v", "left_anti").withColumn("depth", F.lit(d)))
            if not front.limit(1).count():
                break
            seen = tmp.keep(seen.unionByName(front))
        first = seen.orderBy("depth", "v").limit(budget).withColumnRenamed("v", "k").drop("depth")
        part = seen.join(first, F.col("v") == F.col("k"), "left").select("v", "depth", F.lit(direction).alias("direction"), F.col("k").isNotNull().alias("kept"))
        out = part if out is None else out.unionByName(part)
    return out


def topological_levels(edges: DataFrame, src: str, dst: str, nodes: DataFrame | None = None) -> DataFrame:
    """v, level: longest number of edges from a node without predecessor; NULL on a cycle and behind one."""
    every = nodes if nodes is not None else edges.select(F.explode(F.array(src, dst)).alias("v"))
    return _levels(edges, src, dst, every.select("v").where("v is not null").distinct().withColumn("w", F.lit(1.0))).select("v", "level")


def _levels(edges: DataFrame, src: str, dst: str, weighted: DataFrame) -> DataFrame:
    """weighted: v, w -> v, level, cost (weight of the heaviest path that ends in v); NULLs on a cycle and behind one.

    A node waits until all its predecessors are done and keeps the heaviest of them; each round hands the nodes just done to
    their successors and never reads earlier ones again."""
    tmp = Scratch(edges.sparkSession)
    e = tmp.keep(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null").distinct())
    need = e.groupBy("d").agg(F.count(F.lit(1)).alias("need"))
    waiting = tmp.keep(weighted.join(need, F.col("v") == F.col("d"), "left").select("v", "w", F.coalesce("need", F.lit(0)).cast("bigint").alias("need"), F.lit(0.0).alias("best")))
    level, done = 0, None
    while True:
        ready = tmp.keep(waiting.where("need <= 0").select("v", F.lit(level).alias("level"), (F.col("best") + F.col("w")).alias("cost")))
        if not ready.limit(1).count():
            break
        if done is None:
            done = Pile(tmp, ready)
        else:
            done.add(ready)
        freed = e.join(ready, F.col("s") == F.col("v")).groupBy("d").agg(F.count(F.lit(1)).alias("freed"), F.max("cost").alias("come"))
        rest = waiting.where("need > 0").join(freed, F.col("v") == F.col("d"), "left").select(
            "v", "w", (F.col("need") - F.coalesce("freed", F.lit(0))).alias("need"), F.greatest("best", "come").alias("best"))
        new = tmp.keep(rest)
        tmp.drop(waiting)
        waiting, level = new, level + 1
    out = waiting.select("v", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("cost"))
    return out if done is None else out.unionByName(done.all())


def critical_path(edges: DataFrame, src: str, dst: str, weights: DataFrame, node: str, weight: str) -> DataFrame:
    """v, cost: weight of the heaviest path that ends in v; a weight that is NULL or 0 counts as 1. Cycles give no rows."""
    w = weights.select(F.col(node).alias("v"), F.when(F.coalesce(weight, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col(weight).cast("double")).alias("w"))
    return _levels(edges, src, dst, w).where("level is not null").select("v", "cost")


def fusion_regions(edges: DataFrame, src: str, dst: str, barriers: DataFrame, barrier: str) -> DataFrame:
    """v, component: connected parts after the barrier nodes are taken out."""
    b = barriers.select(F.col(barrier).alias("__b")).distinct()
    kept = edges.join(b, F.col(src) == F.col("__b"), "left_anti").join(b, F.col(dst) == F.col("__b"), "left_anti")
    return connected_components(kept, src, dst)


def routes(links: DataFrame, start, end, longest: int = 6) -> DataFrame:
    """path, latency, bandwidth, hops of every simple path from ``start`` to ``end`` with at most ``longest`` nodes.

    links: from, to, latency, bandwidth."""
    tmp = Scratch(links.sparkSession)
    front = tmp.keep(links.where(F.col("from") == start).select(F.array("from", "to").alias("path"), F.col("latency").cast("double").alias("latency"), F.col("bandwidth").cast("double").alias("bandwidth")).where("path[0] <> path[1]"))
    found = front
    for _ in range(2, longest):
        at = front.where(F.element_at("path", -1) != end)
        l = links.select("from", "to", F.col("latency").alias("l2"), F.col("bandwidth").alias("b2"))
        step = at.join(l, (F.element_at("path", -1) == F.col("from"))).where(~F.array_contains("path", F.col("to")))
        front = tmp.keep(step.select(F.array_append("path", F.col("to")).alias("path"), (F.col("latency") + F.col("l2")).alias("latency"), F.least("bandwidth", F.col("b2").cast("double")).alias("bandwidth")))
        if not front.limit(1).count():
            break
        found = found.unionByName(front)
    return found.where(F.element_at("path", -1) == end).withColumn("hops", F.size("path") - 1)


def wl_labels(nodes: DataFrame, node: str, label: str, edges: DataFrame, src: str, dst: str, relation: str, rounds: int, both_ways: bool) -> DataFrame:
    """v, label: Weisfeiler-Lehman colours, each round a digest of the own colour and the sorted neighbour colours."""
    tmp = Scratch(nodes.sparkSession)
    state = tmp.keep(nodes.select(F.col(node).alias("v"), F.sha2(F.col(label).cast("string"), 256).alias("c")))
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d"), F.col(relation).cast("string").alias("r"))
    for _ in range(rounds):
        other = state.select(F.col("v").alias("o"), F.col("c").alias("oc"))
        parts = e.join(other, F.col("s") == F.col("o")).select(F.col("d").alias("t"), F.concat(F.lit("<"), "r", "oc").alias("x"))
        if both_ways:
            parts = parts.unionByName(e.join(other, F.col("d") == F.col("o")).select(F.col("s").alias("t"), F.concat(F.lit(">"), "r", "oc").alias("x")))
        # equal neighbour colours are counted first, so a hub holds one entry per colour and not one per edge
        counted = parts.groupBy("t", "x").agg(F.count(F.lit(1)).alias("n"))
        gathered = counted.groupBy("t").agg(F.array_join(F.sort_array(F.collect_list(F.concat("x", F.lit("*"), F.col("n").cast("string")))), ",").alias("x"))
        new = tmp.keep(state.join(gathered, F.col("v") == F.col("t"), "left").select("v", F.sha2(F.concat("c", F.lit("|"), F.coalesce("x", F.lit(""))), 256).alias("c")))
        tmp.drop(state)
        state = new
    return state.select("v", F.col("c").alias("label"))


def ordered_digest(df: DataFrame, order: list[str], payload: list[Column]) -> DataFrame:
    """One row: digest of the digests of all rows in the order given (NULLs written out), and their number."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in payload]), 256)
    buckets = max(1, -(-df.count() // 100_000))  # a bucket holds about 100,000 digests
    parts = df.select(F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("b"), F.struct(*order, row.alias("h")).alias("s"))
    per = parts.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.h), ","), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda s: s.d), ","), 256).alias("digest"), F.sum("n").alias("n"))


def live_overlap(intervals: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """group, most: largest number of intervals [start, end] open at once; a sweep over their ends."""
    from pyspark.sql import Window

    ends = intervals.select(*group, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(0).alias("o"), F.lit(1).alias("x")), F.struct(F.col(end).alias("t"), F.lit(1).alias("o"), F.lit(-1).alias("x")))).alias("e"))
    w = Window.partitionBy(*group).orderBy("e.t", "e.o").rowsBetween(Window.unboundedPreceding, 0)
    return ends.select(*group, F.sum("e.x").over(w).alias("n")).groupBy(*group).agg(F.max("n").alias("most"))
