"""Connected components by parallel hooking and shortcutting over parent arrays held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _shortcut(tmp: Scratch, parents: DataFrame) -> DataFrame:
    """parents: v, p with p <= v. Every pointer is moved to its root by repeated doubling."""
    while True:
        up = parents.select(F.col("v").alias("u"), F.col("p").alias("p2"))
        # roots point at themselves, so a v whose parent is a root stays
        jumped = tmp.keep(parents.join(up, parents.p == up.u).select("v", F.col("p2").alias("p"), (F.col("p2") != F.col("p")).alias("moved")))
        moved = jumped.where("moved").limit(1).count()
        tmp.drop(parents)
        nxt = jumped.select("v", "p")
        nxt._plexaform_path = jumped._plexaform_path
        parents = nxt
        if not moved:
            return parents


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch | None = None) -> DataFrame:
    """Columns v, component for every distinct non-NULL end of an edge; component is the smallest key reachable.

    Each round hooks every vertex to its smallest neighbour if that is smaller, shortcuts all pointers to roots, and
    replaces edges by the distinct edges between roots, so the edge table shrinks with every round; the rounds' pointer
    tables are joined once at the end, from the last to the first. Edges with one NULL end only name their other end.
    Repeated edges and loops change nothing. An empty table gives no rows.
    """
    tmp = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    alone = e.select(F.explode(F.array("a", "b")).alias("v")).where("v is not null").distinct()
    current = tmp.keep(e.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while current.limit(1).count():
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = tmp.keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p")))
        parents = _shortcut(tmp, hooked)
        levels.append(parents)
        at = parents.select(F.col("v").alias("u"), F.col("p").alias("r"))
        half = current.join(at, current.a == at.u).select(F.col("r").alias("a"), "b")
        at2 = parents.select(F.col("v").alias("u"), F.col("p").alias("r"))
        full = half.join(at2, half.b == at2.u).select("a", F.col("r").alias("b")).where("a <> b")
        new = tmp.keep(full.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        tmp.drop(current)
        current = new
    if not levels:
        return alone.select("v", F.col("v").alias("component"))
    out = levels[-1]
    for level in reversed(levels[:-1]):
        later = out.select(F.col("v").alias("u"), F.col("p").alias("p2"))
        out = level.join(later, level.p == later.u, "left").select("v", F.coalesce("p2", "p").alias("p"))
    done = out.select(F.col("v").alias("u"), F.col("p").alias("component"))
    # hooking goes to smaller keys only, so the surviving root is the smallest key of its component
    return alone.join(done, alone.v == done.u, "left").select("v", F.coalesce("component", "v").alias("component"))
