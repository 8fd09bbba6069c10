"""Parent links turned into whole hierarchies: root, depth, subtree size, nested-set range and path.

Subtree sizes are summed upward, and preorder ranges are handed downward by prefix sums over siblings, the roots being the
siblings below one virtual root. Ranges answer the rest: a node's descendants are the rows whose position lies in its range,
its ancestors the rows whose range holds its position. So its depth is the number of ranges open at its position, and its
root the last root at or before it; both come from one scan of the rows in order of position, cut into blocks of positions
with a carry from block to block. Both sweeps run over power-of-two strides
instead of single levels, so a tree of depth d takes about log2(d) rounds each way:

* upward, ``size`` counts the descendants fewer than 2^k steps below; the next round adds the sizes of the nodes
  whose 2^k-th ancestor is this one;
* downward, a node's position is the sum, over itself and its ancestors, of 1 + the sizes of earlier siblings; the
  next round adds the sum held by the 2^k-th ancestor.

A round in which no node reaches its root leaves exactly the nodes on or below loops. Only nodes with children take
part in the rounds; leaves are joined to their parents once. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from .prefix import bucketed_prefix_sum, group_buckets


#: Positions in one block of the scan.
BLOCK_BITS = 16


def _climb(tmp: Scratch, inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """inner: v, anc (NULL at a root), leaves. -> (settled: v, size), (looping: v)."""
    state = tmp.keep(inner.select("v", "anc", (F.col("leaves") + 1).alias("size")))
    active = state.where("anc is not null").count()
    while active:
        moving = state.where("anc is not null")
        added = moving.groupBy(F.col("anc").alias("a")).agg(F.sum("size").alias("more"))
        up = state.select(F.col("v").alias("u"), F.col("anc").alias("anc2"))
        jumped = moving.join(up, moving.anc == up.u, "inner").select("v", F.col("anc2").alias("anc"), "size")
        nxt = state.where("anc is null").unionByName(jumped)
        nxt = nxt.join(added, nxt.v == added.a, "left").select("v", "anc", (F.col("size") + F.coalesce(F.col("more"), F.lit(0))).alias("size"))
        new = tmp.keep(nxt)
        left = new.where("anc is not null").count()
        tmp.drop(state)
        state = new
        if left == active:
            break
        active = left
    return state.where("anc is null").select("v", "size"), state.where("anc is not null").select("v")


def _loops(tmp: Scratch, links: DataFrame) -> DataFrame:
    """links: v, anc of nodes on or below loops. -> v, smallest key of the loop it is on or below."""
    state = tmp.keep(links.select("v", F.col("anc").alias("at"), F.least("v", "anc").alias("low")))
    image = state.select("at").distinct().count()
    while image:
        up = state.select(F.col("v").alias("u"), F.col("at").alias("at2"), F.col("low").alias("low2"))
        new = tmp.keep(state.join(up, state["at"] == up.u).select("v", F.col("at2").alias("at"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        now, moved = new.agg(F.countDistinct("at"), F.max("moved")).first()
        tmp.drop(state)
        state = new.select("v", "at", "low")
        state._plexaform_path = new._plexaform_path
        # the image of a self-map stops shrinking once only loops are left; then ``low`` needs one whole turn
        if now == image and not moved:
            break
        image = now
    low = state.select(F.col("v").alias("u"), F.col("low").alias("root"))
    return state.join(low, state["at"] == low.u).select("v", "root")


def _scan(placed: DataFrame) -> DataFrame:
    """placed: v, p, size, first (dense positions), .. -> also depth and root, read from the ranges alone.

    Positions are dense, so at position x as many ranges have begun as there are positions up to x; depth is x less the
    ranges that have ended. A range of one position ends at the next, any other after its last, as a row of its own."""
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    others = [c for c in placed.columns if c not in ("first", "size")]
    begins = placed.select(*others, "first", "size", F.lit(1).alias("kind"), (F.col("size") == 1).cast("int").alias("ends"))
    after = (F.col("first") + F.col("size")).alias("first")
    closing = placed.where("size > 1").select(*[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in others], after, F.lit(None).cast("bigint").alias("size"), F.lit(0).alias("kind"), F.lit(1).alias("ends"))
    rows = begins.unionByName(closing).withColumn("block", block(F.col("first")))
    top = F.when((F.col("kind") == 1) & F.col("p").isNull(), F.col("v"))
    sums = placed.select(block(F.col("first")).alias("b"), (F.col("size") == 1).cast("int").alias("ends"), F.when(F.col("p").isNull(), F.struct("first", "v")).alias("t"))
    sums = sums.unionByName(placed.where("size > 1").select(block(F.col("first") + F.col("size")).alias("b"), F.lit(1).alias("ends"), F.lit(None).cast(sums.schema["t"].dataType).alias("t")))
    sums = sums.groupBy("b").agg(F.sum("ends").alias("ends"), F.max("t").alias("t"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("b"), F.coalesce(F.sum("ends").over(upto), F.lit(0)).alias("ended"), F.max("t").over(upto)["v"].alias("top"))
    order = Window.partitionBy("block").orderBy("first", "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("gone", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("near", F.last(top, True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.where("kind = 1").join(carry, F.col("block") == F.col("b"))
    return rows.select(*others, "size", "first", (F.col("first") - F.col("gone") - F.col("ended")).cast("int").alias("depth"), F.coalesce("near", "top").alias("root"))


def hierarchy(df: DataFrame, node: str, parent: str, paths: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per distinct ``node``: node, parent (NULL at a root), root, depth, descendants, first, last[, path].

    ``first``..``last`` is the nested-set range of the node's subtree in the whole forest: y lies below x exactly if
    x.first < y.first <= x.last. Siblings, and roots, are ordered by key (by key within hash buckets where there are more
    than 100,000 of them). ``path`` holds the keys from the root to the node.

    A parent that is NULL or not a node of the table makes a root. A node on a loop or below one has depth -1, the
    smallest key on that loop as root, and NULL in the other columns. Rows with a NULL node are left out; a node
    given more than once counts once, with its smallest parent. An empty table gives no rows.
    """
    spark = df.sparkSession
    tmp = scratch or Scratch(spark)
    rows = df.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("string").alias("v")).agg(F.min(F.col(parent).cast("string")).alias("p"))
    nodes = tmp.keep(rows)
    fans = nodes.where("p is not null").groupBy(F.col("p").alias("f")).agg(F.count(F.lit(1)).alias("children"))
    # every node with the number of its children; a named parent counts only if it is a node itself
    known = tmp.keep(nodes.join(fans, nodes.v == fans.f, "left").select("v", "p", F.coalesce("children", F.lit(0)).alias("children")))
    tmp.drop(nodes)
    there = known.where("children > 0").select(F.col("v").alias("pv"))
    linked = tmp.keep(known.join(there, known.p == there.pv, "left").select("v", F.col("pv").alias("p"), "children"))
    tmp.drop(known)
    inner = linked.where("children > 0")
    leaf_counts = linked.where("children = 0 and p is not null").groupBy(F.col("p").alias("lp")).agg(F.count(F.lit(1)).alias("leaves"))
    start = inner.join(leaf_counts, inner.v == leaf_counts.lp, "left").select("v", F.col("p").alias("anc"), F.coalesce("leaves", F.lit(0)).alias("leaves"))
    settled, looping = _climb(tmp, start)
    loop_links = inner.join(looping.withColumnRenamed("v", "lv"), inner.v == F.col("lv"), "left_semi").select("v", F.col("p").alias("anc"))
    looped = tmp.keep(_loops(tmp, loop_links))

    # downward: a child begins 1 + the sizes of its earlier siblings after its parent, a root after the earlier roots
    size_of = settled.select(F.col("v").alias("sv"), "size")
    sized = linked.join(size_of, linked.v == size_of.sv, "left").select("v", "p", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("size")).cast("bigint").alias("size"))
    most = linked.agg(F.greatest(F.coalesce(F.max("children"), F.lit(0)), F.count_if(F.col("p").isNull()))).first()[0] or 0
    placed = bucketed_prefix_sum(sized, ["p"], "v", "size", "before", group_buckets(most))
    placed = tmp.keep(placed.select("v", "p", "children", "size", F.when(F.col("p").isNull(), F.col("before")).otherwise(F.col("before") + 1).alias("w")))
    tmp.drop(linked)

    walk = placed.where("children > 0 and size is not null").select("v", F.col("p").alias("anc"), F.col("w").alias("first"), *([F.array("v").alias("path")] if paths else []))
    state = tmp.keep(walk)
    while state.where("anc is not null").limit(1).count():
        up = state.select(F.col("v").alias("u"), F.col("anc").alias("anc2"), F.col("first").alias("first2"), *([F.col("path").alias("path2")] if paths else []))
        moving = state.where("anc is not null")
        jumped = moving.join(up, moving.anc == up.u).select("v", F.col("anc2").alias("anc"), (F.col("first") + F.col("first2")).alias("first"), *([F.concat("path2", "path").alias("path")] if paths else []))
        new = tmp.keep(state.where("anc is null").unionByName(jumped))
        tmp.drop(state)
        state = new

    top = state.select(F.col("v").alias("u"), F.col("first").alias("first_u"), *([F.col("path").alias("path_u")] if paths else []))
    lead, alone = F.col("children") > 0, (F.col("children") == 0) & F.col("p").isNull()
    # a leaf is counted from its parent, an inner node has its own row
    at = placed.withColumn("look", F.when(lead, F.col("v")).otherwise(F.col("p")))
    first = F.when(alone, F.col("w")).when(lead, F.col("first_u")).otherwise(F.col("first_u") + F.col("w"))
    path = F.when(alone, F.array("v")).when(lead, F.col("path_u")).otherwise(F.concat("path_u", F.array("v")))
    ranged = tmp.keep(at.join(top, at.look == top.u, "left").select("v", "p", "look", "size", first.cast("bigint").alias("first"), *([path.alias("path")] if paths else [])))
    tmp.drop(placed, state)
    extra = ["path"] if paths else []
    good = _scan(ranged.where("first is not null").select("v", "p", "size", "first", *extra))
    good = good.select(F.col("v").alias("node"), F.col("p").alias("parent"), "root", "depth", (F.col("size") - 1).alias("descendants"), "first", (F.col("first") + F.col("size") - 1).alias("last"), *extra)
    # what the sweeps did not reach is on a loop or below one
    low = looped.select(F.col("v").alias("l"), F.col("root").alias("loop_root"))
    bad = ranged.where("first is null").join(low, F.col("look") == F.col("l"))
    null = lambda t, a: F.lit(None).cast(t).alias(a)
    bad = bad.select(F.col("v").alias("node"), null("string", "parent"), F.col("loop_root").alias("root"), F.lit(-1).alias("depth"), null("bigint", "descendants"),
                     null("bigint", "first"), null("bigint", "last"), *([null("array<string>", "path")] if paths else []))
    return good.unionByName(bad)


def subtree_totals(df: DataFrame, node: str, parent: str, sums: dict[str, Column], maxima: dict[str, Column], scratch: Scratch | None = None) -> DataFrame:
    """node, children, then each of ``sums`` and ``maxima`` over the node and all its descendants, whatever the depth.

    Bottom-up over power-of-two strides: after round k a node has the totals of what lies fewer than 2^k steps below it, and the next
    round adds the totals of the nodes whose 2^k-th ancestor it is. A node given more than once counts once, with the greatest of
    each value; a parent that is NULL or not a node makes a root; ``children`` counts distinct nodes. Nodes on or below loops are left
    out. Maxima may be structs. NULLs count as 0 in sums and are ignored in maxima. An empty table gives no rows."""
    tmp = scratch or Scratch(df.sparkSession)
    values = [c.alias(n) for n, c in [*sums.items(), *maxima.items()]]
    rows = df.where(F.col(node).isNotNull()).select(F.col(node).cast("string").alias("v"), F.col(parent).cast("string").alias("p"), *values)
    rows = tmp.keep(rows.groupBy("v").agg(F.min("p").alias("p"), *[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxima]))
    there = rows.select(F.col("v").alias("pv"))
    state = tmp.keep(rows.join(there, rows.p == there.pv, "left").select("v", F.col("pv").alias("anc"), *sums, *maxima, F.lit(0).cast("bigint").alias("children")))
    active = state.where("anc is not null").count()
    first = True
    while active:
        moving = state.where("anc is not null")
        more = moving.groupBy(F.col("anc").alias("a")).agg(*[F.sum(n).alias(f"m_{n}") for n in sums], *[F.max(n).alias(f"m_{n}") for n in maxima], F.count(F.lit(1)).alias("n"))
        up = state.select(F.col("v").alias("u"), F.col("anc").alias("anc2"))
        jumped = moving.join(up, moving.anc == up.u).select("v", F.col("anc2").alias("anc"), *sums, *maxima, "children")
        both = state.where("anc is null").unionByName(jumped).join(more, F.col("v") == F.col("a"), "left")
        new = tmp.keep(both.select("v", "anc", *[(F.col(n) + F.coalesce(f"m_{n}", F.lit(0))).alias(n) for n in sums], *[F.greatest(n, f"m_{n}").alias(n) if not isinstance(state.schema[n].dataType, T.StructType)
                                   else F.when(F.col(n).isNull() | (F.col(f"m_{n}") > F.col(n)), F.col(f"m_{n}")).otherwise(F.col(n)).alias(n) for n in maxima], F.coalesce("n", F.lit(0)).alias("children") if first else F.col("children")))
        left = new.where("anc is not null").count()
        tmp.drop(state)
        state, first = new, False
        if left == active:
            break
        active = left
    return state.where("anc is null").select(F.col("v").alias("node"), "children", *sums, *maxima)


def descendants(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """Columns ancestor, node, steps: every descendant of the nodes named in ``wanted`` (one column), by their ranges.

    ``tree`` is the result of ``hierarchy``. A range is joined with the blocks of positions it meets, so nothing is compared
    with rows far outside it. Nodes on or below loops, leaves and unknown keys have none; repeated keys count once."""
    keys = wanted.select(F.col(wanted.columns[0]).cast("string").alias("ancestor")).where("ancestor is not null").distinct()
    pick = keys.join(tree.where("descendants > 0").select(F.col("node").alias("n"), F.col("first").alias("low"), F.col("last").alias("high"), F.col("depth").alias("d")), F.col("ancestor") == F.col("n"))
    pick = pick.select("ancestor", "low", "high", "d", F.explode(F.sequence(F.shiftright(F.col("low") + 1, BLOCK_BITS), F.shiftright("high", BLOCK_BITS))).alias("b"))
    rows = tree.where("first is not null").select("node", "first", "depth", F.shiftright("first", BLOCK_BITS).alias("block"))
    hit = rows.join(pick, (F.col("block") == F.col("b")) & (F.col("first") > F.col("low")) & (F.col("first") <= F.col("high")))
    return hit.select("ancestor", "node", (F.col("depth") - F.col("d")).alias("steps"))
