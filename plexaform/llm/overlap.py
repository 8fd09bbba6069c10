"""Same or nearly the same records across splits.

A record's state has named entries; its shingles are the pairs (name, value), an absent entry being a value of its own, so
every state has as many shingles as there are names, and two states that differ in d of w entries have the Jaccard
similarity (w - d) / (w + d). A minwise signature holds, for each of many random hash functions, the smallest hash of the
state's shingles; two states agree in a signature entry with the probability of their Jaccard similarity. Bands of
``ROWS`` entries are bucketed; as many bands are taken as keep the chance of losing a pair at the limit below ``MISS``.

Only buckets with records of both sides are looked at: the training side is joined with the held-out side's bucket keys, so
what meets no held-out record is dropped there. Every candidate is verified by the exact Jaccard similarity of the shingles
themselves. Copies of a state form one class first and add members, not pairs; equal digests are matched by key.

A bucket with too many candidate pairs is cut by the entries themselves: of ``differ + 1`` groups of entries a wanted pair
agrees in one whole group, so grouping by those loses nothing. Groups are cut again until they are small or so few entries
are left that all their pairs are wanted ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..session import Scratch

#: A bucket of more than this many candidate pairs is cut by the entries themselves.
PAIRS_PER_BUCKET = 100_000
#: Signature entries in a band.
ROWS = 3
#: Chance that a pair just within the limit shares no bucket.
MISS = 1e-6


def state_entries(text: Column, names: list[str]) -> Column:
    """JSON text -> array with one value per name (NULL where absent); NULL for a missing or broken text, or no entry.

    Names are compared without case and punctuation, and of equal ones the first counts; 7, 7.0, "7" and 7e0 are the same value, other texts are compared
    lower-cased and trimmed."""
    def value(clean: Column, name: str) -> Column:
        raw = F.trim(F.lower(F.try_element_at(clean, F.lit(name))))
        return F.coalesce(raw.try_cast("double").cast("string"), raw)

    def named(m: Column) -> Column:
        # a map may not hold a name twice, so later entries of the same name are dropped first
        return bound(F.transform(F.map_keys(m), lambda k: F.regexp_replace(F.lower(k), "[^0-9a-z]", "")), lambda ks: F.map_from_entries(F.filter(
            F.zip_with(ks, F.map_values(m), lambda k, v: F.struct(k.alias("key"), v.alias("value"))),
            lambda e, i: (F.array_position(ks, e["key"]) == i + 1) & e["value"].isNotNull())))

    # bound by one-element arrays, so a text is parsed once and not once per name; NULL stays NULL
    parsed = F.transform(F.array(F.from_json(text, "map<string,string>")), named)
    listed = F.transform(parsed, lambda m: F.array(*[value(m, n) for n in names]))
    return F.try_element_at(F.filter(listed, lambda a: F.exists(a, lambda x: x.isNotNull())), F.lit(1))


def shingles(state: Column, width: int) -> list[Column]:
    """One 64-bit shingle per entry of ``state``."""
    return [F.xxhash64(F.lit(i), F.coalesce(state[i], F.lit("\x00"))).alias(f"x{i}") for i in range(width)]


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """How many bands of ``rows`` signature entries lose a pair of that similarity with a chance of at most ``miss``."""
    together = similarity ** rows
    return 1 if together >= 1 else math.ceil(math.log(miss) / math.log(1 - together))


def minwise_keys(coded: DataFrame, width: int, bands: int, rows: int = ROWS, seed: int = 17) -> DataFrame:
    """coded: sid, x0 .. (shingles) -> sid, key: one row per band of the minwise signature."""
    rng = np.random.RandomState(seed)
    odd = rng.randint(0, 1 << 63, (bands, rows), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.randint(0, 1 << 63, (bands, rows), np.int64).astype(np.uint64)
    mix, half = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)]).view(np.uint64)
            keys = np.empty((bands, n), np.uint64)
            for b in range(bands):
                key = np.full(n, b + 1, np.uint64)
                for r in range(rows):
                    # a random hash of every shingle; its minimum is the signature entry
                    h = x * odd[b, r] + plus[b, r]
                    h ^= h >> half
                    h *= mix
                    key = (key ^ h.min(0)) * mix
                    key ^= key >> half
                keys[b] = key
            sid = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(sid, bands)), pa.array(keys.view(np.int64).ravel())], names=["sid", "key"])

    return coded.select("sid", *[f"x{i}" for i in range(width)]).mapInArrow(run, "sid bigint, key bigint")


def sided_rows(df: DataFrame, record: Column, side: Column, digest: Column, state: Column, tmp: Scratch, **extra: Column) -> DataFrame:
    """rid, side, digest, state, cid and ``extra`` of the rows that can overlap, written once so that texts are parsed once.

    ``cid`` is a 128-bit id of the state, NULL without one. Rows without side, without id, or without both digest and
    state are left out."""
    rows = df.select(record.cast("string").alias("rid"), side.alias("side"), digest.alias("digest"), state.alias("state"), *[c.alias(n) for n, c in extra.items()])
    rows = rows.where("side is not null and rid is not null and (digest is not null or state is not null)")
    return tmp.keep(rows.withColumn("cid", F.unhex(F.md5(F.array_join("state", "\x1f", "\x00")))))


def _sizes(table: DataFrame, tmp: Scratch) -> DataFrame:
    """k, pairs of the buckets with both sides; table: key, h, t."""
    sums = table.groupBy(F.col("key").alias("k")).agg(F.sum("t").alias("nt"), F.sum("h").alias("nh"))
    return tmp.keep(sums.where("nt > 0 and nh > 0").select("k", (F.col("nt") * F.col("nh")).alias("pairs")))


def _cut(hot: DataFrame, width: int, differ: int, tmp: Scratch) -> list[DataFrame]:
    """hot: sid, h, t, x (all shingles) -> tables sid, h, t, key in whose buckets every wanted pair meets."""
    level = hot.select("sid", "h", "t", "x", F.lit(0).cast("bigint").alias("key"), F.array(*[F.lit(i) for i in range(width)]).alias("rest"))
    out = []
    while True:
        groups = F.transform(F.sequence(F.lit(0), F.lit(differ)), lambda g: F.filter("rest", lambda p, i: i % (differ + 1) == g))
        split = level.select("sid", "h", "t", "x", "key", "rest", F.posexplode(groups).alias("g", "group"))
        split = split.select("sid", "h", "t", "x", F.xxhash64("key", "g", F.transform("group", lambda p: F.col("x")[p])).alias("key"), F.array_except("rest", "group").alias("rest"))
        split = tmp.keep(split)
        sizes = _sizes(split, tmp)
        alive = split.join(sizes, split.key == sizes.k)
        again = (F.col("pairs") > PAIRS_PER_BUCKET) & (F.size("rest") > differ)
        out.append(alive.where(~again).select("sid", "h", "t", "key"))
        if not alive.where(again).limit(1).count():
            return out
        level = alive.where(again).select("sid", "h", "t", "x", "key", "rest")


def overlap_classes(rows: DataFrame, width: int, differ: int, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs) of ``sided_rows``, whose rows are on side ``train`` or another side.

    classes: cid, sid, state, train, held (rows on either side, repeats included), one per distinct state.
    pairs: held_cid, train_cid, agree (entries that agree, absent in both included), jaccard (of the shingles): classes with
    held-out and with training members whose states differ in at most ``differ`` entries; a class with both is paired with
    itself. Rows without state are in no class."""
    grouped = rows.where("cid is not null").groupBy("cid", "state").agg(F.count_if(F.col("side") == "train").alias("train"), F.count_if(F.col("side") != "train").alias("held"))
    classes = tmp.keep(grouped.withColumn("sid", F.monotonically_increasing_id()))
    limit = (width - differ) / (width + differ)
    bands = bands_for(limit)
    coded = classes.select("sid", "held", "train", *shingles(F.col("state"), width))
    held = minwise_keys(coded.where("held > 0"), width, bands)
    train = minwise_keys(coded.where("train > 0"), width, bands)
    met = held.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("nh"))
    live_train = tmp.keep(train.join(met.hint("merge"), train.key == met.k).select("sid", "key", "nh"))
    sizes = tmp.keep(live_train.groupBy(F.col("key").alias("k")).agg((F.count(F.lit(1)) * F.first("nh")).alias("pairs")))
    live_held = tmp.keep(held.join(sizes, held.key == sizes.k).select("sid", "key", "pairs"))
    live_train = live_train.join(sizes, live_train.key == sizes.k).select("sid", "key", "pairs")
    small = F.col("pairs") <= PAIRS_PER_BUCKET
    pool = [(live_held.where(small).select("sid", "key"), live_train.where(small).select("sid", "key"))]
    if sizes.where(~small).limit(1).count():
        hot = live_held.where(~small).select("sid").unionByName(live_train.where(~small).select("sid")).distinct()
        state = coded.select(F.col("sid").alias("s2"), (F.col("held") > 0).cast("int").alias("h"), (F.col("train") > 0).cast("int").alias("t"), F.array(*[f"x{i}" for i in range(width)]).alias("x"))
        for part in _cut(hot.join(state, F.col("sid") == F.col("s2")), width, differ, tmp):
            pool.append((part.where("h = 1").select("sid", "key"), part.where("t = 1").select("sid", "key")))
    met_pairs = None
    for h, t in pool:
        part = h.withColumnRenamed("sid", "a").join(t.select(F.col("sid").alias("b"), F.col("key").alias("k2")), F.col("key") == F.col("k2")).select("a", "b")
        met_pairs = part if met_pairs is None else met_pairs.unionByName(part)
    one = classes.select(F.col("sid").alias("ka"), F.col("cid").alias("held_cid"), F.col("state").alias("sa"))
    two = classes.select(F.col("sid").alias("kb"), F.col("cid").alias("train_cid"), F.col("state").alias("sb"))
    full = met_pairs.distinct().join(one, F.col("a") == F.col("ka")).join(two, F.col("b") == F.col("kb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    full = full.select("held_cid", "train_cid", agree.alias("agree")).withColumn("jaccard", F.col("agree") / (2 * width - F.col("agree")))
    return classes, tmp.keep(full.where(F.col("jaccard") >= limit - 1e-12))


def same_key_across(df: DataFrame, value: Column, key: Column, side: Column) -> DataFrame:
    """Columns key, held_value, train_value: spellings, one from each side, that name the same key.

    NULL keys and sides never match. Rows are reduced to distinct (key, side, spelling) before they are joined."""
    rows = df.select(key.alias("key"), value.alias("value"), (side == "train").alias("train")).where("key is not null and train is not null").distinct()
    held = rows.where("not train").select("key", F.col("value").alias("held_value"))
    train = rows.where("train").select(F.col("key").alias("k2"), F.col("value").alias("train_value"))
    return held.join(train, held.key == train.k2).select("key", "held_value", "train_value")
