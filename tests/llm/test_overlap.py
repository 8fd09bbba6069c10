import json
import random

from pyspark.sql import functions as F

from plexaform.llm import overlap
from plexaform.session import Scratch

NAMES = [f"n{i}" for i in range(12)]


def pairs(spark, rows):
    """rows: id, side, digest, state -> {(held id, train id)} by classes expanded to members, and by equal digests."""
    df = spark.createDataFrame(rows, "i string, s string, d string, t string").withColumn("cid", F.lit("clash")).withColumn("state", F.lit(1))
    tmp = Scratch(spark)
    sided = overlap.sided_rows(df, F.col("i"), F.col("s"), F.col("d"), overlap.state_entries(F.col("t"), NAMES), tmp)
    _, p = overlap.overlap_classes(sided, 12, 2, tmp)
    members = {}
    for r in sided.where("cid is not null").collect():
        members.setdefault(bytes(r["cid"]), []).append((r["rid"], r["side"]))
    out = {(r["held_value"], r["train_value"]) for r in overlap.same_key_across(sided, F.col("rid"), F.col("digest"), F.col("side")).collect()}
    for r in p.collect():
        assert abs(r["jaccard"] - r["agree"] / (24 - r["agree"])) < 1e-12 and r["agree"] >= 10
        for a, sa in members[bytes(r["held_cid"])]:
            for b, sb in members[bytes(r["train_cid"])]:
                if sa != "train" and sb == "train":
                    out.add((a, b))
    return out


def brute(rows):
    def state(t):
        try:
            v = {k.lower(): float(x) for k, x in json.loads(t).items()}
        except (TypeError, ValueError, AttributeError):
            return None
        return [v.get(n) for n in NAMES] if v else None
    known = [(i, s, d, state(t)) for i, s, d, t in rows if s is not None and i is not None]
    return {(a[0], b[0]) for a in known if a[1] != "train" for b in known if b[1] == "train"
            if (a[2] is not None and a[2] == b[2]) or (a[3] and b[3] and sum(x != y for x, y in zip(a[3], b[3])) <= 2)}


def make(rnd, n, spread):
    base = [[rnd.randrange(spread) for _ in NAMES] for _ in range(n)]
    rows = []
    for i, v in enumerate(base):
        rows.append((f"t{i}", "train", f"d{i}", json.dumps(dict(zip(NAMES, v)))))
        w = list(v)
        for k in rnd.sample(range(12), rnd.randrange(5)):
            w[k] = rnd.randrange(spread)
        keys = [k.upper() if rnd.random() < 0.3 else k for k in NAMES]
        entries = {k: (float(x) if rnd.random() < 0.5 else str(x)) for k, x in zip(keys, w)}
        if rnd.random() < 0.3:
            entries.pop(rnd.choice(keys))
        items = list(entries.items())
        rnd.shuffle(items)
        rows.append((f"e{i}", rnd.choice(["test", "validation"]), f"d{i}" if rnd.random() < 0.1 else f"x{i}", json.dumps(dict(items))))
    return rows


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = make(rnd, 60, 40) + [("a", "train", None, None), ("b", "test", None, "{broken"), ("c", None, "d1", None), (None, "train", "d1", None), ("t1", "train", "d1", None)]
    assert pairs(spark, rows) == brute(rows)


def test_hot_buckets_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PAIRS_PER_BUCKET", 20)
    rnd = random.Random(6)
    rows = make(rnd, 40, 3)
    assert pairs(spark, rows) == brute(rows)


def test_copies_are_one_class(spark):
    t = json.dumps(dict.fromkeys(NAMES, 1))
    rows = [(f"t{i}", "train", "d", t) for i in range(30)] + [(f"e{i}", "test", "d", t) for i in range(20)]
    df = spark.createDataFrame(rows, "i string, s string, d string, t string")
    tmp = Scratch(spark)
    sided = overlap.sided_rows(df, F.col("i"), F.col("s"), F.col("d"), overlap.state_entries(F.col("t"), NAMES), tmp)
    classes, p = overlap.overlap_classes(sided, 12, 2, tmp)
    assert classes.count() == 1 and p.count() == 1
    assert len(pairs(spark, rows)) == 600


def test_one_bucket_holds_a_third(spark, monkeypatch):
    """States that share ten of twelve entries fill the same buckets; they are cut by the entries and lose nothing."""
    monkeypatch.setattr(overlap, "PAIRS_PER_BUCKET", 50)
    rnd = random.Random(7)
    rows = make(rnd, 30, 500)
    for i in range(30):
        v = dict.fromkeys(NAMES, 1) | {rnd.choice(NAMES): 100 + i, rnd.choice(NAMES): 200 + i}
        rows.append((f"h{i}", rnd.choice(["train", "test"]), None, json.dumps(v)))
    assert pairs(spark, rows) == brute(rows)


def test_signatures_follow_jaccard(spark):
    """The share of equal signature entries is the Jaccard similarity of the shingle sets."""
    a = [f"v{i}" for i in range(12)]
    b = a[:9] + ["x", "y", "z"]
    df = spark.createDataFrame([(0, a), (1, b)], "sid bigint, s array<string>").select("sid", *overlap.shingles(F.col("s"), 12))
    keys = {}
    for r in overlap.minwise_keys(df, 12, 4000, rows=1).collect():
        keys.setdefault(r["sid"], set()).add(r["key"])
    assert abs(len(keys[0] & keys[1]) / 4000 - 9 / 15) < 0.04
    assert overlap.bands_for(10 / 14) == 31


def test_names_given_twice(spark):
    df = spark.createDataFrame([('{"N0":1,"n0":2,"n1":null}',)], "t string")
    assert df.select(overlap.state_entries(F.col("t"), NAMES).alias("s")).first()["s"] == ["1.0"] + [None] * 11


def test_empty(spark):
    assert pairs(spark, []) == set()
    df = spark.createDataFrame([], "v string, k string, s string")
    assert overlap.same_key_across(df, F.col("v"), F.col("k"), F.col("s")).count() == 0


def test_spellings(spark):
    df = spark.createDataFrame([("A", "a", "train"), ("A", "a", "train"), ("a ", "a", "test"), ("A", "a", "test"), ("b", "b", "train"), (None, None, "test"), ("c", "c", None)], "v string, k string, s string")
    got = {(r["held_value"], r["train_value"]) for r in overlap.same_key_across(df, F.col("v"), F.col("k"), F.col("s")).collect()}
    assert got == {("a ", "A"), ("A", "A")}
