import os
import random

from plexaform.llm.subjects import label_subjects, score, sentences
from plexaform.session import Scratch

TERMS = {"law": "court verdict statute appeal judge clause".split(), "sport": "goal match referee striker league keeper".split(), "music": "violin chord tempo melody choir sonata".split(),
         "food": "flour butter oven recipe spice dough".split(), "space": "orbit comet lander telescope nebula rocket".split(), "sea": "harbour anchor tide vessel sailor reef".split()}


def sentence(rnd, s):
    a = rnd.sample(TERMS[s], 3)
    return f"The {a[0]} meets one {a[1]} and then the {a[2]} again."


def corpus(seed, n):
    rnd = random.Random(seed)
    docs = []
    for i in range(n):
        main, second = rnd.sample(list(TERMS), 2)
        parts = [sentence(rnd, main) for _ in range(6)] + [sentence(rnd, second) for _ in range(3 if i % 2 else 0)] + ["Thanks, the last note looks fine."] * 3
        rnd.shuffle(parts)
        docs.append((i, " ".join(parts), {main, second} if i % 2 else {main}))
    return docs


def fit(spark, docs, labels, areas=None):
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id bigint, text string")
    l = spark.createDataFrame(labels, "doc_id bigint, subject string, text string")
    a = spark.createDataFrame(areas if areas is not None else [(s, s.title(), " ".join(t[:2])) for s, t in TERMS.items()], "subject string, title string, description string")
    return d, label_subjects(spark, d, l, a, Scratch(spark))


def test_held_out_accuracy(spark):
    docs = corpus(1, 240)
    rnd = random.Random(2)
    labels = []
    for i, _, ys in docs[:160]:
        for y in ys:
            wrong = rnd.random() < 0.05
            labels.append((i, rnd.choice(list(TERMS)) if wrong else rnd.choice([y, y.upper(), f" {y}"]), "clash"))
    labels += [(99999, "law", ""), (1, None, ""), (2, "astrology", ""), labels[0]]
    d, model = fit(spark, docs, labels)
    got = {}
    for r in score(d, "doc_id", "text", model).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == y for i, _, y in docs[160:])
    assert right >= 0.9 * 80


def test_gradient_is_the_slope_of_the_loss():
    """The summed shares give the derivatives of the loss by word vectors and outputs."""
    import numpy as np

    from plexaform.llm.subjects import unit_gradient

    rng = np.random.RandomState(3)
    vectors, out, bias = rng.randn(7, 4), rng.randn(4, 3), rng.randn(3)
    flat, lengths = np.array([0, 1, 1, 5, 2, 6, 0, 3, 4]), np.array([3, 1, 5])
    labels = rng.randint(0, 2, (3, 3)).astype(float)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])

    def at(v, o, b):
        return unit_gradient(v @ o, b, flat, np.repeat(np.arange(3), lengths)[order], first, flat[order][first], lengths, labels, False, 0.0)
    share, g_bias, n, loss = at(vectors, out, bias)
    assert n == 3
    for value, gradient, k in ((vectors, share @ out.T, 0), (out, vectors.T @ share, 1), (bias, g_bias, 2)):
        for i in np.ndindex(value.shape):
            step = np.zeros_like(value)
            step[i] = 1e-5
            moved = [vectors, out, bias]
            up, down = list(moved), list(moved)
            up[k], down[k] = value + step, value - step
            assert abs((at(*up)[3] - at(*down)[3]) / 2e-5 - gradient[i]) < 1e-3


def test_held_out_hand_labels(spark):
    """A fifth of the hand-labelled documents is kept from training; the labels, some of which are wrong, are what is compared with."""
    from pyspark.sql import functions as F

    from plexaform.llm.subjects import subject_key
    from plexaform.session import load

    sf = os.environ.get("LABEL_SF_DIR", "/root/testdata/sf0.1")
    docs, labels, areas = (load(spark, sf, t) for t in ("documents", "doc_labels", "subject_areas"))
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = label_subjects(spark, docs, labels.where(~apart), areas, Scratch(spark))
    held = labels.where(apart).select("doc_id", subject_key(F.col("subject")).alias("sk")).join(areas.select("subject", F.explode(F.array(subject_key(F.col("subject")), subject_key(F.col("title")))).alias("ak")).distinct(), F.col("sk") == F.col("ak"))
    want = {(r["doc_id"], r["subject"]) for r in held.select("doc_id", "subject").distinct().collect()}
    ids = spark.createDataFrame([(d,) for d in {d for d, _ in want}], "i bigint")
    got = {(r["doc_id"], r["subject"]) for r in score(docs.join(ids, F.col("doc_id") == F.col("i"), "left_semi"), "doc_id", "text", model).collect()}
    precision, recall = len(got & want) / len(got), len(got & want) / len(want)
    print(f"held-out labels: {len(want)}, precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.85 and recall >= 0.85


def test_edge_texts(spark):
    docs = corpus(3, 60)
    d, model = fit(spark, docs, [(i, y, "") for i, _, ys in docs for y in ys])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "   \n "), (None, "court verdict."), (5, "court verdict statute. " * 30_000), (6, "123 0xff src/a.c"), (5, "court verdict statute.")], "doc_id bigint, text string")
    got = score(odd, "doc_id", "text", model).collect()
    assert {r["doc_id"] for r in got} == {5}
    assert score(odd.limit(0), "doc_id", "text", model).count() == 0


def test_no_labels_at_all(spark):
    docs = corpus(4, 5)
    d, model = fit(spark, docs, [])
    score(d, "doc_id", "text", model).collect()
    d, model = fit(spark, docs, [], [])
    assert model.subjects == [] and score(d, "doc_id", "text", model).count() == 0


def test_sentences():
    assert sentences("The court sits. See src/a.c:8 for kamer_tu76!\n\n- one item\n- two") == [["the", "court", "sits"], ["see", "for"], ["one", "item"], ["two"]]
    assert sentences("") == []
