"""Subject areas of documents.

A word is the sum of its own embedding and the mean of its subword embeddings (hashed character 3- to 5-grams), a unit of
text the mean of its words, and each subject an independent logistic output on it. Training is synchronous: every round
each partition of the labelled units returns the summed gradient for its units, the driver adds the gradients up and
takes one step. Round by round, units are first whole labelled documents, then their single sentences, each standing for
the subject among its document's labels that the model finds likeliest; from a later round on a sentence that clearly
belongs to another subject stands for that one, which takes the edge off wrong labels.

A document's subjects are those of at least a fifth of its sentences that are about any subject. All documents are
scored; only training reads a bounded sample of labelled ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .text import chunks, repaired

#: Labelled documents used for training at most, taken in the order of a hash of their id.
MAX_LABELLED = 4096
BUCKETS = 1 << 15
DIM = 24
SETTLED = 0.3
#: Part of all subjects' odds that a sentence's likeliest subject must hold.
CLEAR = 0.75

_LEAD = re.compile(r"(?m)^\s*(?://|>|#|\*)+\s?")
#: A word (no part of a path, number or name of code), or what ends a sentence.
_TOKEN = re.compile(
    r"(?<![\w/\\:])[^\W\d_]++(?:-[^\W\d_]++)*+(?![\w/\\]|::|[.:]\w)"
    r"|[.?!](?=\s|$)|\n\s*\n|\n(?=\s*(?:[-*]\s|\[\d\d:))")


def tokens(text: str) -> list[str]:
    """Lower-case words in order, with a token that is no word after every sentence."""
    return _TOKEN.findall(_LEAD.sub("", repaired(text)).lower())


def is_word(token: str) -> bool:
    return token[0].isalpha()


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence that has any; names of code, paths and numbers are no words."""
    out: list[list[str]] = [[]]
    for t in tokens(text):
        if is_word(t):
            out[-1].append(t)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, buckets of all subwords, where each word's subwords begin and end)."""
    own = np.array([zlib.crc32(w.encode()) % BUCKETS for w in words], np.int64)
    subs, ends = [], [0]
    for w in words:
        x = f"<{w}>"
        grams = [x[i:i + n] for n in (3, 4, 5) for i in range(len(x) - n + 1)] or [x]
        subs.extend(BUCKETS + zlib.crc32(g.encode()) % BUCKETS for g in grams)
        ends.append(len(subs))
    return own, np.array(subs, np.int64), np.array(ends, np.int64)


@dataclass
class Model:
    subjects: list[str]
    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def word_vectors(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, DIM), np.float32)
        own, subs, ends = features(words)
        return self.table[own] + np.add.reduceat(self.table[subs], ends[:-1]) / np.diff(ends)[:, None]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def unit_gradient(logits: np.ndarray, bias: np.ndarray, flat: np.ndarray, units: np.ndarray, first: np.ndarray, words: np.ndarray, lengths: np.ndarray, labels: np.ndarray,
                  single: bool, sure: float) -> tuple[np.ndarray, np.ndarray, int, float]:
    """What units contribute to the gradient of the logistic loss, the summed gradient of the bias, the number of units and their loss.

    ``logits`` holds each word's vector times the outputs. A unit's vector is the mean of its words', so the gradient of a word's vector is
    W @ outputs^T and that of the outputs vectors^T @ W, where W sums, per word, what each unit that holds it leaves over divided by the
    unit's length; W is all that is summed here. ``flat``: the words of all units in turn; sorted by word, ``units`` are the units of
    those, ``first`` where each of ``words`` begins."""
    starts = np.cumsum(lengths) - lengths
    p = _sigmoid(np.add.reduceat(logits[flat], starts) / lengths[:, None] + bias)
    if single:
        within = np.where(labels > 0, p, 0)
        target = within.argmax(1)
        if sure:
            clear = (p.max(1) > sure) & (within.max(1) < 0.3)
            target = np.where(clear, p.argmax(1), target)
        y = np.zeros_like(p)
        y[np.arange(len(y)), target] = 1
    else:
        y = labels
    g = (p - y).astype(np.float32)
    share = np.zeros_like(logits)
    share[words] = np.add.reduceat((g / lengths[:, None].astype(np.float32))[units], first)
    loss = -np.log(np.where(y > 0, p, 1 - p) + 1e-9).sum()
    return share, g.sum(0), len(g), float(loss)


class _Adam:
    def __init__(self, like: np.ndarray):
        self.m, self.v, self.t = np.zeros_like(like), np.zeros_like(like), 0

    def step(self, p: np.ndarray, g: np.ndarray, rate: float) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        p -= rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.99 ** self.t)) + 1e-8)


def train(spark: SparkSession, labelled: DataFrame, subjects: list[str], tmp: Scratch, rounds: tuple[int, int, int] = (25, 10, 15), most: int = 60,
          partitions: int = 4, seed: int = 7) -> Model:
    """labelled: doc_id, text, labels (array of subject numbers); already bounded in number by the caller.

    ``rounds``: on whole documents, on sentences, and on sentences with labels corrected. The first phase goes on, up to
    ``most`` rounds, until the loss has come down to SETTLED of what it was."""
    split = labelled.mapInPandas(_split_units, "doc_id bigint, sentence int, words array<string>, labels array<int>")
    units = tmp.keep(split.repartition(partitions, "doc_id"))
    words = sorted(r[0] for r in units.select(F.explode("words")).distinct().collect())
    rng = np.random.RandomState(seed)
    table = ((rng.rand(2 * BUCKETS, DIM) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, len(subjects)), np.float32), np.full(len(subjects), -2.0, np.float32)
    if not words:
        return Model(subjects, table, out, bias)
    number = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    coded = tmp.keep(units.mapInPandas(_packer(number, len(subjects)), ", ".join(f"{c} binary" for c in _PACKED)))
    own, subs, ends = features(words)
    width = np.diff(ends)
    adams = [_Adam(table), _Adam(out), _Adam(bias)]
    docs, plain, corrected = rounds
    at_first = None
    r = 0
    while r < docs + plain + corrected:
        single, sure = r >= docs, 0.6 if r >= docs + plain else 0.0
        rate = 0.05 if not single else 0.03 if r < docs + plain + corrected // 2 else 0.015
        vectors = (table[own] + np.add.reduceat(table[subs], ends[:-1]) / width[:, None]).astype(np.float32)
        state = spark.sparkContext.broadcast((vectors @ out, bias))
        parts = coded.mapInPandas(_gradient(state, single, sure), "share binary, bias binary, units bigint, loss double").collect()
        state.destroy()
        n = max(1, sum(p["units"] for p in parts))
        share = sum(np.frombuffer(p["share"], np.float32).reshape(len(words), -1) for p in parts) / n
        g_words, g_out = share @ out.T, vectors.T @ share
        g_bias = sum(np.frombuffer(p["bias"], np.float32) for p in parts) / n
        g_table = np.zeros_like(table)
        np.add.at(g_table, own, g_words)
        np.add.at(g_table, subs, np.repeat(g_words / width[:, None], width, axis=0))
        for adam, p, g in zip(adams, (table, out, bias), (g_table, g_out, g_bias)):
            adam.step(p, g.astype(np.float32), rate)
        loss = sum(p["loss"] for p in parts) / n
        at_first = loss if at_first is None else at_first
        r += 1
        if r == docs and docs < most and loss > SETTLED * at_first:
            docs += 1
    return Model(subjects, table, out, bias)


def _split_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(d, k, s, list(y)) for d, t, y in zip(batch["doc_id"], batch["text"], batch["labels"]) for k, s in enumerate(sentences(t or ""))]
        yield pd.DataFrame(rows, columns=["doc_id", "sentence", "words", "labels"])


#: Columns of packed units.
_PACKED = ["flat", "first", "words", "by_sentence", "by_document", "lengths", "doc_lengths", "labels", "doc_labels"]


def _packer(number, subjects: int):
    """The units of a partition as one row of arrays, all that does not change from round to round worked out once."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        get = number.value.__getitem__
        pdf = pd.concat(rows, ignore_index=True).sort_values(["doc_id", "sentence"], kind="stable")
        labels = np.zeros((len(pdf), subjects), np.float32)
        for k, ys in enumerate(pdf["labels"]):
            labels[k, list(ys)] = 1
        flat = np.array([get(w) for ws in pdf["words"] for w in ws], np.int64)
        ids, lengths = pdf["doc_id"].to_numpy(), pdf["words"].str.len().to_numpy(np.int64)
        docs = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
        doc_lengths = np.add.reduceat(lengths, docs)
        arrays = {"flat": flat, "first": first, "words": flat[order][first], "by_sentence": np.repeat(np.arange(len(lengths)), lengths)[order],
                  "by_document": np.repeat(np.arange(len(docs)), doc_lengths)[order], "lengths": lengths, "doc_lengths": doc_lengths, "labels": labels, "doc_labels": labels[docs]}
        yield pd.DataFrame({k: [arrays[k].tobytes()] for k in _PACKED})
    return pack


def _gradient(state, single: bool, sure: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logits, bias = state.value
        for batch in batches:
            for row in batch.to_dict("records"):
                whole = lambda name: np.frombuffer(row[name], np.int64)  # noqa: B023, E731
                units, lengths, labels = (whole("by_sentence"), whole("lengths"), row["labels"]) if single else (whole("by_document"), whole("doc_lengths"), row["doc_labels"])
                share, b, n, loss = unit_gradient(logits, bias, whole("flat"), units, whole("first"), whole("words"), lengths, np.frombuffer(labels, np.float32).reshape(len(lengths), -1), single, sure)
                yield pd.DataFrame({"share": [share.astype(np.float32).tobytes()], "bias": [b.astype(np.float32).tobytes()], "units": [n], "loss": [loss]})
    return run


def score(documents: DataFrame, doc_id: str, text: str, model: Model, share: float = 0.2, least: float = 0.5, clear: float = CLEAR) -> DataFrame:
    """Columns doc_id, subject, sentences (about it), about_any: one row per document and subject of at least ``share``
    of the sentences that are about any subject; a sentence is about its likeliest subject, if that has ``least`` and its odds are
    the part ``clear`` of all subjects' odds: set phrases that occur with every subject lean to one, but not clearly."""
    state = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = state.value
        if not m.subjects:
            return
        number: dict[str, int] = {}
        logits, word = np.zeros((0, len(m.subjects)), np.float32), np.zeros(0, bool)
        for batch in (c for b in batches for c in chunks(b)):
            texts = [tokens(t) if t else [] for t in batch["text"]]
            flat = np.fromiter((number.setdefault(w, len(number)) for ts in texts for w in ts), np.int64)
            if not len(flat):
                continue
            if len(number) > len(logits):
                new = list(number)[len(logits):]
                logits = np.concatenate([logits, (m.word_vectors(new) @ m.out).astype(np.float32)])
                word = np.concatenate([word, [is_word(w) for w in new]])
            # sentences end at tokens that are no words and at the end of a text
            doc = np.repeat(np.arange(len(texts)), [len(ts) for ts in texts])
            keep = word[flat]
            unit = np.cumsum(~keep)[keep]
            doc, flat = doc[keep], flat[keep]
            if not len(flat):
                continue
            starts = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (doc[1:] != doc[:-1])])
            lengths = np.diff(np.r_[starts, len(flat)])
            z = np.add.reduceat(logits[flat], starts) / lengths[:, None] + m.bias
            best = z.argmax(1)
            top = z[np.arange(len(z)), best]
            odds = np.exp(np.clip(z - top[:, None], -30, 0)).sum(1)
            about = (_sigmoid(top) >= least) & (1 / odds >= clear)
            ids = batch["doc_id"].to_numpy()[doc[starts]][about]
            if len(ids):
                pairs = pd.DataFrame({"doc_id": ids, "k": best[about]}).value_counts().reset_index(name="sentences")
                pairs["about_any"] = pairs.groupby("doc_id")["sentences"].transform("sum")
                pairs = pairs[pairs["sentences"] >= share * pairs["about_any"]]
                pairs["subject"] = [m.subjects[k] for k in pairs["k"]]
                yield pairs[["doc_id", "subject", "sentences", "about_any"]]
            if len(number) > 500_000:
                number, logits, word = {}, np.zeros((0, len(m.subjects)), np.float32), np.zeros(0, bool)

    source = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return source.mapInPandas(run, "doc_id bigint, subject string, sentences bigint, about_any bigint")


def subject_key(col):
    return F.regexp_replace(F.lower(col), "[^a-z]", "")


def label_subjects(spark: SparkSession, documents: DataFrame, labels: DataFrame, areas: DataFrame, tmp: Scratch, max_labelled: int = MAX_LABELLED) -> Model:
    """Train on hand labels (a subject's name or title in any spelling) and on the areas' own descriptions.

    Labels that name no area and labels of missing documents are left out. ``areas`` is a small, fixed table."""
    rows = [(r["subject"], r["title"] or "", r["description"] or "") for r in areas.where("subject is not null").orderBy("subject").collect()]
    names = [r[0] for r in rows]
    known = spark.createDataFrame([(k, i) for i, r in enumerate(rows) for k in {re.sub("[^a-z]", "", x.lower()) for x in r[:2]} if k] or [("", -1)], "k string, subject_no int")
    tagged = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), subject_key(F.col("subject")).alias("sk")).join(F.broadcast(known), F.col("sk") == F.col("k"))
    per_doc = tagged.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject_no")).alias("labels"))
    chosen = tmp.keep(per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("d"), "text").join(F.broadcast(chosen), F.col("d") == F.col("doc_id")).select("doc_id", "text", "labels")
    described = spark.createDataFrame([(-1 - i, f"{r[1]}. {r[2]}.", [i]) for i, r in enumerate(rows)] or [(-1, "", [0])], "doc_id bigint, text string, labels array<int>")
    return train(spark, texts.unionByName(described), names, tmp)
