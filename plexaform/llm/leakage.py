"""Evaluation texts that leak into training text.

Texts are reduced to words that survive layout, case, punctuation and encoding. The word trigrams of all items form a
hash set that every task holds; documents are scanned once, window by window, against it. Where enough windows of one
item are hit, the hits are chained in order and the stretch is verified word by word.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .text import chunks, repaired

GRAM = 3
#: Words of items that every task holds at once; a larger set is scanned block by block.
BLOCK_WORDS = 250_000
#: Share of an item's words that may be dropped, added, swapped or replaced.
SLACK = 1 / 8

_LINE = re.compile(r"(?m)^[ \t]*(?:(?://+|[>#*+\-=]+|\d{1,3}[.)])[ \t]+|\[\d\d:\d\d:\d\d\][ \t]+\w+[ \t]+)+(?:rule:[ \t]+)?")
_WRAP = re.compile(r"-[ \t]*\n[ \t]*(?:(?://+|[>#*]+)[ \t]*)?")
_KEEP = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_DROP = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MARKS = re.compile("[\u0300-\u036f]+")
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]+")
_SIGNS = re.compile(r"[^\w\s]+|_+")


def plain_words(text: str) -> list[bytes]:
    """Lower-case words of letters and digits of any script: line prefixes, wraps, punctuation, markup, accents and encoding
    slips are gone."""
    text = _WRAP.sub("", repaired(text))
    if "\n" in text:
        text = _LINE.sub("", text)
    text = text.lower()
    if text.isascii():
        return text.encode().translate(_KEEP, _DROP).split()
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return " ".join(_SIGNS.sub("", _CONTROL.sub(" ", text)).split()).encode("utf-8", "replace").split()


class ItemIndex:
    """Trigram set of the items: sorted codes, and for each code the places (item, word) it stands at."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.items = dict(items)
        self.vocabulary: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.base = len(self.vocabulary) + 1
        at: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            ids = [self.vocabulary[w] for w in words]
            for k in range(len(ids) - GRAM + 1):
                code = 0
                for x in ids[k:k + GRAM]:
                    code = code * self.base + x
                at.setdefault(code, []).append((item, k))
        self.codes = np.array(sorted(at), np.int64)
        self.places = [at[c] for c in self.codes.tolist()]

    def hits(self, docs: list[list[bytes]]) -> dict[int, list[tuple[int, int]]]:
        """document number -> [(word, number of the code)]"""
        if not len(self.codes):
            return {}
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for d in docs for w in d), np.int64, sum(map(len, docs)))
        if len(ids) < GRAM:
            return {}
        lengths = np.array([len(d) for d in docs])
        starts = np.cumsum(lengths) - lengths
        live = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))
        code = (ids[live] * self.base + ids[live + 1]) * self.base + ids[live + 2]
        k = np.searchsorted(self.codes, code)
        k[k == len(self.codes)] = 0
        hit = self.codes[k] == code
        live, k = live[hit], k[hit]
        doc = np.searchsorted(starts, live, side="right") - 1
        # a window must not run into the next document
        inside = live + GRAM <= starts[doc] + lengths[doc]
        out: dict[int, list[tuple[int, int]]] = {}
        for d, p, c in zip(doc[inside].tolist(), (live - starts[doc])[inside].tolist(), k[inside].tolist()):
            out.setdefault(d, []).append((p, c))
        return out


def _runs(places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(document word, item word) windows -> maximal runs (document start, item start, words)."""
    by_shift: dict[int, list[int]] = {}
    for d, i in places:
        by_shift.setdefault(d - i, []).append(d)
    runs = []
    for shift, at in by_shift.items():
        at.sort()
        start = end = at[0]
        for d in at[1:]:
            if d > end + 1:
                runs.append((start, start - shift, end - start + GRAM))
                start = d
            end = d
        runs.append((start, start - shift, end - start + GRAM))
    return sorted(runs)


def verify(doc: list[bytes], item: list[bytes], places: list[tuple[int, int]], least: int, apart: int, slack: float) -> tuple[int, int, int, int] | None:
    """(words held, words changed, first word, end) of the best stretch of ``doc`` that holds ``item``'s words in order, or NULL.

    Runs of equal words are chained in the order of both texts. A step between runs of one piece costs the words
    changed in it; one step, short or long, of at most ``apart`` document words, may instead part two pieces. Both
    readings are kept for every run, the best chain of one piece and the best of two. The stretch counts if it
    spans ``least`` words of the item with at most ``slack`` of them (rounded up) changed and 7/8 of ``least`` left as they are."""
    runs = _runs(places)
    longest = max(n for _, _, n in runs)
    # per run: the best chain of one piece and the best of two, which may be missing
    best: list[list[tuple[float, int, int, tuple[int, int] | None] | None]] = []
    for k, (d, i, n) in enumerate(runs):
        # score, words in span, edits, previous (run, pieces - 1)
        top: list[tuple[float, int, int, tuple[int, int] | None] | None] = [(n, n, 0, None), None]
        for j in range(k - 1, -1, -1):
            pd_, pi, pn = runs[j]
            if d - pd_ > apart + longest:
                break  # runs are in document order: none before this one is near enough
            step_d, step_i = d - (pd_ + pn), i - (pi + pn)
            if step_d > apart:
                continue
            cut = max(0, -step_d, -step_i)
            if cut >= n or n - cut < 1:
                continue
            gd, gi = step_d + cut, step_i + cut
            one, two = best[j]
            steps = [(1, one, n - cut - 2, n - cut, 0, 0)]
            if gd <= 8 and gi <= 8:
                changed = max(gd, gi)
                if gd and gi:
                    same = sum(b.size for b in SequenceMatcher(None, doc[pd_ + pn:pd_ + pn + gd], item[pi + pn:pi + pn + gi], False).get_matching_blocks())
                    changed -= min(same, changed)
                gain = (n - cut) + (gi - changed if gi > changed else 0) - changed
                steps += [(0, one, gain, gi + n - cut, changed, 0), (1, two, gain, gi + n - cut, changed, 1)]
            for pieces, before, gain, span, edits, kind in steps:
                if before is not None and (top[pieces] is None or before[0] + gain > top[pieces][0]):
                    top[pieces] = (before[0] + gain, before[1] + span, before[2] + edits, (j, kind))
        best.append(top)
    good = None
    for k, states in enumerate(best):
        for kind, state in enumerate(states):
            if state is None:
                continue
            score, span, edits, back = state
            if span >= least and span - edits >= least * 7 / 8 and edits <= math.ceil(slack * span) and (good is None or score > good[0]):
                first = k
                while back is not None:
                    first, at = back
                    back = best[first][at][3]
                good = (score, span - edits, edits, runs[first][0], runs[k][0] + runs[k][2])
    return good[1:] if good else None


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items in blocks of at most BLOCK_WORDS words (one longer item is a block of its own); one block is held at a time."""
    block: list[tuple[int, list[bytes]]] = []
    size = 0
    for r in items.select(item_id, item_text).where(F.col(item_id).isNotNull()).distinct().orderBy(item_id).toLocalIterator():
        words = plain_words(r[1] or "")
        if len(words) < GRAM:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((int(r[0]), words))
        size += len(words)
    yield block


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 24,
          apart: int = 40, slack: float = SLACK, seeds: int = 5) -> DataFrame:
    """Columns doc_id, item_id, words, changed, first_word, end_word: items of which a document holds at least ``least`` words.

    The item's words must stand in its order, in one piece or two that are at most ``apart`` words from each other, with
    at most ``slack`` of them (rounded up) dropped, added, swapped or replaced. ``seeds`` is the number of distinct item windows that
    makes a stretch worth verifying. NULL, blank and too short texts or items give no rows; a document or item delivered
    twice gives its rows once. Documents are never shuffled. Every task holds at most BLOCK_WORDS words of items; if there
    are more, the documents are read once per block and each block's rows are written before the next one is sent.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, words int, changed int, first_word int, end_word int"

    def scanner(block):
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = ItemIndex(block.value)
            for batch in (c for b in batches for c in chunks(b)):
                docs = [plain_words(t) if t else [] for t in batch["text"]]
                ids = batch["doc_id"].tolist()
                rows = []
                for n, found in index.hits(docs).items():
                    if len(found) < seeds:
                        continue
                    by_item: dict[int, list[tuple[int, int]]] = {}
                    for p, c in found:
                        for item, i in index.places[c]:
                            by_item.setdefault(item, []).append((p, i))
                    for item, places in by_item.items():
                        if len({i for _, i in places}) >= seeds:
                            hit = verify(docs[n], index.items[item], places, least, apart, slack)
                            if hit:
                                rows.append((ids[n], item, *hit))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "changed", "first_word", "end_word"])
        return scan

    source = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    blocks = _blocks(items, item_id, item_text)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        out = source.mapInPandas(scanner(spark.sparkContext.broadcast(block)), schema)
    else:
        tmp, out = Scratch(spark), None
        while block is not None:
            held = spark.sparkContext.broadcast(block)
            part = tmp.keep(source.mapInPandas(scanner(held), schema))
            held.destroy()
            out = part if out is None else out.unionByName(part)
            block, following = following, next(blocks, None)
    best = F.max_by(F.struct("words", "changed", "first_word", "end_word"), F.struct("words", -F.col("changed"), -F.col("first_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.words", "b.changed", "b.first_word", "b.end_word")


def without_leaks(documents: DataFrame, doc_id: str, found: DataFrame) -> DataFrame:
    """The documents that hold no leaked item (a document with a NULL id is kept)."""
    bad = found.select(F.col("doc_id").alias("__leaked")).distinct()
    return documents.join(bad, F.col(doc_id) == F.col("__leaked"), "left_anti")
