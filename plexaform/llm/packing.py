"""Texts packed into containers of fixed token capacity.

Each text is counted in tokens of a public tokenizer once; only (id, tokens) is moved. Items are dealt into shards of a
bounded number of items and every shard is packed in one task, so no task holds more than a shard and at most one partly
filled container per shard is lost against a global packing.

Within a shard packing goes by rounds. A round opens a share of the sequences that its items need at least; items go, longest
first, to the sequence with the lowest estimated cost (tokens + tokens^2 / capacity of each item in it, the linear and the
attention part) that still has room, and items that find none go to the next round. Opening all sequences at once would
leave most of them with a gap that no remaining item fits; with half of them the short items are there to fill the gaps.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Items (texts or rests of cut texts) in one shard.
SHARD_ITEMS = 20_000
#: Share of the sequences needed at least that a round opens.
OPENED = 0.5


def bpe_counter(vocabulary: str, pattern: str):
    """Token counts by a byte-level BPE given as a ranks file; each worker reads the file once."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


_COUNTERS: dict[tuple[str, str], object] = {}


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str) -> DataFrame:
    """Columns id, tokens of every row; NULL and empty texts have 0 tokens."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # executors reuse their Python workers, so the vocabulary is read once per worker
        from plexaform.llm import packing

        key = (vocabulary, pattern)
        if key not in packing._COUNTERS:
            packing._COUNTERS[key] = packing.bpe_counter(*key)
        size = packing._COUNTERS[key]
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "tokens": [size(t) if t else 0 for t in batch["text"]]})

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(count, "id bigint, tokens bigint")


def fill(sizes: list[int], bins: int, capacity: int, separator: int) -> tuple[list[int], list[int]]:
    """One round over ``sizes`` (descending): the sequence of each item, -1 for none, and the numbers of items left over.

    Sequences with room for the current item wait in a heap by cost; those without wait by room until an item fits."""
    cost, room = [0.0] * bins, [capacity + separator] * bins
    ready = [(0.0, j) for j in range(bins)]
    waiting: list[tuple[int, int]] = []
    where, left = [-1] * len(sizes), []
    for k, size in enumerate(sizes):
        need = size + separator
        while waiting and -waiting[0][0] >= need:
            _, j = heapq.heappop(waiting)
            heapq.heappush(ready, (cost[j], j))
        if not ready:
            left.append(k)
            continue
        _, j = heapq.heappop(ready)
        where[k] = j
        cost[j] += size + size * size / capacity
        room[j] -= need
        if room[j] >= need:
            heapq.heappush(ready, (cost[j], j))
        else:
            heapq.heappush(waiting, (-room[j], j))
    return where, left


def balanced(sizes: np.ndarray, capacity: int, separator: int) -> np.ndarray:
    """Container number of each item of ``sizes`` (descending, each at most ``capacity``), by rounds of lowest cost."""
    out = np.full(len(sizes), -1, np.int64)
    todo = np.arange(len(sizes))
    base = 0
    while len(todo):
        own = sizes[todo]
        least = max(1, -(-int(own.sum() + separator * len(own)) // (capacity + separator)))
        bins = max(1, math.ceil(least * OPENED))
        where, left = fill(own.tolist(), bins, capacity, separator)
        where = np.array(where, np.int64)
        out[todo[where >= 0]] = base + where[where >= 0]
        base += bins
        todo = todo[np.array(left, np.int64)]
    _, dense = np.unique(out, return_inverse=True)
    return dense


def pack_shard(ids: np.ndarray, tokens: np.ndarray, capacity: int, separator: int) -> pd.DataFrame:
    """Rows of one shard: id, piece, tokens, container (number within the shard), position, unused."""
    full = np.where(tokens > capacity, tokens // capacity, 0)
    rest = tokens - full * capacity
    # a text that fills whole containers exactly leaves no rest
    keep = (rest > 0) | (full == 0)
    order = np.lexsort((ids[keep], -rest[keep]))
    item_ids, item_piece, sizes = ids[keep][order], full[keep][order], rest[keep][order]
    where = balanced(sizes, capacity, separator)
    used = int(where.max()) + 1 if len(where) else 0
    by = np.argsort(where, kind="stable")
    first = np.r_[True, where[by][1:] != where[by][:-1]] if len(by) else np.zeros(0, bool)
    position = np.empty(len(by), np.int64)
    position[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    # separators stand between the texts of a container
    filled = np.bincount(where, weights=sizes + separator, minlength=used).astype(np.int64) - separator
    parts = [pd.DataFrame({"id": item_ids, "piece": item_piece, "tokens": sizes, "container": where, "position": position, "unused": capacity - filled[where]})]
    cut = np.flatnonzero(full)
    if len(cut):
        pieces = full[cut]
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        parts.append(pd.DataFrame({"id": np.repeat(ids[cut], pieces), "piece": piece, "tokens": capacity, "container": used + np.arange(pieces.sum()), "position": 0, "unused": 0}))
    return pd.concat(parts, ignore_index=True)


def pack(counts: DataFrame, windows: list[tuple[str, int, int]], shard_items: int = SHARD_ITEMS) -> DataFrame:
    """counts: id, tokens -> window, shard, container, position, id, piece, tokens, unused.

    ``windows``: (name, capacity, separator tokens). A container is named by (window, shard, container). A text longer
    than the capacity is cut into full pieces, each alone in a container, and a rest; other texts are never cut. Every
    delivered row is an item, also repeated ones; a text of 0 tokens takes a place like any other; a row without id can't be
    told where it went and is left out. A capacity below 1
    is an error. An empty table gives no rows.
    """
    if any(c < 1 or s < 0 for _, c, s in windows):
        raise ValueError("capacities must be positive and separators not negative")
    tmp = Scratch(counts.sparkSession)
    kept = tmp.keep(counts)
    shards = max(1, -(-kept.count() // shard_items))
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, capacity, separator in windows:
            rows = pack_shard(pdf["id"].to_numpy(np.int64), pdf["tokens"].to_numpy(np.int64), capacity, separator)
            rows.insert(0, "shard", key[0])
            rows.insert(0, "window", name)
            out.append(rows)
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["window", "shard", "id", "piece", "tokens", "container", "position", "unused"])

    schema = "window string, shard int, id bigint, piece bigint, tokens bigint, container bigint, position bigint, unused bigint"
    # as many partitions as shards: the rows are few bytes, and without a number they would all come to one task
    return dealt.where("id is not null").repartition(shards, "shard").groupBy("shard").applyInPandas(run, schema)
