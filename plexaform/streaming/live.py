"""Structured Streaming forms of the keyed folds: rate limiter, running counters, order book, dedup by sequence.

Ordering is by explicit sequence: a row whose sequence isn't above the last of its key is rejected without a change of
state, also across micro-batches. State per key is bounded (a counter, a book of 64 levels a side)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.market import DECISIONS, Book, decide


def running_counter(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the number of rows and the sum so far (complete or update mode)."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total"))


def rate_buckets(stream: DataFrame, key: str, at: str, width: str, limit: int, delay: str) -> DataFrame:
    """Per key and tumbling bucket: requests, how many were allowed, what is left. Rows later than ``delay`` are dropped."""
    w = stream.withWatermark(at, delay).groupBy(key, F.window(at, width).alias("bucket"))
    n = F.count(F.lit(1))
    return w.agg(n.alias("requests"), F.least(n, F.lit(limit)).alias("allowed"), F.greatest(F.lit(0), F.lit(limit) - n).alias("remaining"))


def increasing(stream: DataFrame, key: str, sequence: str, columns: list[str]) -> DataFrame:
    """Rows whose sequence is above every earlier one of their key; state is one number per key."""
    kept = stream.select(key, sequence, *columns)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -(2**63)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(sequence, kind="stable")
        pdf = pdf[(pdf[sequence] > last) & ~pdf[sequence].duplicated()]
        if len(pdf):
            state.update((int(pdf[sequence].iloc[-1]),))
        yield pdf

    return kept.groupBy(key).applyInPandasWithState(run, kept.schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


def live_pipeline(stream: DataFrame, max_position: int, max_order: int) -> DataFrame:
    """The order-book pipeline over a stream of key, position, kind, side, price_ticks, quantity, sequence."""
    state_schema = "bids array<bigint>, asks array<bigint>, messages bigint, sequence bigint, reserved bigint, price double, spread bigint"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = Book(max_position, max_order)
        if state.exists:
            bids, asks, book.messages, book.sequence, book.reserved, book.price, book.spread = state.get
            book.quantities = [list(bids), list(asks)]
            book.live = [sum(1 << i for i, q in enumerate(side) if q) for side in book.quantities]
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("position", kind="stable")
        out = decide(pdf, book)
        state.update((*book.quantities, book.messages, int(book.sequence), int(book.reserved), book.price, int(book.spread)))
        yield out

    return stream.groupBy("key").applyInPandasWithState(run, DECISIONS, state_schema, "append", GroupStateTimeout.NoTimeout)
