"""Order-book event stream: codecs, book update, risk gate, features, and the keyed fold that joins them.

The risk gate depends on what it accepted before, so it is a fold per key in sequence order; keys (instruments) are
independent and run in parallel. A key's events are read in batches, so only its book (64 levels a side) is held."""

from __future__ import annotations

import struct
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values of the wire format: big-endian type, side, price in ticks, quantity, sequence
MESSAGE = ">BBiiQ"
LEVELS, BASE_TICK = 64, 100_000
ADD, CANCEL_TYPES = 1, (2, 3)


def encode_event(kind: Column, side: Column, price: Column, quantity: Column, sequence: Column) -> Column:
    """18 bytes; negative 32-bit values in two's complement."""
    i32 = lambda v: F.lpad(F.hex(v.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(F.lpad(F.hex(kind.cast("bigint")), 2, "0"), F.lpad(F.hex(side.cast("bigint")), 2, "0"), i32(price), i32(quantity), F.lpad(F.hex(sequence.cast("bigint")), 16, "0")))


def _unsigned(h: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(h, start, digits), 16, 10).cast("decimal(20,0)")


def decode_event(raw: Column) -> Column:
    """struct kind, side, price_ticks, quantity, sequence; NULL for a message that is not 18 bytes long."""
    h = F.hex(raw)
    signed = lambda s: F.when(_unsigned(h, s, 8) >= 2**31, _unsigned(h, s, 8) - 2**32).otherwise(_unsigned(h, s, 8)).cast("int")
    return F.when(F.octet_length(raw) == 18, F.struct(
        _unsigned(h, 1, 2).cast("int").alias("kind"), _unsigned(h, 3, 2).cast("int").alias("side"), signed(5).alias("price_ticks"), signed(13).alias("quantity"),
        _unsigned(h, 21, 16).cast("decimal(20,0)").alias("sequence")))


def valid_events(events: DataFrame, key: str) -> DataFrame:
    """The events that change a book: known tag and side, a level, no negative quantity, a sequence above every valid one before.

    events: key, position, kind, side, price_ticks, quantity, sequence; NULL fields make an event invalid. Whether a sequence is
    above the earlier ones is a running maximum, as a rejected sequence never raises it."""
    fine = F.coalesce(F.col("kind").isin(1, 2, 3) & F.col("side").isin(0, 1) & (F.col("price_ticks") - BASE_TICK).between(0, LEVELS - 1) & (F.col("quantity") >= 0), F.lit(False))
    before = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("__fine", fine).withColumn("__high", F.max(F.when(F.col("__fine"), F.col("sequence"))).over(before))
    return seen.where(F.col("__fine") & (F.col("sequence") > F.coalesce("__high", F.lit(0)))).drop("__fine", "__high")


def book_state(events: DataFrame, key: str) -> DataFrame:
    """Best bid and ask level after all valid events, as a batch: the last quantity per side and level, then the outer levels.

    events: key, kind, side, level, quantity, sequence (valid ones: unique and increasing per key)."""
    last = events.groupBy(key, "side", "level").agg(F.max_by(F.when(F.col("kind") == 3, 0).otherwise(F.col("quantity")), "sequence").alias("q"))
    live = last.where("q > 0")
    return live.groupBy(key).agg(F.max(F.when(F.col("side") == 0, F.col("level"))).alias("best_bid"), F.min(F.when(F.col("side") == 1, F.col("level"))).alias("best_ask"))


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """What a ring of capacity ``n`` (a power of two, at least 2) that drops its oldest holds at the end."""
    if n < 2 or n & (n - 1):
        raise ValueError("capacity must be a power of two, at least 2")
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


class Book:
    """State of one key: quantities of two sides of 64 levels, what is held and reserved, the smoothed price and last spread.

    A word per side marks the levels that hold something, so the best level is its highest or lowest bit."""

    def __init__(self, max_position: int, max_order: int, position: int = 0, alpha: float = 0.125):
        self.quantities = [[0] * LEVELS, [0] * LEVELS]
        self.live = [0, 0]
        self.messages, self.sequence, self.position, self.reserved = 0, 0, position, 0
        self.price, self.spread = 0.0, 0
        self.max_position, self.max_order, self.alpha = max_position, max_order, alpha

    def apply(self, kind: int, side: int, price: int, quantity: int, sequence: int) -> int:
        """The changed level's mask, or -1 if the event is invalid; then nothing has changed."""
        level = price - BASE_TICK
        if kind not in (1, 2, 3) or side not in (0, 1) or not 0 <= level < LEVELS or quantity < 0 or sequence <= self.sequence:
            return -1
        mask = 1 << level
        held = 0 if kind == 3 else quantity
        self.sequence = sequence
        self.quantities[side][level] = held
        self.live[side] = self.live[side] | mask if held else self.live[side] & ~mask
        return mask

    def top(self) -> tuple[int, int, int, int]:
        """Price and quantity of the best bid and of the best ask; zeros for an empty side."""
        bids, asks = self.live
        bid, ask = bids.bit_length() - 1, (asks & -asks).bit_length() - 1
        return (*((BASE_TICK + bid, self.quantities[0][bid]) if bids else (0, 0)), *((BASE_TICK + ask, self.quantities[1][ask]) if asks else (0, 0)))

    def admit(self, side: int, quantity: int) -> int:
        """0 accepted (and reserved), 1 too large an order, 2 too large an exposure."""
        if quantity > self.max_order:
            return 1
        after = self.reserved + (quantity if side == 0 else -quantity)
        if abs(self.position + after) > self.max_position:
            return 2
        self.reserved = after
        return 0

    def admit_by_mask(self, side: int, quantity: int) -> int:
        """The same without branches, for comparison."""
        large = int(quantity > self.max_order)
        after = self.reserved + quantity * (1 - 2 * side)
        wide = int(abs(self.position + after) > self.max_position) * (1 - large)
        self.reserved += (1 - (large | wide)) * (after - self.reserved)
        return large + 2 * wide

    def smooth(self, bid: int, bid_quantity: int, ask: int, ask_quantity: int) -> tuple[float, int, bool]:
        """Smoothed price, spread and whether it changed; a one-sided book is priced at its side, an empty one at 0, spread 0."""
        if bid and ask:
            price, spread = (ask * bid_quantity + bid * ask_quantity) / (bid_quantity + ask_quantity), ask - bid
        else:
            price, spread = float(bid or ask), 0
        changed = spread != self.spread
        self.price += self.alpha * (price - self.price)
        self.spread = spread
        return self.price, spread, changed


DECISIONS = ("key bigint, position bigint, sequence bigint, status int, best_bid int, bid_quantity bigint, best_ask int, ask_quantity bigint, changed_mask decimal(20,0), accepted boolean, reason int, "
             "price double, spread int, spread_changed boolean, wire binary")
_NAMES = [field.split()[0] for field in DECISIONS.split(", ")]


def decide(rows: pd.DataFrame, book: Book, masked: bool = False) -> pd.DataFrame:
    """One decision per message of a key, in the order given. On the wire goes the number of the message, invalid ones counted."""
    gate, pack = book.admit_by_mask if masked else book.admit, struct.Struct(">QIBBi").pack
    out = []
    for key, position, kind, side, price, quantity, sequence in zip(*(rows[c].tolist() for c in ("key", "position", "kind", "side", "price_ticks", "quantity", "sequence"))):
        book.messages += 1
        mask = book.apply(kind, side, price, quantity, sequence)
        if mask < 0:
            out.append((key, position, sequence, -2, None, None, None, None, Decimal(0), False, 3, None, None, None, b""))
            continue
        top = book.top()
        reason = gate(side, quantity)
        wire = pack(book.messages, sequence & 0xFFFFFFFF, not reason, reason, quantity)
        out.append((key, position, sequence, 0, *top, Decimal(mask), not reason, reason, *book.smooth(*top), wire))
    return pd.DataFrame(out, columns=_NAMES)


def run_pipeline(events: DataFrame, max_position: int, max_order: int, position: int = 0, masked: bool = False) -> DataFrame:
    """events: key, position, kind, side, price_ticks, quantity, sequence -> one decision per event.

    An invalid event (unknown tag, side or level, negative quantity, sequence not above the last) has status -2 and
    reason 3, an empty wire, and changes no state. NULL fields make an event invalid. Events of a key are taken in ``position``
    order; ``position`` is also what is held at the start. The ring of the last wires is ``last_n`` of the valid decisions."""
    clean = events.na.fill(-1, ["kind", "side", "price_ticks", "quantity", "sequence"])

    def fold(batches):
        # rows come sorted by key and position; only the current key's book is held, however many rows the key has
        key, book = None, None
        for pdf in batches:
            for k, part in pdf.groupby("key", sort=False, dropna=False):
                if book is None or k != key:
                    key, book = k, Book(max_position, max_order, position)
                yield decide(part, book, masked)

    return clean.repartition("key").sortWithinPartitions("key", "position").mapInPandas(fold, DECISIONS)


def adversarial_trace(spark, count: int) -> DataFrame:
    """A deterministic stream that cycles through tags, sides and levels; sequences 1..count."""
    return spark.range(1, count + 1).selectExpr("CAST(id % 4 AS BIGINT) AS key", "id AS position", "CAST(id % 3 + 1 AS INT) AS kind", "CAST(id % 2 AS INT) AS side", f"CAST({BASE_TICK} + (id * 37) % {LEVELS} AS INT) AS price_ticks", "CAST((id * 13) % 50 AS INT) AS quantity", "id AS sequence")
