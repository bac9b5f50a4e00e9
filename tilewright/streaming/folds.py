"""Structured Streaming twins of the item fold and of the monthly meter."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tilewright.operators.jobs import KINDS, TERMINAL
from tilewright.operators.ledger import MAX_SPEND, meter_limit

_ITEM_OUT = "item long, state string, done long, total long, device string, n_events int, n_late long"
_ITEM_STATE = "state string, done long, total long, device string, n_events int, last_seq long, n_late long, n_kept int"
#: Typed state with timers lives in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: So many of the newest events of an item are told from their repeats.
REMEMBERED = 1024


def _advance(state: tuple, kind: str, done: int, total: int, device: str) -> tuple:
    """One event on (state, done, total, device, n_events) of an item that is not terminal."""
    name, at, whole, dev, n = state
    if kind == "started" and name == "waiting":
        name = "processing"
    elif kind == "device":
        dev = device
    elif kind == "progress" and done >= at:
        at, whole = done, total
    elif kind == "saving" and whole > 0:
        at = whole
    elif kind in TERMINAL:
        name, at = kind, whole if kind == "completed" else at
    return name, at, whole, dev, n + 1


class ItemFold(StatefulProcessor):
    """One item's events, batch by batch. The newest seqs applied are kept, so that a repeat is told from an event that comes too late."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", _ITEM_STATE)
        self.applied = handle.getMapState("applied", "seq long", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        *state, last, late, kept = self.item.get() if self.item.exists() else ("waiting", 0, 0, None, 0, -1, 0, 0)
        state, newest = tuple(state), 0
        for r in sorted(rows, key=lambda r: r["seq"]):
            newest = max(newest, r["ms"] or 0)
            if state[0] in TERMINAL:
                continue
            if r["seq"] > last:
                state, last = _advance(state, r["kind"], r["done"], r["total"], r["device"]), r["seq"]
            elif self.applied.containsKey((r["seq"],)):
                continue
            else:
                late += 1
            self.applied.updateValue((r["seq"],), (r["ms"] or 0,))
            kept += 1
        if state[0] in TERMINAL:
            self.applied.clear()  # nothing changes it any more
            kept = 0
        elif kept > 2 * REMEMBERED:
            known = sorted(k[0] for k in self.applied.keys())
            for seq in known[:-REMEMBERED]:
                self.applied.removeKey((seq,))
            kept = min(len(known), REMEMBERED)
        self.item.update((*state, last, late, kept))
        if self.keep_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
        yield Row(item=key[0], state=state[0], done=state[1], total=state[2], device=state[3], n_events=state[4], n_late=late)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.item.clear()
        self.applied.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_items(events: DataFrame, lateness: str = "1 hour", keep_s: int = 86_400) -> DataFrame:
    """A stream of (item, seq, kind, done, total, device and, perhaps, ts) as updates of each item's state.

    An item's events must come in order of seq from batch to batch, as a queue of one worker sends
    them; within a batch any order does. An event whose seq lies below one applied in an earlier batch
    comes too late: it changes nothing and is counted in n_late, once, while a repeat of an event (of
    the newest REMEMBERED) is neither applied nor counted. After an item's end nothing changes it.

    With ts, `lateness` sets the watermark, and an item that has been silent for keep_s seconds of event
    time, ended or not, leaves the state; an event of it after that begins it anew. Without ts, items
    stay. The state is in RocksDB, which this sets for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = events.filter(F.col("kind").isin(*KINDS))
    timed = "ts" in events.columns
    rows = known.select("item", "seq", "kind", "done", "total", "device", *(["ts"] if timed else []), (F.unix_millis(F.col("ts").cast("timestamp")) if timed else F.lit(None).cast("long")).alias("ms"))
    rows = rows.withWatermark("ts", lateness) if timed else rows
    return rows.groupBy("item").transformWithState(ItemFold(keep_s * 1000 if timed else None), _ITEM_OUT, "update", "eventTime" if timed else "none")


def latest_items(updates: DataFrame) -> DataFrame:
    """The last update of each item (n_events and n_late only grow)."""
    return updates.groupBy("item").agg(F.max_by(F.struct("state", "done", "total", "device", "n_events", "n_late"), F.struct("n_events", "n_late")).alias("s")).select("item", "s.*")


def stream_meter(spends: DataFrame, lateness: str = "1 day") -> DataFrame:
    """A stream of (meter, ts, n) as used and remaining by meter and calendar month.

    The event time is the end of a spend's month, and it is a key, so the watermark reaches the state:
    once a later month has been seen, whose end lies more than `lateness` (a day at least) beyond the
    old one's, the old month's state goes and its spends are forgiven, neither counted nor charged to
    another month. The watermark moves between batches, so a spend in the batch right after the one
    that opened the later month may still count.
    """
    end = F.add_months(F.trunc("ts", "month"), 1).cast("timestamp")
    timed = spends.filter(F.col("n").between(1, MAX_SPEND)).withColumn("month_end", end).withWatermark("month_end", lateness)
    used = timed.groupBy("meter", "month_end").agg(F.sum("n").alias("used"))
    lim = meter_limit(F.col("meter"))
    month = F.date_format(F.add_months("month_end", -1), "yyyy-MM")
    return used.select("meter", month.alias("month"), "used", F.greatest(lim - F.col("used"), F.lit(0)).cast("long").alias("remaining"))
