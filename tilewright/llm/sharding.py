"""Sharding by best-fit-decreasing bin packing.

Documents of equal text form an indivisible group. Groups enter, largest first, the shard whose
remaining capacity is the tightest that still holds them; remaining capacities sit in a balanced
search tree. The packing runs over a histogram (size class, number of groups): groups of one size
are interchangeable, so a class is placed in runs and the plan is a table of runs, bounded by the
number of size classes however many documents there are. Spark does the rest: group sums, ranks
inside a class, the join of ranks with runs, and the slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import materialize, salted_rank, text_or_empty

N_SHARDS = 24
#: Sizes up to this are classes of their own; larger ones are rounded up by less than 1/256, which bounds the histogram.
EXACT_BELOW = 1 << 16
#: A group of more than this part of all rows is placed by a broadcast, so that it needs no task of its own.
LARGE_GROUPS = 256


class CapacityTree:
    """A treap of (remaining capacity, bin): the tightest bin that holds a size is found in O(log n)."""

    def __init__(self) -> None:
        self._root: list | None = None

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        x = (key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
        return x ^ x >> 29

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, room: int, bin_id: int) -> None:
        key = (room, bin_id)
        low, high = self._split(self._root, key)
        self._root = self._join(self._join(low, [key, self._priority(key), None, None]), high)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least room of at least size."""
        low, high = self._split(self._root, (size, -1))
        if high is None:
            self._root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self._root = self._join(low, rest)
        return node[0]


def best_fit_decreasing(classes: list[tuple[int, int]], n_bins: int, capacity: int) -> list[tuple[int, int, int, int]] | None:
    """classes: (size, count), any order. Runs (size, first rank, last rank, bin), or None if they don't fit.

    Items of one size go to one bin until it is full: after an item is placed, that bin is the
    tightest one that can hold the next, so a run is exactly what item by item placing gives.
    """
    tree = CapacityTree()
    for b in range(n_bins):
        tree.add(capacity, b)
    runs = []
    for size, count in sorted(classes, reverse=True):
        rank = 0
        while rank < count:
            found = tree.pop_tightest(size)
            if found is None:
                return None
            room, b = found
            n = min(count - rank, room // size)
            runs.append((size, rank, rank + n - 1, b))
            tree.add(room - n * size, b)
            rank += n
    return runs


def pack_into(classes: list[tuple[int, int]], n_bins: int) -> list[tuple[int, int, int, int]]:
    """The runs for the smallest capacity, from the mean upwards, that fits n_bins bins."""
    if not classes:
        return []
    total, largest = sum(s * n for s, n in classes), max(s for s, _ in classes)
    low = max(-(-total // n_bins), largest)
    if runs := best_fit_decreasing(classes, n_bins, low):
        return runs
    step = 1
    while not (runs := best_fit_decreasing(classes, n_bins, low + step)):
        step *= 2
    good, bad = step, step // 2
    while good - bad > 1:
        mid = (good + bad) // 2
        if r := best_fit_decreasing(classes, n_bins, low + mid):
            good, runs = mid, r
        else:
            bad = mid
    return runs


def _class_of(size: str) -> str:
    step = f"greatest(shiftright({EXACT_BELOW}, 8), shiftright(cast(pow(2, floor(log2({size}))) as bigint), 8))"
    return f"if({size} <= {EXACT_BELOW}, {size}, cast(ceil({size} / {step}) as bigint) * {step})"


def shard(docs: DataFrame, n_shards: int = N_SHARDS, rows_per_salt: int = 100_000) -> DataFrame:
    """Every row with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: shard sizes are near equal and equal texts share a shard. Only a group of copies
    that exceeds a shard's mean size is split, into pieces of that size (a third of all rows fits no
    shard); rows repeated under one doc_id are rows of their own. Groups above EXACT_BELOW bytes are
    packed by sizes rounded up by less than 1/256, which bounds the plan however many sizes occur, so
    shards may differ by that part of what such groups weigh; sizes in the result are exact. Null text counts as empty (size 8,
    checksum 0). An empty table gives an empty result. Slots number the rows of a shard from 0.
    """
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text_or_empty()) + 8).cast("long").alias("size"),
            F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
            F.sha2(text_or_empty(), 256).alias("_key"),
            F.monotonically_increasing_id().alias("_rid"),
        ),
        "rows",
    )
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_salts = max(16, n_rows // rows_per_salt)
    piece = max(1, total // n_shards)
    copies = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max("size").alias("_each"))
    # groups beyond a shard, and those of very many rows, which stay whole but are dealt by other keys than their own
    large = materialize(copies.filter((F.col("_n") * F.col("_each") > piece) | (F.col("_n") > max(n_rows // LARGE_GROUPS, 1))).select("_key", F.greatest(F.lit(1), F.lit(piece).cast("long") / F.col("_each")).cast("long").alias("_per")), "large")
    if large.isEmpty():
        pieces = rows.withColumn("_piece", F.lit(0).cast("long")).withColumn("_large", F.lit(False))
    else:
        tagged = rows.join(F.broadcast(large), "_key", "left")  # at most LARGE_GROUPS + n_shards rows
        ranked = salted_rank(tagged.filter("_per is not null"), ["_key"], ["_rid"], n_salts, "_rank")
        pieces = tagged.filter("_per is null").withColumn("_piece", F.lit(0).cast("long")).withColumn("_large", F.lit(False)).drop("_per").unionByName(ranked.withColumn("_piece", F.expr("_rank div _per")).withColumn("_large", F.lit(True)).drop("_per", "_rank"))
        pieces = materialize(pieces, "pieces")
    groups = pieces.groupBy("_key", "_piece", "_large").agg(F.sum("size").alias("_bytes")).withColumn("_class", F.expr(_class_of("_bytes")))
    groups = materialize(groups, "groups")
    classes = [(r[0], r[1]) for r in groups.groupBy("_class").count().collect()]  # bounded: EXACT_BELOW + 256 a doubling
    runs = pack_into(classes, n_shards)
    spark = docs.sparkSession
    plan = spark.createDataFrame(runs, "_class long, _first long, _last long, shard int") if runs else spark.createDataFrame([], "_class long, _first long, _last long, shard int")
    ranked = salted_rank(groups, ["_class"], ["_key", "_piece"], n_salts, "_rank")
    placed = ranked.join(F.broadcast(plan), (ranked["_class"] == plan["_class"]) & F.col("_rank").between(F.col("_first"), F.col("_last"))).select("_key", "_piece", "_large", "shard")
    cols = ["doc_id", "size", "text_crc32", "shard", "_rid"]
    few = pieces.filter("_large").join(F.broadcast(placed.filter("_large")), ["_key", "_piece"]).select(*cols)  # a few rows for each large group
    out = materialize(pieces.filter("not _large").join(placed.filter("not _large"), ["_key", "_piece"]).select(*cols).union(few), "placed")
    out = salted_rank(out, ["shard"], ["_rid"], n_salts, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
