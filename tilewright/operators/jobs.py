"""Folds of job and batch events: pure aggregates where order allows, an ordered fold where it does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")
KINDS = ("started", "device", "progress", "saving", *TERMINAL)


def fold_items(items: DataFrame, events: DataFrame) -> DataFrame:
    """items (item), events (item, seq, kind, done, total, device): item, state, done, total, device, n_events.

    Events after the first terminal one, of unknown items and of unknown kinds change nothing; seq is
    unique in an item. Between two `saving` events the furthest progress is all that counts, with the
    last total told there; so an item's events, however many, combine on the map side to one row for
    each run between savings, and only those rows, one more than its savings, are folded in order.
    """
    known = events.filter(F.col("kind").isin(*KINDS))
    kind = F.col("kind")
    marks = known.groupBy("item").agg(
        F.min(F.when(kind.isin(*TERMINAL), F.struct("seq", "kind"))).alias("end"), F.sort_array(F.collect_list(F.when(kind == "saving", F.col("seq")))).alias("savings"),
    )
    before = known.join(marks, "item").filter("end is null or seq <= end.seq").withColumn("run", F.size(F.filter("savings", lambda s: s < F.col("seq"))))
    runs = before.groupBy("item", "run").agg(
        F.max(F.when((kind == "progress") & F.col("done").isNotNull(), F.struct("done", "seq", "total"))).alias("best"), F.max(F.when(kind == "device", F.struct("seq", "device"))).alias("device"),
        F.coalesce(F.bool_or(kind == "started"), F.lit(False)).alias("started"), F.coalesce(F.bool_or(kind == "saving"), F.lit(False)).alias("saved"), F.first("end.kind").alias("end"), F.count(F.lit(1)).alias("n"),
    )
    listed = runs.groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("run", "best", "saved"))).alias("runs"), F.max("device").alias("device"), F.bool_or("started").alias("started"), F.first("end").alias("end"), F.sum("n").alias("n_events"),
    )
    kind_of = "struct<done:bigint,total:bigint>"
    zero = F.lit(0).cast("long")

    def step(s: Column, r: Column) -> Column:
        ahead = F.coalesce(r["best"]["done"] >= s["done"], F.lit(False))
        done, total = F.when(ahead, r["best"]["done"]).otherwise(s["done"]), F.when(ahead, r["best"]["total"]).otherwise(s["total"])
        return F.struct(F.when(r["saved"] & (total > 0), total).otherwise(done).alias("done"), total.alias("total")).cast(kind_of)

    folded = items.join(listed, "item", "left").withColumn("s", F.aggregate(F.coalesce("runs", F.expr("array()")), F.struct(zero.alias("done"), zero.alias("total")).cast(kind_of), step))
    state = F.coalesce("end", F.when(F.col("started"), "processing"), F.lit("waiting"))
    done = F.when(F.col("end") == "completed", F.col("s.total")).otherwise(F.col("s.done"))
    return folded.select("item", state.alias("state"), done.alias("done"), F.col("s.total").alias("total"), F.col("device.device").alias("device"), F.coalesce("n_events", zero).cast("int").alias("n_events"))


def counters(items: DataFrame) -> DataFrame:
    """One row: done, failed (with cancelled), settled, retryable, running."""
    state = F.col("state")
    return items.agg(
        F.count_if(state == "completed").alias("n_done"),
        F.count_if(state.isin("failed", "cancelled")).alias("n_failed"),
        F.coalesce(F.bool_and(state.isin(*TERMINAL)), F.lit(True)).alias("settled"),
        F.coalesce(F.bool_or(state.isin("failed", "cancelled")), F.lit(False)).alias("retryable"),
        F.coalesce(F.bool_or(state.isin("waiting", "processing")), F.lit(False)).alias("running"),
    )


def retry(items: DataFrame) -> DataFrame:
    """Failed and cancelled items wait again, with nothing done."""
    again = F.col("state").isin("failed", "cancelled")
    reset = lambda c, v: F.when(again, v).otherwise(F.col(c)).alias(c)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    return items.select("item", reset("state", F.lit("waiting")), reset("done", zero), reset("total", zero), reset("device", none))


def sweep(items: DataFrame) -> DataFrame:
    """At the end of a queue: what waits or runs is cancelled."""
    return items.withColumn("state", F.when(F.col("state").isin("waiting", "processing"), "cancelled").otherwise(F.col("state")))


def history_rows(items: DataFrame) -> DataFrame:
    """Completed and failed items enter the history; failed ones without a size."""
    failed = F.col("state") == "failed"
    return items.filter(F.col("state").isin("completed", "failed")).select("item", F.col("state").alias("status"), F.when(failed, 0).otherwise(F.col("done")).cast("long").alias("size"))


def latest_snapshot(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """Events that count: those after the last snapshot (item, seq) of their item."""
    last = snapshots.groupBy("item").agg(F.max("seq").alias("_from"))
    return events.join(last, "item").filter(F.col("seq") > F.col("_from")).drop("_from")


def monotone_progress(events: DataFrame) -> DataFrame:
    """The count shown after each progress event: it never falls."""
    so_far = Window.partitionBy("item").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.filter("kind = 'progress'").withColumn("shown", F.max("done").over(so_far)).select("item", "seq", "done", "shown")


def fold_single_job(events: DataFrame) -> DataFrame:
    """events (job, seq, phase) of single jobs: the phase each ends in. Failed and cancelled stay; failed gives way to cancelled
    only. Plain aggregates, so a job with very many events combines before it is shuffled."""
    phase = F.col("phase")
    moving = F.max_by(F.when(phase.isin("processing", "completing", "completed"), phase), F.when(phase.isin("processing", "completing", "completed"), F.col("seq")))
    had = lambda p: F.bool_or(phase == p)
    return events.groupBy("job").agg(F.when(had("cancelled"), "cancelled").when(had("failed"), "failed").otherwise(F.coalesce(moving, F.lit("preparing"))).alias("phase"))


def next_waiting(queues: DataFrame) -> DataFrame:
    """queues (queue, ordinal, item, state, cancelling): the item each queue runs next; those cancelled while they waited never run."""
    ready = queues.filter((F.col("state") == "waiting") & ~F.col("cancelling"))
    return ready.groupBy("queue").agg(F.min_by("item", "ordinal").alias("item"), F.min("ordinal").alias("ordinal"))


def cancel(items: DataFrame, asked: DataFrame) -> DataFrame:
    """items (item, state, cancelling) after the wish to cancel asked (item): accepted tells whether it was still open. A waiting
    item is flagged and ends when it is picked; a running one stops at the next tile."""
    wished = items.join(asked.select("item").distinct().withColumn("_asked", F.lit(True)), "item", "left")
    accepted = F.coalesce(F.col("_asked"), F.lit(False)) & F.col("state").isin("waiting", "processing")
    return wished.select("item", "state", (F.col("cancelling") | accepted).alias("cancelling"), accepted.alias("accepted"))


def pick_up(items: DataFrame) -> DataFrame:
    """Waiting items that are flagged are cancelled."""
    flagged = F.col("cancelling") & (F.col("state") == "waiting")
    return items.withColumn("state", F.when(flagged, "cancelled").otherwise(F.col("state")))


def retry_check(items: DataFrame, remaining: Column) -> DataFrame:
    """One row: how many items a retry would put back, and whether the meter covers them."""
    n = F.count_if(F.col("state").isin("failed", "cancelled"))
    return items.agg(n.alias("n_retried"), ((n > 0) & (n <= remaining)).alias("allowed"))


#: Fixed value: items of one batch.
MAX_ITEMS = 500


def accept_batch(requests: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """requests (batch, item): a batch without items or with too many is refused as a whole."""
    return requests.groupBy("batch").agg(F.count("item").alias("n_items"), ((F.count("item") == 0) | (F.count("item") > max_items)).alias("refused"))


def tile_progress(tiles: DataFrame) -> DataFrame:
    """tiles (image, band, col): done and total after each, row by row. done follows from the place, so no window is needed.

    There are as many sizes as images, and they shrink so well in a shuffle that Spark would take them for small
    and gather them on the driver for a broadcast; so both sides are merged by image.
    """
    size = tiles.groupBy("image").agg((F.max("col") + 1).alias("cols"), F.count(F.lit(1)).alias("total"))
    return tiles.join(size.hint("merge"), "image").select("image", "band", "col", (F.col("band") * F.col("cols") + F.col("col") + 1).cast("long").alias("done"), "total")


def attempt_ladder(outcomes: Column, ceiling: Column, max_attempts: int = 3) -> Column:
    """outcomes: what each attempt would meet (ok, open_failed, oom, disk_full, failed, cancelled), prefix gpu first.

    A struct (result, attempts, device, ceiling): trouble on the GPU moves on to the CPU, each retry
    halves the tile ceiling upwards, and three attempts are all there are.
    """
    start = F.struct(F.lit("").alias("result"), F.lit(0).alias("attempts"), F.lit("gpu").alias("device"), ceiling.cast("int").alias("ceiling"))
    half = lambda c: F.floor((c + 1) / 2).cast("int")

    def step(s: Column, o: Column) -> Column:
        gpu = s["device"] == "gpu"
        again = (o == "oom") | ((o == "open_failed") & gpu)
        result = F.when(o == "ok", "done").when(o == "cancelled", "cancelled").when(o == "disk_full", "insufficient_disk").when((o == "open_failed") & ~gpu, "engine_unavailable").when(o == "failed", "failed").otherwise("")
        tried = F.struct(result.alias("result"), (s["attempts"] + 1).alias("attempts"), F.when(again, "cpu").otherwise(s["device"]).alias("device"), F.when(again, half(s["ceiling"])).otherwise(s["ceiling"]).alias("ceiling"))
        return F.when(s["result"] != "", s).otherwise(tried).cast("struct<result:string,attempts:int,device:string,ceiling:int>")

    end = F.aggregate(F.slice(outcomes, 1, max_attempts), start.cast("struct<result:string,attempts:int,device:string,ceiling:int>"), step)
    return F.transform(F.array(end), lambda s: F.struct(F.when(s["result"] == "", "insufficient_resources").otherwise(s["result"]).alias("result"), s["attempts"].alias("attempts"), s["device"].alias("device"), s["ceiling"].alias("ceiling")))[0]
