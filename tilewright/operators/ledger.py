"""Meters, orders, licence pools, journals and lists as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.ordered import after, applied, clamped, fold_in_order, written

#: Monthly allowances, the largest single spend, list caps.
INSTALL_LIMIT, NETWORK_LIMIT, NETWORK_PREFIX, MAX_SPEND = 10, 30, "iph", 1000
JOURNAL_CAP, RECENTS_CAP = 200, 12
ORDER_STATES = ("pending", "paid", "fulfilled", "canceled", "refunded")


# --- meters ----------------------------------------------------------------------------------------


def meter_limit(meter: Column) -> Column:
    return F.when(meter.startswith(NETWORK_PREFIX), NETWORK_LIMIT).otherwise(INSTALL_LIMIT)


def month_usage(spends: DataFrame) -> DataFrame:
    """spends (meter, month, n): used by meter and month. Spends outside 1..1000 are refused, an overspend is not."""
    return spends.filter(F.col("n").between(1, MAX_SPEND)).groupBy("meter", "month").agg(F.sum("n").alias("used"))


def meter_state(spends: DataFrame) -> DataFrame:
    """The latest month of each meter: used, remaining, limit."""
    latest = month_usage(spends).groupBy("meter").agg(F.max(F.struct("month", "used")).alias("s")).select("meter", "s.*")
    lim = meter_limit(F.col("meter"))
    return latest.select("meter", "month", "used", F.greatest(lim - F.col("used"), F.lit(0)).alias("remaining"), lim.alias("limit"))


def peek(meters: DataFrame, spends: DataFrame, month: str) -> DataFrame:
    """Every meter at a month: a meter without a row of that month has its whole allowance."""
    state = meter_state(spends).filter(F.col("month") == month).select("meter", "used", "remaining")
    lim = meter_limit(F.col("meter"))
    return meters.join(state, "meter", "left").select("meter", F.lit(month).alias("month"), F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("remaining", lim).alias("remaining"), lim.alias("limit"))


def two_meter_verdict(installs: DataFrame, networks: DataFrame) -> DataFrame:
    """installs (install, network, remaining) against networks (network, network_remaining); an unknown network does not refuse."""
    both = installs.join(networks, "network", "left")
    ok = (F.col("remaining") > 0) & (F.col("network_remaining").isNull() | (F.col("network_remaining") > 0))
    return both.select("install", "network", "remaining", "network_remaining", ok.alias("allowed"))


def remaining_of(limit: Column, used: Column, pending: Column) -> Column:
    return F.greatest(F.lit(0), limit - (used + pending))


def settle(cache_period: Column, used: Column, pending: Column, reply_period: Column, reply_used: Column, limit: Column) -> dict[str, Column]:
    """A cached meter after a read: a month that closed forgives what was pending."""
    left = F.when(cache_period == reply_period, pending).otherwise(0)
    now = F.least(reply_used, limit)
    return {"pending": left, "used": now, "remaining": remaining_of(limit, now, left)}


def _owed_step(event_kind: Column, n: Column, month: Column, limit: Column) -> Column:
    """What an event does to what is owed: a step before the run's first known month, that month and whether a read
    told it, the last month, and the step after. An add stops at the limit, an ack at 0."""
    n = F.greatest(n, F.lit(0)).cast("long")
    told = F.when(event_kind.isin("read", "ack"), month)
    move = lambda on: F.when(on & (event_kind == "add"), clamped(n, 0, limit)).when(on & (event_kind == "ack"), clamped(-n, 0, limit)).otherwise(clamped(0))
    reads = F.coalesce(event_kind == "read", F.lit(False))
    return F.struct(move(told.isNull()).alias("before"), told.alias("first"), reads.alias("reads"), told.alias("last"), move(told.isNotNull()).alias("since"))


def _owed_then(a: Column, b: Column) -> Column:
    """Two runs of events, one after the other: a read of another month than the last one known forgives what was owed."""
    none_a, none_b = a["first"].isNull(), b["first"].isNull()
    closes = b["reads"] & (b["first"] != a["last"])
    met = after(a["since"], b["before"])
    since = F.when(none_a, b["since"]).when(none_b, met).otherwise(after(F.when(closes, clamped(0, 0, 0)).otherwise(met), b["since"]))
    before = F.when(none_a, after(a["before"], b["before"])).otherwise(a["before"])
    return F.struct(before.alias("before"), F.coalesce(a["first"], b["first"]).alias("first"), F.when(none_a, b["reads"]).otherwise(a["reads"]).alias("reads"), F.coalesce(b["last"], a["last"]).alias("last"), since.alias("since"))


def owed(events: DataFrame) -> DataFrame:
    """events (meter, seq, month, kind, n): what each meter still owes after add (n more), ack (n were posted) and read (of a month).

    What is owed never passes the limit, at any add, nor falls below 0 at any ack; adds while a post is
    under way stay owed; a read of another month than the last one known (by a read or an ack) forgives
    what was owed before it. Events of other kinds and of a null month tell no month. The steps compose,
    so a meter with a third of all events is folded by runs.
    """
    step = _owed_step(F.col("kind"), F.coalesce("n", F.lit(0)), F.col("month"), meter_limit(F.col("meter")))
    whole = fold_in_order(events, "meter", "seq", step, _owed_then)
    run = F.col("value")
    return whole.select("meter", applied(run["since"], applied(run["before"], F.lit(0).cast("long"))).alias("owed"))


def read_reply(status: Column, body: Column) -> dict[str, Column]:
    """A meter's reply as columns: anything but a good 200 is meter_unreachable, never a verdict. used is at most the limit,
    allowed defaults to what remains, and a reply without a clock still counts as synced at 1."""
    at = lambda k, t: F.get_json_object(body, f"$.{k}").try_cast(t)
    period, lim, used, left = F.get_json_object(body, "$.period"), at("limit", "long"), at("used", "long"), at("remaining", "long")
    ok = F.coalesce((status == 200) & client_period(period) & lim.isNotNull() & used.isNotNull() & left.isNotNull(), F.lit(False))
    keep = lambda c: F.when(ok, c)
    return {
        "error": F.when(~ok, "meter_unreachable"), "period": keep(period), "limit": keep(lim), "used": keep(F.least(used, lim)), "allowed": keep(F.coalesce(at("allowed", "boolean"), left > 0)),
        "synced_at": keep(F.greatest(F.lit(1), F.coalesce(at("server_time", "long"), F.lit(0)))),
    }


def relay_charge(items: DataFrame) -> DataFrame:
    """items (meter, state): one credit for each completed one."""
    return items.groupBy("meter").agg(F.count_if(F.col("state") == "completed").alias("credits"))


def meter_id(raw: Column) -> Column:
    """A meter's id as it is stored, or null (fixed value: its pattern)."""
    clean = F.lower(F.trim(raw))
    return F.when(clean.rlike("^[a-z0-9]{8,64}$"), clean)


def server_period(period: Column) -> Column:
    return F.coalesce(period.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), F.lit(False))


def client_period(period: Column) -> Column:
    """The looser rule of a client: digits and a dash in their places."""
    return F.coalesce(period.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.lit(False))


def spend_request_error(body: Column) -> Column:
    """The first fault of a spend request, or null: 1 to 2048 characters of JSON with a meter id (a string) and a count (a number) whose whole part is 1 to 1000.

    JSON that is no record, an array or a number or null, has no meter id.
    """
    parsed = F.try_parse_json(body)
    record = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
    field = lambda k, kinds, to: F.when(F.schema_of_variant(F.try_variant_get(record, f"$.{k}", "variant")).rlike(kinds), F.try_variant_get(record, f"$.{k}", to))
    count = field("count", "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "double")
    whole = F.when(count >= 0, F.floor(count)).otherwise(F.ceil(count))
    return (
        F.when(body.isNull() | (F.length(body) == 0) | (F.length(body) > 2048), "invalid body").when(parsed.isNull(), "invalid json")
        .when(meter_id(field("install_id", "^STRING", "string")).isNull(), "unknown install id").when(count.isNull() | (whole < 1) | (whole > MAX_SPEND), "count must be an integer from 1 to 1000")
    )


def check_decision(synced: Column, allowed: Column, remaining: Column, limit: Column, reply_ok: Column, reply_allowed: Column, reply_remaining: Column, n: Column) -> Column:
    """ok, quota_exceeded or meter_unreachable for a request of n, from the cache and, if that does not do, one reply."""
    covered = synced & allowed & (n <= remaining)
    after = F.when(reply_ok, reply_allowed & (n <= reply_remaining)).otherwise(covered)
    return F.when(covered, "ok").when(synced & (n > limit), "quota_exceeded").when(~reply_ok & ~synced, "meter_unreachable").when(after, "ok").otherwise("quota_exceeded")


# --- orders and pools ------------------------------------------------------------------------------


def rank_in_order(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """1-based rank in `order` inside a group, without a window over a whole group.

    Rows are dealt by ranges of group and order, however many one group or one day has, written, and
    numbered inside each range; the counts of the ranges before, a row for each range and group, are
    added. `order` is unique in a group.
    """
    dealt = df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    ranked = written(dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part", group).orderBy(*order))), "ranks")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    shift = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_g").eqNullSafe(F.col(group)) & (F.col("_p") == F.col("_part"))
    return ranked.join(shift, same).withColumn(out, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before", "_g", "_p")


def claim_keys(orders: DataFrame, pool: DataFrame) -> DataFrame:
    """orders (order_id, edition, paid_at) and pool (key, edition, issued_at): the oldest free key of the edition to the oldest
    order, one each; orders beyond the pool get null. Both sides are ranked by ranges, so no edition and no busy day meets in one
    task, and no lock is needed."""
    o = rank_in_order(orders, "edition", ["paid_at", "order_id"], "_rank")
    p = rank_in_order(pool, "edition", ["issued_at", "key"], "_rank")
    return o.join(p.select("edition", "_rank", "key"), ["edition", "_rank"], "left").select("order_id", "edition", "paid_at", "key")


def upsert(current: DataFrame, supplied: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Rows of supplied overwrite, column by column, what they supply; a default counts as supplied."""
    cols = [c for c in current.columns if c != key]
    full = supplied.withColumns({c: F.coalesce(F.col(c), v) if c in supplied.columns else v for c, v in defaults.items()})
    both = current.alias("a").join(full.alias("b"), key, "full_outer")
    return both.select(key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in full.columns else F.col(f"a.{c}").alias(c) for c in cols])


def guarded_status(status: Column, wanted: Column) -> Column:
    """A fulfilled order keeps its status."""
    return F.when(status == "fulfilled", status).otherwise(F.coalesce(wanted, status))


def order_lifecycle(events: DataFrame) -> DataFrame:
    """events (order_id, seq, kind of paid, fulfilled, canceled, refunded): the status each order ends in.

    The first fulfilment decides, whatever follows; without one, the last event does. Both are
    aggregates, so an order with very many events combines before it is shuffled.
    """
    wanted = F.when(F.col("kind").isin(*ORDER_STATES), F.col("kind"))
    good = events.withColumn("kind", wanted).dropna(subset=["kind"])
    ends = good.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_events"), F.min(F.when(F.col("kind") == "fulfilled", F.col("seq"))).alias("fulfilled_at"), F.max(F.struct("seq", "kind")).alias("last"))
    return ends.select("order_id", "n_events", "fulfilled_at", F.when(F.col("fulfilled_at").isNotNull(), "fulfilled").otherwise(F.col("last.kind")).alias("status"))


def merge_metadata(old: Column, new: Column) -> Column:
    """Maps, shallow: the right side wins, null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def import_keys(pool: DataFrame, lines: DataFrame, prefix: str) -> DataFrame:
    """lines (line): keys not in the pool yet, once each."""
    found = lines.select(F.regexp_extract("line", rf"({prefix}\S+)", 1).alias("key")).filter("key <> ''").distinct()
    return found.join(pool.select("key"), "key", "left_anti")


def resolve_tier(cart_tier: Column, meta_tier: Column, any_foreign: Column) -> Column:
    """The cart is the authority; what metadata declares counts only if nothing foreign was bought."""
    return F.coalesce(cart_tier, F.when(~any_foreign & meta_tier.isin("pro", "studio"), meta_tier))


# --- lists -----------------------------------------------------------------------------------------


def journal(rows: DataFrame, seq: str = "seq", cap: int = JOURNAL_CAP) -> DataFrame:
    """The newest rows, newest first."""
    return rows.orderBy(F.desc(seq)).limit(cap)


def recents(opened: DataFrame, cap: int = RECENTS_CAP) -> DataFrame:
    """opened (path, seq): the paths opened last, once each."""
    return opened.groupBy("path").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")).limit(cap)


def least_recent_out(touched: DataFrame, keep: int = 24) -> DataFrame:
    """touched (id, seq): ids a cache of `keep` entries still holds."""
    return touched.groupBy("id").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")).limit(keep)


def add_first(known: DataFrame, arriving: DataFrame, key: str, ordinal: str) -> DataFrame:
    """known plus the rows of arriving that are new; of one key the first arrival stands."""
    cols = arriving.columns
    first = arriving.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(ordinal)).alias("_r")).select("_r.*")
    return known.unionByName(first.join(known.select(key), key, "left_anti").select(*known.columns))


#: Numbers that a name may take; a later one ends in the time.
LAST_NUMBER = 999
_NAME = ("dir", "stem", "ext")


def _numbers(ordinals: list[int], taken: list[int] | None, blocked: list | None) -> list[int]:
    """Of files of one name in order: each takes the first number that is free when its turn comes."""
    gone, since = set(taken or ()), {b["number"]: b["since"] for b in blocked or ()}
    out, k = [], 0
    for o in ordinals:
        k += 1
        while k <= LAST_NUMBER and (k in gone or since.get(k, o) < o):
            k += 1
        out.append(k)
    return out


#: What stands before a number beyond LAST_NUMBER, and that number.
_LATE = r"^(.+)-([1-9][0-9]{3,17})$"


def _numbers_on(late: DataFrame, files: DataFrame, taken: DataFrame) -> DataFrame:
    """late (dir, stem, ext, ordinal): with k, the numbers from LAST_NUMBER + 1 on that are free, in order of ordinal.

    Not free are those of taken and those that another file has as its own stem. A number in place p of
    those is passed by the files that come after as many free ones, so files and such numbers are ranked
    together, by ranges: however many files one stem has, they never meet in one task.
    """
    name = F.struct(*_NAME).alias("_name")
    ranked = rank_in_order(late.select(name, F.col("ordinal").cast("long").alias("ordinal")), "_name", ["ordinal"], "_at")
    lies = taken.select("dir", F.regexp_extract("name", r"^(.+)\.[^.]*$", 1).alias("_s"), F.regexp_extract("name", r"\.([^.]*)$", 1).alias("ext"))
    own = files.select("dir", F.col("stem").alias("_s"), "ext")
    held = lies.unionByName(own).select("dir", F.regexp_extract("_s", _LATE, 1).alias("stem"), "ext", F.regexp_extract("_s", _LATE, 2).try_cast("long").alias("t")).dropna(subset=["t"]).distinct()
    held = written(held.join(late.select(*_NAME).distinct(), list(_NAME), "left_semi").select(name, "t"), "held")
    if not held.isEmpty():
        gaps = rank_in_order(held, "_name", ["t"], "_i").select("_name", (F.col("t") - LAST_NUMBER - F.col("_i")).alias("_at"), F.lit(1).alias("_gap"), F.lit(None).cast("long").alias("ordinal"))
        both = ranked.select("_name", "_at", F.lit(0).alias("_gap"), "ordinal").unionByName(gaps)
        ranked = rank_in_order(both.withColumnRenamed("_at", "_free"), "_name", ["_free", "_gap"], "_at").filter("_gap = 0")
    return ranked.select("_name.*", "ordinal", (F.col("_at") + LAST_NUMBER).alias("k"))


def safe_names(files: DataFrame, taken: DataFrame, stamp: Column | None = None, go_on: bool = False) -> DataFrame:
    """files (dir, stem, ext, ordinal), taken (dir, name): stem.ext, or the next free stem-2, stem-3 ... in order of ordinal.

    A name is free if it is not taken and no file of a lower ordinal has it, of whatever stem: a-2.png
    may be the plain name of a file a-2 or the second a.png. Beyond 999 a name ends in `stamp`, the time
    in milliseconds (a literal, the ordinal if none is given), so at most 999 files of a stem and folder
    ever compete, and only they are listed. Numbers are given within each stem; plain names and numbers
    that meet between stems block the later file, and numbers are given anew until nothing changes: the
    file of the least ordinal is right at once, and each round settles at least the next one.

    With go_on, numbers go on beyond 999 instead; there, a number that is the end of another file's own
    stem is left to that file.
    """
    order = Window.partitionBy(*_NAME).orderBy("ordinal")
    first = files.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= LAST_NUMBER)
    groups = first.groupBy(*_NAME).agg(F.sort_array(F.collect_list(F.col("ordinal").cast("long"))).alias("ordinals"))
    held = taken.join(groups.select(*_NAME), "dir")
    tail = F.expr("substring(name, length(stem) + 1, length(name) - length(stem) - length(ext) - 1)")
    fits = F.expr("startswith(name, stem) and endswith(name, concat('.', ext)) and length(name) > length(stem) + length(ext)")
    number = F.when(tail == "", 1).when(tail.rlike("^-([2-9]|[1-9][0-9]{1,2})$"), F.substring(tail, 2, 3).cast("int"))
    used = held.filter(fits).select(*_NAME, number.alias("k")).filter("k is not null").groupBy(*_NAME).agg(F.collect_set("k").alias("taken"))
    groups = written(groups.join(used, list(_NAME), "left"), "names")

    give = F.udf(lambda ordinals, taken, blocked: _numbers(ordinals, taken, blocked), "array<int>")  # a row is a stem of a folder
    nothing = F.lit(None).cast("array<struct<number:int,since:bigint>>")
    given = written(groups.withColumn("numbers", give("ordinals", "taken", nothing)), "names")
    parts = lambda k: F.regexp_extract("stem", r"^(.+)-([2-9]|[1-9][0-9]{1,2})$", k)
    family = groups.select(*_NAME, parts(1).alias("parent"), parts(2).alias("number")).filter("parent <> ''").withColumn("number", F.col("number").cast("int"))
    pairs = written(family.join(groups.select("dir", F.col("stem").alias("parent"), "ext"), ["dir", "parent", "ext"]), "pairs")
    while not pairs.isEmpty():
        plain = pairs.join(given.filter("numbers[0] = 1").select(*_NAME, F.col("ordinals")[0].alias("since")), list(_NAME)).select("dir", F.col("parent").alias("stem"), "ext", "number", "since")
        whose = given.select("dir", F.col("stem").alias("parent"), "ext", F.explode(F.arrays_zip("ordinals", "numbers")).alias("e")).select("dir", "parent", "ext", F.col("e.numbers").alias("number"), F.col("e.ordinals").alias("since"))
        numbered = pairs.join(whose, ["dir", "parent", "ext", "number"]).select(*_NAME, F.lit(1).alias("number"), "since")
        blocks = plain.unionByName(numbered).groupBy(*_NAME).agg(F.collect_list(F.struct("number", "since")).alias("blocked"))
        again = groups.join(blocks, list(_NAME), "left").select(*groups.columns, give("ordinals", "taken", "blocked").alias("numbers"))
        again = written(again, "names")
        settled = again.exceptAll(given.select(*again.columns)).isEmpty()
        given = again
        if settled:
            break
    chosen = given.select(*_NAME, F.explode(F.arrays_zip("ordinals", "numbers")).alias("e")).select(*_NAME, F.col("e.ordinals").alias("ordinal"), F.col("e.numbers").alias("k"))
    full = groups.filter(F.size("ordinals") == LAST_NUMBER).select(*_NAME, F.element_at("ordinals", -1).alias("_last"))
    rest = files.join(full, list(_NAME)).filter("ordinal > _last").select(*_NAME, "ordinal", F.lit(LAST_NUMBER + 1).alias("k"))
    late = (F.col("ordinal") if stamp is None else stamp).cast("string")
    k = F.col("k")
    if go_on:
        past = written(chosen.filter(k > LAST_NUMBER).unionByName(rest.withColumn("ordinal", F.col("ordinal").cast("long"))).drop("k"), "late")
        chosen, late = chosen.filter(k <= LAST_NUMBER), k.cast("string")
        rest = past.withColumn("k", F.lit(0).cast("long")) if past.isEmpty() else _numbers_on(past, files, taken)
    name = F.concat("stem", F.when(k > LAST_NUMBER, F.concat(F.lit("-"), late)).when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(""), F.lit("."), "ext")
    return chosen.unionByName(rest).select("dir", F.col("ordinal").cast(files.schema["ordinal"].dataType).alias("ordinal"), name.alias("name"))
