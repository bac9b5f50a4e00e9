"""URL filters by a temporal list join.

Dated list entries (add, remove) become validity intervals, and the intervals of one pattern a
timeline: the times at which it changes, each with the lists that are active from then on. A capture
is looked up under every key its URL has (host, parent domains, path prefixes, the URL itself), and
each key's timeline is read as of its fetch time: the last change not after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import materialize, own_columns, row_ids

#: Timelines up to this number are broadcast (they are rows of a few short columns); beyond, both sides are shuffled.
BROADCAST_ROWS = 50_000
MADE = ("host", "blocked", "n_active", "lists")


def host_of(url: Column) -> Column:
    """In lower case, without user, port and one final dot; an address in brackets is taken whole. Empty without one."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)", 1)
    return F.regexp_replace(F.lower(host), r"\.\z", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """entries (list, kind, pattern, action add/remove, at): list, kind, pattern, valid_from, valid_to.

    valid_to is exclusive and null while open. A remove closes what is open; an add to an open entry
    changes nothing; of events at one time the remove counts last. Rows with a null field are left out.
    """
    good = entries.dropna(subset=["list", "kind", "pattern", "action", "at"])
    final = good.groupBy("list", "kind", "pattern", "at").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    by = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    turns = final.withColumn("_was", F.lag("on", 1, 0).over(by)).filter("on <> _was")
    return turns.withColumn("valid_to", F.lead("at").over(by)).filter("on = 1").select("list", "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def timelines(intervals: DataFrame) -> DataFrame:
    """One row a pattern: kind, pattern, changes (array of at and the sorted lists active from then on), in order of at."""
    held = intervals.groupBy("kind", "pattern").agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("_v"))  # one pattern's dated entries
    times = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform("_v", lambda v: F.array(v["valid_from"], v["valid_to"]))))))
    active = lambda t: F.filter("_v", lambda v: (v["valid_from"] <= t) & (v["valid_to"].isNull() | (t < v["valid_to"])))
    return held.select("kind", "pattern", F.transform(times, lambda t: F.struct(t.alias("at"), F.array_sort(F.transform(active(t), lambda v: v["list"])).alias("lists"))).alias("changes"))


def as_of(changes: Column, t: Column) -> Column:
    """The lists active at t: those of the last change not after it; none before the first."""
    return F.coalesce(F.try_element_at(F.filter(changes, lambda c: c["at"] <= t), F.lit(-1))["lists"], F.array().cast("array<string>"))


def _keys(host: Column, path: Column, url: Column, least_labels: int) -> Column:
    address = host.startswith("[") | host.rlike(r"^[0-9]+(\.[0-9]+){3}$")  # has no parent domains
    labels = F.when(address, F.array(host)).otherwise(F.split(host, r"\."))
    last = F.size(labels) - least_labels + 1
    starts = F.when(address, F.array(F.lit(1))).when(last > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), last))).otherwise(F.array().cast("array<int>"))
    domains = F.transform(starts, lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    parts = F.array_remove(F.split(path, "/"), "")
    prefixes = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("pattern")),
    )
    whole = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")), F.struct(F.lit("url").alias("kind"), url.alias("pattern")))
    return F.array_distinct(F.concat(domains, prefixes, whole))


def filter_urls(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """captures (url, fetched_at, ...) with host, blocked, n_active and lists; one row per input row.

    n_active counts the entries active at fetched_at under any key of the URL; lists names their lists,
    sorted, joined by commas. A null url or time, or a url without a host, matches nothing. Top-level
    domains are looked up only if the list names one, so `com` is no key that all captures share.
    Repeated rows are judged each; an empty table gives an empty result; columns of captures with the
    names made here are replaced, all others come back as they are, whatever their names.
    """
    kept = [c for c in captures.columns if c not in MADE]
    rows, own = own_columns(captures.select(*kept))
    url, fetched = F.col(own["url"]), F.col(own["fetched_at"])
    rows = materialize(row_ids(rows.withColumn("host", F.coalesce(host_of(url), F.lit("")))), "captures")
    lines = materialize(timelines(validity_intervals(entries)), "timelines")
    tops = not lines.filter((F.col("kind") == "domain") & ~F.col("pattern").contains(".")).isEmpty()
    looked = rows.filter("host <> ''").filter(fetched.isNotNull()).select("_rid", fetched.alias("_t"), F.explode(_keys(F.col("host"), path_of(url), url, 1 if tops else 2)).alias("_k"))
    side = F.broadcast(lines) if lines.count() <= broadcast_rows else lines
    met = looked.select("_rid", "_t", "_k.kind", "_k.pattern").join(side, ["kind", "pattern"]).select("_rid", as_of(F.col("changes"), F.col("_t")).alias("_lists")).filter(F.size("_lists") > 0)
    found = met.groupBy("_rid").agg(F.sum(F.size("_lists")).alias("n_active"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_lists")))), ",").alias("lists"))
    out = rows.join(found, "_rid", "left")
    return out.select(*[F.col(own[c]).alias(c) for c in kept], "host", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"))
