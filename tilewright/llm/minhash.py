"""MinHash near-dedup with circulant signatures, banding and exact Jaccard verification.

Two fixed permutations of [0, UNIVERSE) give all coordinates: the first scatters the shingle ids, the
second, shifted circularly by k, orders them for coordinate k. A shingle's K values are thus K
neighbouring entries of the second permutation, and a signature is the column-wise minimum of those
windows. Texts with equal word sequences are one class, so copies cost one signature row each and no
pairs. In a bucket every class is compared with its leader, the class that meets most others over all
bands. Buckets whose classes then still lie in several components are settled exactly: small ones
compare all pairs between components; classes of large ones meet only where they share one of their
rarest shingles, as two sets of the wanted similarity must (a prefix join), and again only between
components. Every pair that could join two components is thus compared on the full shingle sets or
ruled out by its sizes and prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import materialize, own_columns, text_or_empty, with_names
from tilewright.llm.components import connected_components

UNIVERSE = 1 << 20
BANDS, ROWS = 24, 4
SHINGLE_WORDS = 5
PERCENT = 80
#: Buckets of up to so many classes compare all pairs of different components; larger ones go by prefixes.
SMALL_BUCKET = 6
#: Members that are verified against one copy of a leader's text.
PER_LEADER_COPY = 32
_CACHE_WORDS = 1_000_000
_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_ids(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct 64-bit ids of the shingles; a shorter sequence is one shingle."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    s = np.full(n, width, np.uint64)
    for k in range(width):
        s = (s + h[k : k + n]) * _STEP
    return np.unique(mix(s))


class Circulant:
    """Signatures of k coordinates from two permutations."""

    def __init__(self, k: int, universe: int = UNIVERSE, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(universe).astype(np.int32)
        order = rng.permutation(universe).astype(np.int32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: k - 1]]), k)
        self.shift = np.uint64(64 - universe.bit_length() + 1)

    def signature(self, ids: np.ndarray) -> np.ndarray:
        at = self.scatter[(ids >> self.shift).astype(np.int64)]
        parts = [self.windows[at[i : i + 2048]].min(axis=0) for i in range(0, len(at), 2048)]
        return parts[0] if len(parts) == 1 else np.min(parts, axis=0)


def _signatures(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, words_of = Circulant(bands * rows), WordHashes()
        number = np.arange(bands, dtype=np.uint64) * _M2
        for batch in batches:
            n_out, seq_out, band_out, ends = [], [], [], [0]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = text.lower().split()
                ids = shingle_ids(words_of.of(words), width)
                n_out.append(len(ids))
                if len(ids):
                    sig = made.signature(ids).reshape(bands, rows).astype(np.uint64)
                    key = number.copy()
                    for r in range(rows):
                        key = mix((key + sig[:, r]) * _STEP)
                    band_out.append(key.view(np.int64))
                    seq_out.append(xxhash.xxh3_128_digest(b" ".join(words)))
                else:
                    seq_out.append(None)
                ends.append(ends[-1] + (bands if len(ids) else 0))
            flat = np.concatenate(band_out) if band_out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tkey"), pa.array(n_out, pa.int64()), pa.array(seq_out, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "tkey", "n_shingles", "seq", "bands"],
            )

    return run


def _shingle_set(text: bytes, width: int) -> set:
    words = text.lower().split()
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def _verify(width: int, percent: int):
    """Rows sorted by (leader, part, member?): the leader's text, then those of its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, set()
        for batch in batches:
            us, vs = [], []
            for a, part, kind, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "kind", "b")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if kind == 0:
                    if at != a:
                        at, own = a, _shingle_set(text, width)
                elif at == a:
                    other = _shingle_set(text, width)
                    both = len(own & other)
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        us.append(a)
                        vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs (a, b), distinct: those whose shingle sets are similar enough, as (u, v)."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    parts = pairs.join(sizes, "a").withColumn("part", F.expr(f"cast(pmod(xxhash64(b), (_n + {PER_LEADER_COPY - 1}) div {PER_LEADER_COPY}) as int)")).select("a", "part", "b")
    parts = materialize(parts, "parts")
    members = parts.join(texts, parts["b"] == texts["node"]).select("a", "part", F.lit(1).alias("kind"), "b", "text")
    heads = parts.select("a", "part").distinct().join(texts, F.col("a") == texts["node"]).select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    rows = heads.union(members).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return materialize(rows.mapInArrow(_verify(width, percent), "u long, v long"), "links")


def _ids(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in batches:
            found = [shingle_ids(words_of.of(t.lower().split()), width).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "ids"])

    return run


def _prefix_pairs(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """nodes (node, n, comp, nmin: least size of a possible partner): pairs (a, b) of different components that share a
    shingle of their prefixes.

    Sets of similarity percent / 100 overlap in at least `percent (n + m) / (100 + percent)` shingles, so with the
    shingles in one order for all, rarest first, the first n + 1 - overlap of either must meet. A
    shingle's most frequent component is not paired with itself, so copies around one text stay linear.
    """
    ids = texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(_ids(width), "node long, ids array<long>")
    ids = materialize(ids.select("node", F.explode("ids").alias("id")), "ids")
    known = ids.join(ids.groupBy("id").agg(F.count(F.lit(1)).alias("df")), "id")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "id"))
    overlap = f"({percent} * (n + greatest(nmin, ({percent} * n + 99) div 100)) + {99 + percent}) div {100 + percent}"
    prefix = known.withColumn("rank", rank).join(nodes, "node").filter(f"df > 1 and rank <= n + 1 - {overlap}")
    prefix = materialize(prefix.select("id", "node", "n", "comp", "rank"), "prefix")
    by_comp = prefix.groupBy("id", "comp").agg(F.count(F.lit(1)).alias("c"))
    major = by_comp.groupBy("id").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    others = prefix.join(major, "id").filter("comp <> m.comp").select("id", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("rank").alias("ra"))
    both = f"({percent} * (n + na) + {99 + percent}) div {100 + percent}"  # the overlap that this pair needs
    met = prefix.join(others, "id").filter(f"comp <> ca and rank <= n + 1 - {both} and ra <= na + 1 - {both}")
    return met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _components(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with shingles (doc_id, tkey, n_shingles, comp) and rows without (doc_id, tkey, n_shingles); tkey is the text's hash."""
    source = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tkey", F.xxhash64("text"))
    schema = "doc_id long, tkey long, n_shingles long, seq binary, bands array<long>"
    signed = source.mapInArrow(_signatures(bands, rows, width), schema)
    signed = materialize(signed.withColumn("rid", F.monotonically_increasing_id()), "signed")
    classes = materialize(signed.filter("n_shingles > 0").groupBy("seq").agg(F.min("rid").alias("node")), "classes")
    nodes = signed.join(classes.select(F.col("node").alias("rid")), "rid").select(F.col("rid").alias("node"), "doc_id", "tkey", "n_shingles", "bands")
    spread = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    full = spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = materialize(spread.join(full, "key"), "members")
    meets = members.groupBy("node").agg(F.sum("m").alias("meets"))
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id", "tkey"), "node")
    held = source.alias("s").join(wanted.alias("w"), F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s.tkey") == F.col("w.tkey")))
    texts = materialize(held.select("node", "text"), "texts")
    if not texts.groupBy("node").count().filter("count > 1").isEmpty():  # rows repeated under one doc_id
        texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    members = materialize(members.join(meets, "node").drop("m"), "members")
    heads = members.groupBy("key").agg(F.max(F.struct("meets", (-F.col("node")).alias("first"), "n")).alias("lead"))
    led = materialize(members.join(heads.select("key", (-F.col("lead.first")).alias("a"), F.col("lead.n").alias("na")), "key").filter("node <> a"), "led")
    tried = led.filter(f"100 * least(n, na) >= {percent} * greatest(n, na)").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    tried = materialize(tried.distinct(), "tried")
    links = _linked(tried, texts, width, percent)
    comps = materialize(connected_components(links), "comps")
    placed = led.select("key", "node", "n").join(comps, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("n").alias("nmin")).filter("c1 <> c2").select("key", "m", "nmin")
    left = materialize(placed.join(mixed, "key"), "left")
    if not left.isEmpty():
        small = left.filter(F.col("m") <= SMALL_BUCKET)
        lead = small.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
        met = small.join(lead, "key").filter(f"comp <> ca and a < node and 100 * least(n, na) >= {percent} * greatest(n, na)").select("a", F.col("node").alias("b"))
        large = materialize(left.filter(F.col("m") > SMALL_BUCKET).groupBy("node", "n", "comp").agg(F.min("nmin").alias("nmin")), "large")
        fresh = met.union(_prefix_pairs(large, texts, width, percent)).distinct().join(tried, ["a", "b"], "left_anti")
        links = links.union(_linked(materialize(fresh, "fresh"), texts, width, percent))
        comps = materialize(connected_components(links), "comps")

    owner = signed.join(classes, "seq").select("doc_id", "tkey", "n_shingles", "node")
    owner = owner.join(comps, "node", "left").select("doc_id", "tkey", "n_shingles", F.coalesce("comp", "node").alias("comp"))
    return materialize(owner, "owner"), signed.filter("n_shingles = 0").select("doc_id", "tkey", "n_shingles")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Words are lower-cased in A-Z only. Null and empty texts, and texts of white space, have no
    shingles, link with nothing and are their own component. Rows repeated under one doc_id are one
    document if their words are equal. A null doc_id never names a component unless all its ids are
    null; such rows are not kept unless alone. An empty table gives an empty result; other columns
    of docs are ignored.
    """
    owner, bare = _components(docs, width, percent, bands, rows)
    smallest = owner.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    full = owner.join(smallest, "comp").select("doc_id", "n_shingles", "component_id")
    alone = bare.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: one of each component, whatever its doc_id.

    A component keeps a row of its smallest doc_id (null last), of these the one with most shingles. Texts under one doc_id that
    are not near copies stay each, and so do all different texts without an id. Of rows without shingles one stays
    for each doc_id, and all that have none.
    """
    owner, bare = _components(docs, width, percent, BANDS, ROWS)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", (-F.col("n_shingles")).alias("less"), "tkey")).alias("b")
    kept = owner.groupBy("comp").agg(best).select("b.doc_id", "b.tkey")
    named = bare.filter("doc_id is not null").groupBy("doc_id").agg(F.min("tkey").alias("tkey"))
    unnamed = bare.filter("doc_id is null").select("doc_id", "tkey").distinct().withColumn("times", F.lit(1).cast("long"))
    times = owner.select("doc_id", "tkey").union(bare.filter("doc_id is not null").select("doc_id", "tkey")).groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("times"))
    chosen = kept.union(named).alias("c").join(times.alias("t"), F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("c.tkey") == F.col("t.tkey"))).select("c.doc_id", "c.tkey", "times")
    verdict = materialize(chosen.union(unnamed), "kept")

    rows, own = own_columns(docs)
    rows = rows.withColumn("_tkey", F.xxhash64(text_or_empty(own["text"])))

    def rows_of(chosen: DataFrame) -> DataFrame:
        return rows.join(chosen, rows[own["doc_id"]].eqNullSafe(chosen["doc_id"]) & (rows["_tkey"] == chosen["tkey"]), "left_semi")

    repeated = verdict.filter("times > 1")
    if repeated.isEmpty():
        return with_names(rows_of(verdict), own)
    once = rows_of(verdict.filter("times = 1")).select(*own.values())
    first = rows_of(repeated).groupBy(own["doc_id"], "_tkey").agg(F.first(F.struct(*own.values())).alias("_row")).select("_row.*")
    return with_names(once.unionByName(first), own)
