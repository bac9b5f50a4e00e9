"""Suffix-array dedup: remove bytes covered by long strings that also start elsewhere.

Equal strings must meet before they can be sorted together, so each window of `length` bytes is dealt
by its anchor: the 32-byte string inside it with the least hash (the leftmost of equals), which
depends on the window's bytes alone. Windows that share an anchor in a document form one segment.
Segments whose anchor occurs once cannot repeat. The others are sorted, anchor by anchor, with a
suffix array built in two stages: suffixes smaller than their successors are sorted directly, the
rest are induced by scanning the buckets, and adjacent common prefixes then show what repeats. Equal
segments count as one text with a multiplicity.

A passage that very many different texts share makes a group too large for one task. Its windows are
dealt anew by where the anchor lies in them: all windows with the anchor in a narrow range of places
contain one core around it, so equal windows meet under (anchor, range, core), and texts that differ
near the passage part. Groups that stay too large get narrower ranges; at a range of one place the
core is the window itself and a group is one text. Every group ends in a suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import passages
from tilewright.llm.common import materialize, text_or_empty
from tilewright.llm.minhash import mix

LENGTH = 400
ANCHOR = 32
#: Different segments that a task sorts together; larger groups are dealt anew by cores.
HOT_GROUP = 4_000
#: A content that more than this part of all segments share is told by a broadcast: that many contents at most.
HEAVY_CONTENTS = 256
#: Bytes of segments in one suffix array (a group of segments is never cut).
BATCH_BYTES = 1 << 18
#: Windows of a text that are hashed at once: a dozen arrays of eight bytes a window.
_SLICE = 1 << 20
#: Symbols of nine bits in the number that suffixes are first sorted by.
_HEAD = 7
_PLACE = np.uint64((1 << 24) - 1)
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def anchors(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchors of a text's windows: hash, first and last start of the windows that have it, its place, in order."""
    parts = []
    for at in range(0, max(1, len(text) - length + 1), _SLICE):
        t = np.frombuffer(text, np.uint8)[at : at + _SLICE + length - 1].astype(np.uint64)
        if len(t) < length:
            continue
        two = t[:-1] << np.uint64(8) | t[1:]
        four = two[:-2] << np.uint64(16) | two[2:]
        eight = four[:-4] << np.uint64(32) | four[4:]
        n = len(t) - anchor + 1
        h = mix(eight[:n] * _C[0] + eight[8 : 8 + n] * _C[1] + eight[16 : 16 + n] * _C[2] + eight[24 : 24 + n] * _C[3])
        least = passages.slide_min(h & ~_PLACE | np.arange(n, dtype=np.uint64), length - anchor + 1) & _PLACE
        first = np.flatnonzero(np.diff(least, prepend=np.uint64(_PLACE)))
        last = np.append(first[1:], len(least)) - 1
        place = least[first].astype(np.int64)
        parts.append((h[place].view(np.int64), first + at, last + at, place + at))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _sort_direct(t: np.ndarray, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """starts in the order of raw[start:stop], ties in place: by their first symbols as one number, then run by run of equal ones."""
    n = len(t)
    wide = np.zeros(n + _HEAD, np.int64)
    wide[:n] = t
    heads = np.zeros(n, np.int64)  # of every place, whatever ends within it
    for k in range(_HEAD):
        heads = heads << 9 | wide[k : k + n]
    head = heads[starts]
    short = np.flatnonzero(stops - starts < _HEAD)
    head[short] &= ~((np.int64(1) << 9 * (_HEAD - (stops - starts)[short])) - 1)  # symbols beyond the stop do not count
    order = np.argsort(head, kind="stable")
    head, starts, stops = head[order], starts[order], stops[order]
    tied = np.flatnonzero(np.diff(head, prepend=-1, append=-1) != 0)
    low, high = tied[:-1], tied[1:]
    runs = (high - low > 1) & (head[low] & 511 != 0)  # of equal heads that have not ended yet
    begin, end, out = (starts + _HEAD).tolist(), stops.tolist(), starts.tolist()
    for i, j in zip(low[runs].tolist(), high[runs].tolist(), strict=True):
        keys = [raw[a:b] for a, b in zip(begin[i:j], end[i:j], strict=True)]
        part = out[i:j]
        out[i:j] = [part[k] for k in sorted(range(j - i), key=keys.__getitem__)]
    return np.array(out, np.int64)


def suffix_array(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-stage suffix sorting of texts, in the order of their first `depth` bytes.

    Returns the concatenation (each text ended by a separator below every byte), the starts of its
    suffixes in order (separators first), and the starts of the texts.
    """
    sizes = np.array([len(x) + 1 for x in texts])
    begins = np.cumsum(sizes) - sizes
    t = np.zeros(sizes.sum(), np.int16)
    for b, x in zip(begins.tolist(), texts, strict=True):
        t[b : b + len(x)] = np.frombuffer(x, np.uint8)
        t[b : b + len(x)] += 1
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32), append=-1))
    decided = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]  # where the next different symbol decides
    smaller = step[np.minimum(decided, n - 1)] > 0
    separator = t == 0
    direct = np.flatnonzero(smaller & ~separator)
    ends = np.repeat(begins + sizes - 1, sizes)
    direct = _sort_direct(t, b"\x00".join(texts), direct, np.minimum(direct + depth, ends[direct]))
    by_symbol = np.split(direct, np.searchsorted(t[direct], np.arange(1, 257))) if len(direct) else [direct] * 257
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    larger = ~smaller & ~separator
    order: list[np.ndarray] = []

    def scan(entries: np.ndarray) -> None:
        """Put the predecessors that are larger than their successors into their buckets, in this order."""
        before = entries[entries > 0] - 1
        before = before[larger[before]]
        symbols = t[before]
        sort = np.argsort(symbols, kind="stable")
        before, symbols = before[sort], symbols[sort]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for part in np.split(before, cuts):
            if len(part):
                induced[t[part[0]]].append(part)

    for symbol in range(257):
        if symbol == 0:
            chunk = np.flatnonzero(separator)
            order.append(chunk)
            scan(chunk)
            continue
        while induced[symbol]:  # suffixes of this bucket may induce others of it
            chunk = np.concatenate(induced[symbol])
            induced[symbol] = []
            order.append(chunk)
            scan(chunk)
        chunk = by_symbol[symbol]
        if len(chunk):
            order.append(chunk)
            scan(chunk)
    return t, np.concatenate(order), begins


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of the different texts, the starts of `length`-byte strings that start twice or more in all of them."""
    t, order, begins = suffix_array(texts, length)
    text_of = np.searchsorted(begins, order, side="right") - 1
    ends = begins + np.array([len(x) for x in texts])
    long = order + length <= ends[text_of]
    a, b = order[:-1], order[1:]
    pairs = np.flatnonzero(long[:-1] & long[1:])
    views = np.lib.stride_tricks.sliding_window_view(t, length) if len(t) >= length else None
    marked = np.zeros(len(t), bool)
    for i in range(0, len(pairs), 4096):
        p = pairs[i : i + 4096]
        p = p[(t[a[p] + length - 1] == t[b[p] + length - 1]) & (t[a[p] + length // 2] == t[b[p] + length // 2])]
        common = (views[a[p]] == views[b[p]]).all(axis=1)  # adjacent common prefix of at least `length`
        marked[a[p][common]] = True
        marked[b[p][common]] = True
    return [np.flatnonzero(marked[s:e]) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]


def _runs(starts: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()


def _measure(length: int, passage_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [np.unique(anchors(x, length)[0], return_counts=True) if len(x) >= length else (np.empty(0, np.int64),) * 2 for x in texts]
            rows = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
            hs, ns = (np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.empty(0, np.int64) for k in (0, 1))
            if passage_words:  # anchors of words count once a document
                more, words = passages.anchors(batch.column("text"), passage_words)
                order = np.argsort(np.append(rows, more), kind="stable")
                rows, hs, ns = (np.append(*x)[order] for x in ((rows, more), (hs, words), (ns, np.ones_like(words))))
            ends = pa.array(np.searchsorted(rows, np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (hs, ns)]
            shas = pa.array([hashlib.sha256(x).hexdigest() for x in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array([len(x) for x in texts], pa.int64()), shas, *lists], names=["doc_id", "tkey", "n_bytes", "sha", "hs", "ns"])

    return run


_SEGMENT = "did long, copies long, h long, k long, lo array<long>, hi array<long>, c1 long, c2 long, content binary"


def _segments(length: int):
    """Segments of a document whose anchors repeat: a row for each different content, with its k places as runs lo to hi of
    starts. A line that is repeated all through a document is one row. A task sends equal contents once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for did, copies, wanted, text in zip(*(part.column(c).to_pylist() for c in ("did", "copies", "hs")), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    h, first, last, _ = anchors(text, length)
                    keep = np.isin(h, np.array(wanted, np.int64))
                    held: dict[bytes, list] = {}
                    for a, lo, hi in zip(h[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                        content = text[lo : hi + length]
                        digest = xxhash.xxh3_128_digest(content)
                        row = held.get(digest)
                        if row is None:
                            new = digest not in sent
                            if new:
                                if len(sent) >= 1_000_000:
                                    sent.clear()
                                sent.add(digest)
                            c1, c2 = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                            held[digest] = [did, copies, a, 1, [lo], [hi], c1, c2, content if new else None]
                            continue
                        row[3] += 1
                        if lo == row[5][-1] + 1:
                            row[5][-1] = hi
                        else:
                            row[4].append(lo)
                            row[5].append(hi)
                    rows += held.values()
                columns = [*zip(*rows, strict=True)] if rows else [[]] * 9
                kinds = [*[pa.int64()] * 4, *[pa.list_(pa.int64())] * 2, *[pa.int64()] * 2, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SEGMENT.split(", ")])

    return run


_RUNS = "c1 long, c2 long, lo array<long>, hi array<long>"


def _sort_groups(length: int):
    """Rows sorted by (h, c1, c2): runs of repeated starts of every content, from suffix arrays over whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, bytes]] = []
        ready: list[tuple[int, int, bytes]] = []
        anchor = last = None

        def solve() -> pa.RecordBatch:
            found = [_runs(x) for x in repeated_starts([r[2] for r in ready], length)]
            rows = [(r[0], r[1], *f) for r, f in zip(ready, found, strict=True) if f[0]]
            ready.clear()
            columns = [*zip(*rows, strict=True)] if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["c1", "c2", "lo", "hi"])

        for batch in batches:
            for h, c1, c2, content in zip(*(batch.column(c).to_pylist() for c in ("h", "c1", "c2", "content")), strict=True):
                if h != anchor:
                    if len(group) > 1:  # a single content repeats only as a whole
                        ready += group
                    group, anchor, last = [], h, None
                    if sum(len(r[2]) for r in ready) >= BATCH_BYTES:
                        yield solve()
                if (c1, c2) != last:
                    group.append((c1, c2, content))
                    last = (c1, c2)
        if len(group) > 1:
            ready += group
        if ready:
            yield solve()

    return run


_PIECE = "p1 long, p2 long, at long, n long, h long, c1 long, c2 long, content binary"


def _recut(length: int, reach: int):
    """Contents cut into pieces whose windows have their anchor in one range of `reach` places, dealt by the core they all contain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, p1, p2, content in zip(*(batch.column(c).to_pylist() for c in ("h", "c1", "c2", "content")), strict=True):
                place = int(anchors(content, length)[3][0])
                last = len(content) - length
                for k in range((place - last) // reach, place // reach + 1):
                    lo, hi = max(0, place - (k + 1) * reach + 1), min(last, place - k * reach)
                    core = content[place - k * reach : place - (k + 1) * reach + 1 + length]
                    dealt = xxhash.xxh3_64_intdigest(core, seed=(h ^ k) & (1 << 64) - 1)
                    piece = content[lo : hi + length]
                    digest = xxhash.xxh3_128_digest(piece)
                    c1, c2 = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                    rows.append((p1, p2, lo, hi - lo + 1, dealt - (1 << 64) if dealt >> 63 else dealt, c1, c2, piece))
            columns = [*zip(*rows, strict=True)] if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], names=[c.split()[0] for c in _PIECE.split(", ")])

    return run


def _by_content(rows: DataFrame, times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose content (c1, c2) comes more than once, and rows whose content is not one of the very frequent ones.

    times: (c1, c2, m rows, times). Contents that a large part of the rows have are few, so they are
    told by a broadcast and their rows meet nowhere.
    """
    keys = ["c1", "c2"]
    total = times.agg(F.sum("m")).first()[0] or 0
    heavy = materialize(times.filter((F.col("m") > max(total // HEAVY_CONTENTS, 1000)) & (F.col("times") > 1)).select(*keys, F.lit(True).alias("heavy")), "heavy")
    marked = rows.join(F.broadcast(heavy), keys, "left")
    light = marked.filter("heavy is null").drop("heavy")
    return light.join(times.filter("times > 1").select(*keys), keys, "left_semi").unionByName(marked.filter("heavy").drop("heavy")), light


def _joined(runs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a content, as lists in any order: those that overlap or touch as one."""
    for batch in runs:
        rows = []
        for c1, c2, los, his in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "lo", "hi")), strict=True):
            kept: list[list[int]] = []
            for lo, hi in sorted(zip(los, his, strict=True)):
                if kept and lo <= kept[-1][1] + 1:
                    kept[-1][1] = max(kept[-1][1], hi)
                else:
                    kept.append([lo, hi])
            rows.append((c1, c2, [k[0] for k in kept], [k[1] for k in kept]))
        columns = [*zip(*rows, strict=True)] if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["c1", "c2", "lo", "hi"])


def _of_single(light: DataFrame, runs: DataFrame, times: DataFrame) -> DataFrame:
    """light (c1, c2, ...) whose content comes once (the others are found as a whole), a row for each run r (lo, hi) of repeated starts in it.

    A content in a large group has a run from every range of places it was cut into. They are joined to one list
    first, no longer than the content, so the join gives at most one row for a row of light.
    """
    listed = runs.groupBy("c1", "c2").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")).mapInArrow(_joined, _RUNS)
    once = listed.join(times.filter("times = 1").select("c1", "c2"), ["c1", "c2"])
    return light.join(once, ["c1", "c2"]).withColumn("r", F.explode(F.arrays_zip("lo", "hi")))


def _repeats_within(contents: DataFrame, length: int, hot_group: int, reach: int) -> DataFrame:
    """contents (h, c1, c2, content): runs (c1, c2, lo, hi) of starts of strings that other contents of the group, or the same, have too."""
    sizes = contents.select("h", "c1", "c2").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("m"))
    hot = materialize(sizes.filter(F.col("m") > hot_group).select("h"), "hot") if reach > 1 else None
    cold = contents if hot is None or hot.isEmpty() else contents.join(hot, "h", "left_anti")
    runs = cold.repartition("h").sortWithinPartitions("h", "c1", "c2").mapInArrow(_sort_groups(length), _RUNS)
    runs = runs.select("c1", "c2", F.inline(F.arrays_zip("lo", "hi")))
    if cold is contents:
        return materialize(runs, "runs")
    reach = -(-reach // 4)
    pieces = contents.join(hot, "h", "left_semi").dropDuplicates(["c1", "c2"]).mapInArrow(_recut(length, reach), _PIECE)
    pieces = materialize(pieces, "pieces")
    times = materialize(pieces.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("m")).withColumn("times", F.col("m")), "times")
    shared, light = _by_content(pieces.drop("h", "content"), times)
    whole = shared.select("p1", "p2", F.col("at").alias("lo"), F.expr("at + n - 1").alias("hi"))
    inner = _repeats_within(pieces.select("h", "c1", "c2", "content").dropDuplicates(["c1", "c2"]), length, hot_group, reach)
    parts = _of_single(light, inner, times).select("p1", "p2", (F.col("at") + F.col("r.lo")).alias("lo"), (F.col("at") + F.col("r.hi")).alias("hi"))
    found = whole.union(parts).select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), "lo", "hi")
    return materialize(runs.unionByName(found), "runs")


def _cut(length: int):
    """Texts with the runs of starts to remove: what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for did, spans, text in zip(batch.column("did").to_pylist(), batch.column("spans").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                edge = np.zeros(len(text) + 1, np.int64)
                lo = np.array([s["lo"] for s in spans])
                hi = np.array([s["hi"] for s in spans]) + length
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi, -1)
                gone = edge.cumsum()[:-1] > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((did, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = [*zip(*rows, strict=True)] if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["did", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return run


def _passages(one: DataFrame, width: int) -> DataFrame:
    """one (did, copies, hs, common, text): n_passages and n_passage_words of the documents that share windows of `width` words."""
    found = one.mapInArrow(passages.windows(width, False), passages.WINDOWS)
    runs = found.repartition("h").sortWithinPartitions("h").mapInArrow(passages.shared_windows, passages.RUNS)
    common = one.filter(F.size("common") > 0)
    if not common.isEmpty():
        rows = common.mapInArrow(passages.windows(width, True), passages.WINDOWS)
        rows = rows.select("*", F.size("prints").alias("n"), F.posexplode("prints").alias("k", "c1"))
        every = "flatten(transform(arrays_zip(lo, hi), r -> sequence(r.lo + k, r.hi, cast(n as long))))"
        rows = materialize(rows.select("did", "copies", "c1", F.col("h").alias("c2"), F.expr(every).alias("at")), "common")
        several = (F.min("did") != F.max("did")) | (F.max("copies") > 1)
        times = materialize(rows.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("m"), F.when(several, 2).otherwise(1).alias("times")), "times")
        more = _by_content(rows, times)[0].select("did", F.explode("at").alias("lo"))
        runs = runs.unionByName(more.withColumn("hi", F.col("lo")))
    listed = runs.groupBy("did").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    return listed.mapInArrow(passages.covered(width), passages.COVERED)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot_group: int = HOT_GROUP, with_text: bool = False, passage_words: int = 0) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes if with_text).

    Texts are judged as UTF-8 bytes, null as empty; texts shorter than `length` lose nothing. Every
    byte covered by a string of `length` bytes that starts anywhere else too is removed, all judged on
    the input. Rows repeated under one doc_id are documents of their own, so they remove each other.
    kept_bytes may end inside a character. An empty table gives an empty result; other columns of
    docs are ignored. With passage_words two columns follow, which remove nothing: the words of the text
    that lie in a run of so many words that another row has too, however few bytes it has, as n_passages
    maximal runs of n_passage_words words in all.
    """
    source = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tkey", F.xxhash64("text"))
    schema = "doc_id long, tkey long, n_bytes long, sha string, hs array<long>, ns array<long>"
    base = materialize(source.mapInArrow(_measure(length, passage_words), schema).withColumn("rid", F.monotonically_increasing_id()), "base")
    owners = base.filter(F.size("hs") > 0).groupBy("doc_id", "tkey").agg(F.min("rid").alias("did"), F.count(F.lit(1)).alias("copies"))
    owners = materialize(owners, "owners")
    spread = base.filter(F.size("hs") > 0).select("rid", F.explode(F.arrays_zip("hs", "ns")).alias("e")).select("rid", F.col("e.hs").alias("h"), F.col("e.ns").alias("n"))
    often = spread.groupBy("h").agg(F.sum("n").alias("times")).filter("times > 1")
    common = F.collect_list(F.when(F.col("times") > passages.COMMON, F.col("h"))).alias("common")
    wanted = spread.join(often, "h").groupBy("rid").agg(F.collect_list("h").alias("hs"), common)
    held = owners.join(wanted, owners["did"] == wanted["rid"]).select("doc_id", "tkey", "did", "copies", "hs", "common")
    same = F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s.tkey") == F.col("w.tkey"))
    texts = source.alias("s").join(held.alias("w"), same).select("w.did", "w.copies", "w.hs", "w.common", "s.text")
    texts = materialize(texts, "texts")  # a document repeated as a row is here as often; segments below take one
    one = texts.groupBy("did").agg(F.first("copies").alias("copies"), F.first("hs").alias("hs"), F.first("common").alias("common"), F.first("text").alias("text")) if not texts.filter("copies > 1").isEmpty() else texts
    segments = materialize(one.mapInArrow(_segments(length), _SEGMENT), "segments")
    times = materialize(segments.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("copies") * F.col("k")).alias("times")), "times")
    sent = segments.filter("content is not null").select("h", "c1", "c2", "content")
    runs = _repeats_within(sent, length, hot_group, length - ANCHOR + 1)
    shared, light = _by_content(segments.select("did", F.arrays_zip("lo", "hi").alias("spans"), "c1", "c2"), times)
    start = F.col("spans")[0]["lo"]  # of a content that comes once
    parts = _of_single(light, runs, times).select("did", F.array(F.struct((start + F.col("r.lo")).alias("lo"), (start + F.col("r.hi")).alias("hi"))).alias("spans"))
    spans = shared.select("did", "spans").union(parts).groupBy("did").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    edited = one.select("did", "text").join(spans, "did").mapInArrow(_cut(length), "did long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    if not with_text:
        edited = edited.drop("kept_bytes")
    if passage_words:
        edited = edited.join(_passages(one, passage_words), "did", "full")
    edited = edited.join(owners.select("did", "doc_id", "tkey"), "did").drop("did")
    same = F.col("b.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("b.tkey") == F.col("e.tkey"))
    out = base.alias("b").join(edited.alias("e"), same, "left")
    zero = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(0)).cast("long").alias(c)
    cols = [F.col("b.doc_id"), F.col("b.n_bytes"), zero("n_removed"), zero("n_spans"), F.coalesce("e.kept_sha256", "b.sha").alias("kept_sha256")]
    counts = [zero(c) for c in ("n_passages", "n_passage_words")] if passage_words else []
    return out.select(*cols, *([F.col("e.kept_bytes")] if with_text else []), *counts)
