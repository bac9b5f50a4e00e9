"""Language-model scoring with an Elias-Fano n-gram trie.

Three levels (words, pairs, triples) are counted on the cluster and written to the shared folder in
parts. All that is monotone is Elias-Fano coded: the hashes of the words and their running counts,
the heads of a part's pairs, the pointers from a head to its pairs and from a pair to its triples,
and the pairs and triples themselves, whose numbers start with the place of their context. A triple
names its last word by that word's rank among the followers of the middle one, so the number stays
small. Probabilities and back-off weights are quantised to a byte. Tasks map the files and query them
in coded form: pointers give the range of the context, selects over the high bits narrow it to the
entries with the same high part, and a search over the low bits ends it. Nothing is decoded whole.

A part holds a range of first words; a word that is too frequent for one part is cut by the second
word over as many parts as its share asks for.

Probabilities are interpolated with absolute discounting: p(w|uv) = a(uvw) + g(uv) p(w|v), and so on
down to words, where the discount goes to the unknown word. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import materialize, scratch_path, text_or_empty
from tilewright.llm.minhash import mix
from tilewright.llm.quality_classifier import held_out

CHUNK_TOKENS = 1_000_000
#: Documents for each part of the model: parts keep their size as the corpus grows.
DOCS_A_PART = 8192
MIN_PARTS = 64
#: Taken from every count, at each level.
DISCOUNT = 0.75
#: Different n-grams that a task holds before it sends them on.
TALLY_KEYS = 4_000_000
#: Documents of a batch that are hashed at once, and bytes of them.
DOCS_AT_ONCE, _SLICE = 500, 1 << 20
END = np.uint64(0x9E3779B97F4A7C15)  # no word has this hash but by a collision
_BASE = np.uint64(0xD1B54A32D192ED03)
#: Values of the bytes, A-Z as a-z, and which are white space.
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


# --- files -----------------------------------------------------------------------------------------


def shared_uri(spark: SparkSession, path: str) -> str:
    """path as Spark's own file system resolves it, so that Python tasks write where Spark would."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays, complete or not there: a repeated task writes the same again."""
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = [a.dtype.str, len(a), at]
        body.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    fs, path = _open(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(part) as out:
        out.write(np.array([len(text)], "<u8").tobytes() + text)
        for b in body:
            out.write(b)
    fs.move(part, path)


@functools.lru_cache(maxsize=4096)
def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory and kept mapped; a remote file is first copied into the executor's working folder."""
    fs, path = _open(uri)
    if not isinstance(fs, pyarrow.fs.LocalFileSystem):
        own = os.path.join(SparkFiles.getRootDirectory(), path.strip("/").replace("/", "_"))
        if not os.path.exists(own):
            part = f"{own}.{os.getpid()}"
            pyarrow.fs.copy_files(path, part, source_filesystem=fs, destination_filesystem=pyarrow.fs.LocalFileSystem())
            os.replace(part, own)
        path = own
    data = np.asarray(np.memmap(path, np.uint8, "r"))
    n = int(data[:8].view("<u8")[0])
    head = json.loads(bytes(data[8 : 8 + n]))
    return {name: data[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for name, (kind, size, at) in head.items()}


# --- Elias-Fano and quantisation -------------------------------------------------------------------

#: Place of the k-th set bit of a byte.
_PLACES = np.array([[*(k for k in range(8) if b >> k & 1), *[0] * 8][:8] for b in range(256)], np.uint64)
_U = np.arange(256, dtype=np.uint64)
_FIVES, _THREES, _FIFTEENS, _EACH, _TOPS = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))
_MAX_LOW = 56  # a low part and its shift fit one 64-bit read


def ef_encode(name: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A non-decreasing sequence below universe: low bits packed, high parts in unary, and the ones before each 64 bits of those."""
    v, n = values.astype(np.uint64), len(values)
    low = min(_MAX_LOW, max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1))
    bits = np.unpackbits(v.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low]
    packed = np.append(np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8))
    high = (v >> np.uint64(low)).astype(np.int64)
    unary = np.zeros(-(-(n + (max(universe - 1, 0) >> low) + 1) // 64) * 64, np.uint8)
    unary[high + np.arange(n)] = 1
    words = np.packbits(unary, bitorder="little").view("<u8")
    before = np.cumsum(np.bitwise_count(words).astype(np.uint64))
    return {f"{name}.meta": np.array([n, low], np.int64), f"{name}.low": packed, f"{name}.high": words, f"{name}.ones": np.append(np.uint64(0), before[:-1]).astype(np.uint32 if n < 1 << 32 else np.uint64)}


class Coded:
    """A coded sequence, queried in place."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str) -> None:
        self.n, self.low = (int(x) for x in arrays[f"{name}.meta"])
        self.high, self.ones = arrays[f"{name}.high"], arrays[f"{name}.ones"]
        packed = arrays[f"{name}.low"]
        self.reads = np.ndarray(len(packed) - 7, "<u8", packed, strides=(1,))  # 64 bits from any byte on
        self.mask = np.uint64((1 << self.low) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th one (or zero) of the high bits: its word by the directory, its byte by sums of all bytes at once."""
        before = self.ones.astype(np.int64) if ones else 64 * np.arange(len(self.ones)) - self.ones.astype(np.int64)
        word = np.searchsorted(before, k, side="right") - 1
        rest, bits = (k - before[word]).astype(np.uint64), self.high[word]
        bits = bits if ones else ~bits
        sums = bits - (bits >> _U[1] & _FIVES)
        sums = (sums & _THREES) + (sums >> _U[2] & _THREES)
        sums = (sums + (sums >> _U[4]) & _FIFTEENS) * _EACH  # byte i: set bits of bytes 0 to i
        shift = (((rest * _EACH | _TOPS) - sums & _TOPS) >> _U[7]) * _EACH >> _U[56] << _U[3]  # eight times the bytes before
        rest -= sums << _U[8] >> shift & _U[255]
        return 64 * word + (shift + _PLACES[bits >> shift & _U[255], rest]).astype(np.int64)

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.low
        return self.reads[bit >> 3] >> (bit & 7).astype(np.uint64) & self.mask

    def get(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, np.int64)
        return ((self._select(at, True) - at).astype(np.uint64) << np.uint64(self.low) | self._low(at)).astype(np.int64)

    def find(self, values: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> np.ndarray:
        """Place of each value between lo and hi, -1 where it is missing: the successor search of the context's range."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        v = values.astype(np.uint64)
        high, low = (v >> np.uint64(self.low)).astype(np.int64), v & self.mask
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        a, b = np.maximum(begin, lo), np.minimum(self._select(high, False) - high, self.n if hi is None else hi)
        end, live = b.copy(), np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < low[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        there = np.flatnonzero(a < end)
        there = there[self._low(a[there]) == low[there]]
        out = np.full(len(v), -1, np.int64)
        out[there] = a[there]
        return out


def quantise(name: str, p: np.ndarray) -> dict[str, np.ndarray]:
    """One byte a value: 256 groups of equal size in order of value, each shown by its mean."""
    if not len(p):
        return {f"{name}.code": np.empty(0, np.uint8), f"{name}.book": np.zeros(1)}
    edges = np.unique(np.quantile(p, np.linspace(0, 1, 257)[1:-1]))
    code = np.searchsorted(edges, p, side="left")
    book = np.bincount(code, p, len(edges) + 1) / np.maximum(np.bincount(code, minlength=len(edges) + 1), 1)
    return {f"{name}.code": code.astype(np.uint8), f"{name}.book": book}


def dequantise(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    return arrays[f"{name}.book"][arrays[f"{name}.code"][at]]


# --- the model as tasks see it ---------------------------------------------------------------------


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places of its queries."""
    part = part.astype(np.int16) if len(part) and part.max() < 1 << 15 else part  # short numbers sort by radix
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(part[rows[0]]), rows


def _runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and the run of each place."""
    new = np.append(True, x[1:] != x[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


class Trie:
    """Levels of a model folder, queried in their coded form."""

    def __init__(self, info: dict) -> None:
        self.info, self.n_parts, self.shift = info, info["parts"], 64 - (info["parts"].bit_length() - 1)
        self.firsts, self.totals = np.array(info["firsts"]), np.array(info["totals"])
        self.cut, self.cut_g = np.array(info.get("cut", []), np.int64), np.array(info.get("cut_g", []))

    def path(self, level: str, part: int) -> str:
        return f"{self.info['root']}/{level}-{part:05d}"

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of different hashes, -1 if unknown."""
        out = np.full(len(hashes), -1, np.int64)
        for k, rows in _by_part((hashes >> np.uint64(self.shift)).astype(np.int64)):
            if self.firsts[k] < self.firsts[k + 1]:
                at = Coded(map_arrays(self.path("words", k)), "hash").find(hashes[rows] & np.uint64((1 << self.shift) - 1))
                out[rows] = np.where(at >= 0, at + self.firsts[k], -1)
        return out

    def figures(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ids (-1: unknown): count, first part of the pairs they begin, number of parts those are cut over."""
        counts, part, width = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64), np.ones(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        for k, rows in _by_part(np.searchsorted(self.firsts, ids[known], side="right") - 1):
            at, ends = ids[known[rows]] - self.firsts[k], Coded(map_arrays(self.path("words", k)), "before")
            before, after = ends.get(at) + self.totals[k], ends.get(at + 1) + self.totals[k]
            counts[known[rows]] = after - before
            part[known[rows]] = before * self.n_parts // self.info["n"]
            wide = (after - before) * self.n_parts > self.info["n"]  # more than a part's share
            width[known[rows]] = np.where(wide, (after - 1) * self.n_parts // self.info["n"] - part[known[rows]] + 1, 1)
        return counts, part, width

    def pairs(self, part: np.ndarray, width: np.ndarray, u: np.ndarray, v: np.ndarray, weights: bool) -> dict[str, np.ndarray]:
        """Different queries (u, v), sorted, of known words (v may be -1), with the parts of u: part, place in it (-1), rank
        among the followers of u; with weights also a, g(u), g(uv)."""
        n, size = len(u), self.info["v"]
        which = np.maximum(v, 0) % width
        out = {"part": part + which, "at": np.full(n, -1, np.int64), "rank": np.full(n, -1, np.int64)}
        if weights:
            out |= {"a": np.zeros(n), "g1": np.ones(n), "g2": np.ones(n)}
        for k, rows in _by_part(out["part"]):
            a = map_arrays(self.path("pairs", k))
            heads, start = Coded(a, "head"), Coded(a, "start")
            if not heads.n:
                continue
            first, back = _runs_of(u[rows])  # each head is looked up once
            head = heads.find(u[rows[first]])
            known = np.maximum(head, 0)
            lo, hi = (np.where(head >= 0, start.get(known + d), 0)[back] for d in (0, 1))
            if weights:
                out["g1"][rows] = np.where(head >= 0, dequantise(a, "g", known), 1.0)[back]
            seen = np.flatnonzero((hi > lo) & (v[rows] >= 0))
            at = Coded(a, "pair").find(head[back[seen]] * size + v[rows[seen]], lo[seen], hi[seen])
            hit = np.flatnonzero(at >= 0)
            there, rank = rows[seen[hit]], at[hit] - lo[seen[hit]]
            out["at"][there], out["rank"][there] = at[hit], rank * width[there] + which[there]
            if weights:
                out["a"][there] = dequantise(a, "a", at[hit])
                if self.info["triples"]:
                    out["g2"][there] = dequantise(map_arrays(self.path("triples", k)), "g", at[hit])
        if weights and len(self.cut):  # a head cut over parts has one weight for all
            at = np.minimum(np.searchsorted(self.cut, u), len(self.cut) - 1)
            out["g1"] = np.where(self.cut[at] == u, self.cut_g[at], out["g1"])
        return out

    def triples(self, k: int, key: np.ndarray) -> np.ndarray:
        """a of the different triples of a part, sorted, named by place of the pair * fan + rank of the last word."""
        a, pair = map_arrays(self.path("triples", k)), key // self.info["fan"]
        first, back = _runs_of(pair)
        lo, hi = (Coded(a, "start").get(pair[first] + d)[back] for d in (0, 1))
        at = Coded(a, "triple").find(key, lo, hi)
        return np.where(at >= 0, dequantise(a, "a", np.maximum(at, 0)), 0.0) if Coded(a, "triple").n else np.zeros(len(key))


# --- text in chunks --------------------------------------------------------------------------------


def _word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data (bytes) begin, and their hashes; no word crosses a break.

    A word is a polynomial in an odd number over a table of random values of its lower-cased bytes.
    Running sums give all words at once; data goes in slices that end at a word's end.
    """
    gap = _SPACE[data]
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = ~gap[inner]
    last[inner - 1] = ~gap[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _SLICE, side="right")))
        up, down = _powers(int(ends[j - 1] - at))
        sums = np.append(np.uint64(0), np.cumsum(_VALUES[data[at : ends[j - 1]]] * up))
        out[i:j] = mix((sums[ends[i:j] - at] - sums[starts[i:j] - at]) * down[starts[i:j] - at] + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return starts, out


@functools.lru_cache(maxsize=4)
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2^64."""
    up, down = _powers_to(_SLICE if n <= _SLICE else 1 << n.bit_length())
    return up[:n], down[:n]


def _raw(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column without nulls: its data as numbers of a kind, and where the rows begin and end in them."""
    _, offsets, data = column.buffers()
    wide = "<i8" if pa.types.is_large_binary(column.type) else "<i4"
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data if data is not None else b"", np.uint8)[ends[0] : ends[-1]].view(kind), (ends - ends[0]) // size


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Some documents at once: (doc_id, learn) of each, numbers of tokens, hashes of the words and an end for each."""
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_AT_ONCE):
            part = batch.slice(at, DOCS_AT_ONCE)
            data, ends = _raw(part.column("text").cast(pa.binary()), "u1")
            starts, found = _word_hashes(data, ends)
            sizes = np.diff(np.searchsorted(starts, ends))
            tokens = np.full(len(found) + len(sizes), END, np.uint64)
            tokens[np.arange(len(found)) + np.repeat(np.arange(len(sizes)), sizes)] = found
            yield list(zip(part.column("doc_id").to_pylist(), part.column("learn").to_pylist(), strict=True)), sizes + 1, tokens


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The same with ids for hashes."""
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_AT_ONCE):
            part = batch.slice(at, DOCS_AT_ONCE)
            ids, ends = _raw(part.column("ids").cast(pa.binary()), "<i4")
            yield list(zip(part.column("doc_id").to_pylist(), part.column("learn").to_pylist(), strict=True)), np.diff(ends), ids


def _chunks(pieces: Iterator[tuple]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Documents in chunks of about CHUNK_TOKENS tokens."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[2])
        if n >= CHUNK_TOKENS:
            yield [x for p in held for x in p[0]], np.concatenate([p[1] for p in held]), np.concatenate([p[2] for p in held])
            held, n = [], 0
    if n:
        yield [x for p in held for x in p[0]], np.concatenate([p[1] for p in held]), np.concatenate([p[2] for p in held])


def _grams(trie: Trie, sizes: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """The different words with their figures, and of each token: the place of its word and of the one before (the end stands before a text) there."""
    words, back = np.unique(np.append(ids.astype(np.int64), trie.info["end"]), return_inverse=True)
    counts, part, width = trie.figures(words)
    starts, w = np.cumsum(sizes) - sizes, back[:-1]
    u = np.roll(w, 1)
    u[starts] = back[-1]
    return {"words": words, "counts": counts, "part": part, "width": width, "w": w, "u": u, "starts": starts}


def _with_pairs(trie: Trie, g: dict[str, np.ndarray], weights: bool) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Figures of the different pairs, and of each token the place of its pair there. An unknown first word has no pair (at -1),
    an unknown second one takes its share of the first one's back-off mass."""
    n = len(g["words"])
    key, back = np.unique(g["u"] * n + g["w"], return_inverse=True)
    u, w = key // n, key % n
    known = g["words"][u] >= 0
    found = trie.pairs(g["part"][u[known]], g["width"][u[known]], g["words"][u[known]], g["words"][w[known]], weights)
    blank = {"part": -1, "at": -1, "rank": -1, "a": 0.0, "g1": 1.0, "g2": 1.0}
    out = {"u": u, "w": w}
    for k, x in found.items():
        out[k] = np.full(len(key), blank[k])
        out[k][known] = x
    return out, back


def _triples(trie: Trie, g: dict[str, np.ndarray], p: dict[str, np.ndarray], back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens whose two pairs are both in the trie: where, part of the first pair, number (place of the first pair, rank in the second)."""
    before = np.roll(back, 1)
    good = (p["at"][before] >= 0) & (p["rank"][back] >= 0)
    good[g["starts"]] = False
    where = np.flatnonzero(good)
    before = before[where]
    return where, p["part"][before], p["at"][before] * trie.info["fan"] + p["rank"][back[where]]


# --- counting --------------------------------------------------------------------------------------

_COUNTED = "part int, keys binary, counts binary"


def _squeeze(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    z = zstandard.ZstdCompressor(level=1)
    delta = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    return z.compress(delta.view(np.uint8).reshape(-1, 8).T.tobytes()), z.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _spread(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    z = zstandard.ZstdDecompressor()
    k = np.frombuffer(z.decompress(keys), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(k, dtype=np.uint64), np.frombuffer(z.decompress(counts), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal keys; keys ascending."""
    keys, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Tally:
    """Counts of (part, key) of a task, compacted as they come; sent on when there are many."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, part: np.ndarray, key: np.ndarray, times: np.ndarray | None = None) -> None:
        """Tokens, or different keys with times, sorted within a part."""
        for k, rows in _by_part(part):
            own = self.parts.setdefault(k, [])
            own.append(np.unique(key[rows].astype(np.uint64), return_counts=True) if times is None else (key[rows].astype(np.uint64), times[rows]))
            self.held += len(own[-1][0])
            if len(own) >= 8:
                self.held -= sum(len(x[0]) for x in own)
                self.parts[k] = [_add_up(own)]
                self.held += len(self.parts[k][0][0])

    def full(self) -> bool:
        return self.held >= TALLY_KEYS

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        for k, own in sorted(self.parts.items()):
            yield (k, *_squeeze(*_add_up(own)))
        self.parts, self.held = {}, 0


def _counts_batch(rows: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    for k, keys, counts in rows:
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([keys]), pa.array([counts])], names=["part", "keys", "counts"])


def _count_words(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, shift = _Tally(), np.uint64(64 - (n_parts.bit_length() - 1))
        for rows, sizes, hashes in _chunks(_hashed(batches)):
            learn = np.repeat([r[1] for r in rows], sizes)
            tally.add((hashes[learn] >> shift).astype(np.int64), hashes[learn])
            if tally.full():
                yield from _counts_batch(tally.rows())
        yield from _counts_batch(tally.rows())

    return run


_NUMBERED = f"{_COUNTED}, doc_id long, learn boolean, ids binary"
_NUMBERED_NAMES = [c.split()[0] for c in _NUMBERED.split(", ")]
_NUMBERED_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()]


def _number_words(info: dict):
    """Texts become ids, and pairs are counted on the way: rows of counts (with a part) and rows of documents."""

    def counts(rows: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True)] if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _NUMBERED_KINDS, strict=True)], names=_NUMBERED_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, trie = _Tally(), Trie(info)
        for rows, sizes, hashes in _chunks(_hashed(batches)):
            unique, back = np.unique(hashes, return_inverse=True)
            ids = trie.ids(unique)[back]
            offsets = pa.py_buffer(np.append(0, 4 * np.cumsum(sizes)).astype("<i4"))
            coded = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(ids.astype("<i4"))])
            blank = [pa.nulls(len(rows), k) for k in _NUMBERED_KINDS[:3]]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), coded], names=_NUMBERED_NAMES)
            g = _grams(trie, sizes, ids)
            own = np.flatnonzero(np.repeat([r[1] for r in rows], sizes))
            key, times = np.unique(g["u"][own] * len(g["words"]) + g["w"][own], return_counts=True)
            u, w = np.divmod(key, len(g["words"]))
            v = g["words"][w]
            tally.add(g["part"][u] + v % g["width"][u], g["words"][u] * info["v"] + v, times)
            if tally.full():
                yield counts([(*x, None, None, None) for x in tally.rows()])
        for x in tally.rows():
            yield counts([(*x, None, None, None)])

    return run


def _count_triples(info: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, trie = _Tally(), Trie(info)
        for _, sizes, ids in _chunks(_numbered(batches)):
            g = _grams(trie, sizes, ids)
            _, part, key = _triples(trie, g, *_with_pairs(trie, g, False))
            tally.add(part, key)
            if tally.full():
                yield from _counts_batch(tally.rows())
        yield from _counts_batch(tally.rows())

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows sorted by part: a part at a time, its keys with summed counts."""
    at, own = None, []
    for batch in batches:
        for part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts")), strict=True):
            if part != at and own:
                yield (at, *_add_up(own))
                own = []
            at = part
            own.append(_spread(keys, counts))
            if len(own) >= 16:
                own = [_add_up(own)]
    if own:
        yield (at, *_add_up(own))


_REPORT = "part int, n long, total long, fan long, heads array<long>, sums array<double>"


def _report(part: int, n: int, total: int = 0, fan: int = 0, heads: list[int] = (), sums: list[float] = ()) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (n, total, fan)), pa.array([list(heads)], pa.list_(pa.int64())), pa.array([list(sums)], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "n", "total", "fan", "heads", "sums"])


def _words_file(shift: int, keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    return ef_encode("hash", keys & np.uint64((1 << shift) - 1), 1 << shift) | ef_encode("before", np.append(0, np.cumsum(counts)), int(counts.sum()) + 1)


def _write_words(root: str, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 64 - (n_parts.bit_length() - 1)
        for part, keys, counts in _merged(batches):
            write_arrays(f"{root}/words-{part:05d}", _words_file(shift, keys, counts))
            yield _report(part, len(keys), counts.sum())

    return run


def _pairs_files(trie: Trie, keys: np.ndarray, counts: np.ndarray) -> tuple[dict, dict, np.ndarray, np.ndarray, np.ndarray]:
    """The arrays of a part's pairs and of their counts; its heads, their followers and the sums of a."""
    v, keys = trie.info["v"], keys.astype(np.int64)
    heads, start = np.unique(keys // v, return_index=True)
    fan = np.diff(np.append(start, len(keys)))
    place = np.repeat(np.arange(len(heads)), fan)
    a = (counts - DISCOUNT) / np.repeat(trie.figures(heads)[0], fan)
    sums = np.bincount(place, a, len(heads))
    coded = ef_encode("head", heads, max(v, 1)) | ef_encode("start", np.append(start, len(keys)), len(keys) + 1) | ef_encode("pair", place * v + keys % v, max(1, len(heads) * v))
    return coded | quantise("a", a) | quantise("g", 1 - sums), {"count": counts.astype(np.uint32)}, heads, fan, sums


def _write_pairs(info: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(info)
        for part, keys, counts in _merged(batches):
            arrays, own, heads, fan, sums = _pairs_files(trie, keys, counts)
            write_arrays(trie.path("pairs", part), arrays)
            write_arrays(trie.path("pair_counts", part), own)
            width = trie.figures(heads)[2]
            cut = width > 1  # at most a few heads a part
            yield _report(part, len(keys), counts.sum(), (fan * width).max(), heads[cut].tolist(), sums[cut].tolist())

    return run


def _triples_file(fan: int, pair_counts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    keys, n = keys.astype(np.int64), len(pair_counts)
    pair = keys // fan
    a = (counts - DISCOUNT) / pair_counts[pair]
    start = np.append(0, np.cumsum(np.bincount(pair, minlength=n)))
    coded = ef_encode("start", start, len(keys) + 1) | ef_encode("triple", keys, max(1, n * fan))
    return coded | quantise("a", a) | quantise("g", 1 - np.bincount(pair, a, n))


def _write_triples(info: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(info)
        for part, keys, counts in _merged(batches):
            pair_counts = map_arrays(trie.path("pair_counts", part))["count"].astype(np.int64)
            write_arrays(trie.path("triples", part), _triples_file(info["fan"], pair_counts, keys, counts))
            yield _report(part, len(keys), counts.sum())

    return run


def _gather(rows: DataFrame, n_parts: int, write) -> list:
    """Merge the counts of every part in one task each; the reports, a few numbers a part, come back."""
    return rows.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(write, _REPORT).collect()


def train(docs: DataFrame, root: str, n_docs: int) -> tuple[dict, DataFrame]:
    """Build the trie of docs (doc_id, text, learn) under root, from the rows that learn says: what Trie needs, and
    every row as (doc_id, learn, ids)."""
    root = shared_uri(docs.sparkSession, root)
    n_parts = 1 << (max(MIN_PARTS, n_docs // DOCS_A_PART) - 1).bit_length()
    none, no_counts = np.empty(0, np.int64), np.empty(0, np.int64)
    found = {r["part"]: r for r in _gather(docs.mapInArrow(_count_words(n_parts), _COUNTED), n_parts, _write_words(root, n_parts))}
    sizes, totals = ([found[k][c] if k in found else 0 for k in range(n_parts)] for c in ("n", "total"))
    info = {"root": root, "parts": n_parts, "v": sum(sizes), "n": sum(totals), "fan": 1, "triples": False, "end": -1}
    info |= {"firsts": np.append(0, np.cumsum(sizes)).tolist(), "totals": np.append(0, np.cumsum(totals)).tolist()}
    if info["v"]:
        info["end"] = int(Trie(info).ids(np.array([END], np.uint64))[0])
    numbered = materialize(docs.mapInArrow(_number_words(info), _NUMBERED), "numbered", "zstd")
    ids = numbered.filter("part is null").select("doc_id", "learn", "ids")
    if not info["v"]:
        return info, ids
    pairs = _gather(numbered.filter("part is not null").select("part", "keys", "counts"), n_parts, _write_pairs(info))
    trie = Trie(info)
    for k in set(range(n_parts)) - {r["part"] for r in pairs}:  # parts without a word
        arrays, own, *_ = _pairs_files(trie, none, no_counts)
        write_arrays(trie.path("pairs", k), arrays)
        write_arrays(trie.path("pair_counts", k), own)
    spread: dict[int, float] = {}
    for r in pairs:
        for u, x in zip(r["heads"], r["sums"], strict=True):
            spread[u] = spread.get(u, 0.0) + x
    info |= {"fan": max(r["fan"] for r in pairs), "cut": sorted(spread), "cut_g": [1 - spread[u] for u in sorted(spread)]}
    triples = _gather(ids.filter("learn").mapInArrow(_count_triples(info), _COUNTED), n_parts, _write_triples(info))
    for k in set(range(n_parts)) - {r["part"] for r in triples}:  # parts without a triple: every weight is 1
        n = len(map_arrays(trie.path("pair_counts", k))["count"])
        write_arrays(trie.path("triples", k), _triples_file(info["fan"], np.ones(n, np.int64), none, no_counts))
    return info | {"triples": True}, ids


def token_probabilities(trie: Trie, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every token: its count in training, its probability."""
    info = trie.info
    if not info["v"]:
        return np.zeros(len(ids), np.int64), np.ones(len(ids))
    g = _grams(trie, sizes, ids)
    p, back = _with_pairs(trie, g, True)
    c = g["counts"]
    p1 = np.where(c > 0, c - DISCOUNT, DISCOUNT * info["v"]) / info["n"]
    p2 = p["a"] + p["g1"] * p1[p["w"]]
    back_off = np.roll(p["g2"][back], 1)
    back_off[g["starts"]] = 1.0
    out = back_off * p2[back]
    where, part, key = _triples(trie, g, p, back)
    for k, rows in _by_part(part):
        unique, own = np.unique(key[rows], return_inverse=True)
        out[where[rows]] += trie.triples(k, unique)[own]
    return c[g["w"]], out


def _score(info: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(info)
        scale = np.log10(info["n"] + 0.1 * (info["v"] + 1))
        for rows, sizes, ids in _chunks(_numbered(batches)):
            c, p = token_probabilities(trie, sizes, ids)
            starts = np.cumsum(sizes) - sizes
            base = np.add.reduceat(np.log10(c + 0.1) - scale, starts)
            known = np.add.reduceat((c > 0).astype(np.int64), starts)
            score = np.add.reduceat(np.log10(p), starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(np.full(len(rows), info["n"], np.int64)), pa.array(base), pa.array(score)],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from rows that are not held out (a null doc_id is never held out). Null and empty texts
    are the end token alone. Repeated rows count each in training. Without training rows every known
    count is 0 and every score 0. An empty table gives an empty result; other columns are ignored.
    """
    source = docs.select("doc_id", text_or_empty().alias("text"), (~held_out(0, 10)).alias("learn"))
    info, ids = train(source, scratch_path(docs.sparkSession, "lm"), source.filter("learn").count())
    scored = ids.mapInArrow(_score(info), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select("doc_id", held_out(0, 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
