"""Passages of words that other documents have too, of whatever number of bytes.

Every window of `width` words is dealt by its anchor, as byte windows are in `suffix_dedup`: the run of
`ANCHOR_WORDS` words inside it with the least hash, the leftmost of equals. Neighbouring windows with one
anchor form a segment. Anchors that one document has alone cannot be shared; under the others the
windows are compared by 64-bit fingerprints of their words, so different windows of one anchor are
taken for equal with a probability of 5e-20 a pair. Words are compared as bytes, white space is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tilewright.llm.minhash import mix

WORDS = 50
ANCHOR_WORDS = 8
#: Documents with an anchor whose windows a task compares at once; windows under more common anchors are counted one by one.
COMMON = 4_000
#: Bytes or words that are hashed at once: a dozen arrays of eight bytes each, which a core's cache holds.
_SLICE = 1 << 17
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
#: Hashes of the bytes at the first 64 places of a word.
_NEAR = mix(np.arange(64 << 8, dtype=np.uint64) + np.uint64(_BASE))


def slide_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from prefix and suffix minima of blocks of w."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def word_hashes(t: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie side by side in t from `begins` on, and where the words start."""
    solid = ~((t == 32) | (t - np.uint8(9) < 5))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = begins[begins < len(t)]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    sums = np.zeros(len(starts), np.uint64)
    for at in range(0, len(t), _SLICE):
        stop = min(at + _SLICE, len(t))
        a, b = max(int(np.searchsorted(starts, at, "right")) - 1, 0), int(np.searchsorted(starts, stop))
        if a >= b:
            continue
        cuts = np.maximum(starts[a:b], at)
        place = np.arange(cuts[0], stop) - np.repeat(starts[a:b], np.diff(cuts, append=stop))
        place = place << 8 | t[cuts[0] : stop]
        h = _NEAR.take(place, mode="clip")  # of a byte and its place in the word
        far = np.flatnonzero(place >= len(_NEAR))
        h[far] = mix(place[far].astype(np.uint64) + np.uint64(_BASE))
        h[~solid[cuts[0] : stop]] = 0
        sums[a:b] += np.add.reduceat(h, cuts - cuts[0])
    return mix(sums), starts


def _neighbours(w: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` neighbours, from hashes of 1, 2, 4 ... of them."""
    n, out, have, part, size = len(w), None, 0, w, 1
    while True:
        by = np.uint64(pow(_BASE, size, 1 << 64))
        if width & size:
            m = n - have - size + 1
            out = part if out is None else out[:m] * by + part[have : have + m]
            have += size
        if have == width:
            return mix(out)
        part, size = part[:-size] * by + part[size:], 2 * size


def _groups(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a text column by some _SLICE bytes: first and last row, their bytes and where each begins in them (and the end)."""
    text = text.cast(pa.binary())
    if not len(text):
        return
    _, ends, data = text.buffers()
    ends = np.frombuffer(ends, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    cuts = [0, *(np.flatnonzero(np.diff((ends[:-1] - ends[0]) // _SLICE)) + 1).tolist(), len(text)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield a, b, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]


def _segments(t: np.ndarray, begins: np.ndarray, width: int, prints: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of texts side by side: text, anchor, first and last window (words before it in its text), and with
    `prints` the place of the first one among the windows' fingerprints, and these."""
    w, starts = word_hashes(t, begins[:-1])
    word_begins = np.searchsorted(starts, begins)
    text_of = np.repeat(np.arange(len(begins) - 1), np.diff(word_begins))
    k = min(ANCHOR_WORDS, width)
    for at in range(0, len(w) - width + 1, _SLICE):
        part, of = w[at : at + _SLICE + width - 1], text_of[at : at + _SLICE + width - 1]
        h = _neighbours(part, k)
        least = slide_min(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), width - k + 1) & _PLACE
        inside = np.flatnonzero(of[: len(least)] == of[width - 1 :])  # windows that lie in one text
        if not len(inside):
            continue
        least, of = least[inside], of[inside]
        new = np.flatnonzero((np.diff(least, prepend=_PLACE) != 0) | (np.diff(of, prepend=-1) != 0))
        end = np.append(new[1:], len(inside)) - 1
        text = of[new]
        lo, hi = (inside[x] + at - word_begins[text] for x in (new, end))
        yield text, h[least[new]].view(np.int64), lo, hi, *((inside[new], _neighbours(part, width)) if prints else ())


def anchors(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the anchors of a text column, each once a row."""
    rows, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, _, t, begins in _groups(text):
        for of, h, *_ in _segments(t, begins, width, False):
            order = np.lexsort((h, of))
            of, h = of[order], h[order]
            once = np.diff(of, prepend=-1) != 0
            once[1:] |= h[1:] != h[:-1]
            rows.append(of[once] + a)
            hashes.append(h[once])
    return np.concatenate(rows), np.concatenate(hashes)


def _pairs(lists: pa.ListArray, a: int, b: int) -> np.ndarray:
    """Keys of (row from a on, value) of lists a to b."""
    lists = lists.slice(a, b - a)
    return _key(np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False))


def _key(row: np.ndarray, *values: np.ndarray) -> np.ndarray:
    key = row.astype(np.uint64)
    for v in values:
        key = mix(key * np.uint64(_BASE) + v.astype(np.int64, copy=False).view(np.uint64))
    return key


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int64()))


WINDOWS = "did long, copies long, h long, lo array<long>, hi array<long>, prints array<long>"


def windows(width: int, common: bool):
    """Rows (did, copies, hs, common, text): a row for each different segment of a document whose anchor is in hs but not in common (or is
    in common): runs lo to hi of windows, and the fingerprints of the segment's windows, which the windows of a run go through in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, copies = (batch.column(c).to_numpy() for c in ("did", "copies"))
            for a, b, t, begins in _groups(batch.column("text")):
                told = [_pairs(batch.column(c), a, b) for c in ("hs", "common")]
                for of, h, lo, hi, first, prints in _segments(t, begins, width, True):
                    key = _key(of, h)
                    keep = np.flatnonzero(np.isin(key, told[1]) if common else np.isin(key, told[0]) & ~np.isin(key, told[1]))
                    if not len(keep):
                        continue
                    of, h, lo, hi, first = (x[keep] for x in (of, h, lo, hi, first))
                    size = hi - lo + 1
                    total = np.append(np.uint64(0), np.cumsum(prints))
                    same = _key(of, h, size, prints[first].view(np.int64), prints[first + size - 1].view(np.int64), (total[first + size] - total[first]).view(np.int64))
                    order = np.lexsort((lo, same))
                    of, h, lo, hi, first, size, same = (x[order] for x in (of, h, lo, hi, first, size, same))
                    row = np.diff(same, prepend=~same[:1]) != 0
                    apart = row.copy()  # a segment that does not follow the last one of its kind at once
                    apart[1:] |= lo[1:] != hi[:-1] + 1
                    new = np.flatnonzero(apart)
                    ends = hi[np.append(new[1:], len(hi)) - 1]
                    runs = np.bincount(np.cumsum(row)[new] - 1)
                    of, h, first, size = (x[row] for x in (of, h, first, size))
                    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                    columns = [pa.array(did[a + of]), pa.array(copies[a + of]), pa.array(h), _lists(lo[new], runs), _lists(ends, runs), _lists(prints[at].view(np.int64), size)]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WINDOWS.split(", ")])

    return run


RUNS = "did long, lo long, hi long"


def _runs_of_shared(group: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(group).combine_chunks()
    did, copies = (rows[c].to_numpy() for c in ("did", "copies"))
    lists = [rows[c].chunk(0) for c in ("prints", "lo", "hi")]
    size, runs = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists[:2])
    prints, lo, hi = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    order = np.argsort(prints, kind="stable")
    row = np.repeat(np.arange(len(size)), size)[order]
    new = np.flatnonzero(np.diff(prints[order], prepend=~prints[order][:1]) != 0)
    several = (np.minimum.reduceat(did[row], new) != np.maximum.reduceat(did[row], new)) | (np.maximum.reduceat(copies[row], new) > 1)
    shared = np.empty(len(prints), bool)
    shared[order] = np.repeat(several, np.diff(new, append=len(prints)))
    begin = np.cumsum(size) - size
    found = np.add.reduceat(shared.astype(np.int64), begin)
    run_row = np.repeat(np.arange(len(size)), runs)
    whole, part = (np.flatnonzero(x[run_row]) for x in (found == size, (found > 0) & (found < size)))
    length = hi[part] - lo[part] + 1
    run = np.repeat(part, length)
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    yes = shared[begin[run_row[run]] + place % size[run_row[run]]]
    run, place = run[yes], place[yes]
    cut = (np.diff(run, prepend=-1) != 0) | (np.diff(place, prepend=-2) != 1)
    last = np.append(np.flatnonzero(cut)[1:], len(cut)) - 1 if len(cut) else np.empty(0, np.int64)
    columns = [np.append(did[run_row[whole]], did[run_row[run[cut]]]), np.append(lo[whole], lo[run[cut]] + place[cut]), np.append(hi[whole], lo[run[cut]] + place[last])]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["did", "lo", "hi"])


def shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `windows` sorted by h: runs of windows that two documents have."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
        if held and (cut or held[-1].column("h")[0].as_py() != h[0]):
            yield _runs_of_shared([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield _runs_of_shared([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield _runs_of_shared(held)


COVERED = "did long, n_passages long, n_passage_words long"


def covered(width: int):
    """Rows (did, lo, hi as lists): maximal runs of words in shared windows, and the words in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("lo", "hi")]
            row = np.repeat(np.arange(batch.num_rows), lists[0].value_lengths().to_numpy(zero_copy_only=False))
            lo, hi = (x.flatten().to_numpy(zero_copy_only=False) + (row << 40) for x in lists)
            order = np.argsort(lo)
            lo, hi, row = lo[order], np.maximum.accumulate(hi[order]), row[order]
            new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1] + width)) if len(lo) else np.empty(0, np.int64)
            words = hi[np.append(new[1:], len(hi)) - 1] + width - lo[new] if len(lo) else new
            n = np.bincount(row[new], minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row[new], words)
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(n, pa.int64()), pa.array(total)], names=["did", "n_passages", "n_passage_words"])

    return run
