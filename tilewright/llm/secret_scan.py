"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds what they miss.

The field tags every token of every text as a secret's begin, its inside, or outside. It is learned
from texts in which the patterns found something (their values are the secrets) and from texts in which
they found nothing, a bounded sample by hash. Its features are a token's shape (length, kinds of
characters, how often they change, hexadecimal or not), the words around it and figures of the whole
text; the words around it are hidden in half of the windows, so that a secret is known by its shape
under other names too. Rows are independent: no text leaves its task but the sample's feature numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import chain_field as chain
from tilewright.llm.common import own_columns, text_or_empty

KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Without one of these, in lower case, there is no assignment.
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

#: The field is fitted on about so many documents, chosen by hash over the whole table; a window each, so the driver gets at most some 50 MB.
SAMPLE_DOCUMENTS = 20_000
#: Of the sampled texts without a pattern's match one in so many gives a window.
CLEAN_SHARE = 8
WINDOW, MARGIN = 48, 16
#: Texts are tagged so many bytes at a time, a longer one alone; its bytes are read in slices of as many.
GROUP_BYTES = 2 << 20

_SPACE, _LOWER, _UPPER, _DIGIT, _JOIN, _HIGH, _SIGN = range(7)
_CLASS = np.array([_SPACE if b in b" \t\n\v\f\r" else _LOWER if 97 <= b < 123 else _UPPER if 65 <= b < 91 else _DIGIT if 48 <= b < 58 else _JOIN if b in b"_-+/" else _HIGH if b >= 128 else _SIGN for b in range(256)], np.uint8)
_SMALL = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint32) + 1
_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_POWERS = np.cumprod(np.full(64, 2654435761, np.uint32), dtype=np.uint32)
_HASHED = 1 << 12
_LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
_COARSE = np.array([4, 8, 16, 32])
#: What is no shorter is long: some features tell long tokens apart by nothing but this, so that other lengths than those learned are known too.
LONG = 16
_TENTHS = np.array([0.0, 0.1, 0.2, 0.35, 0.5, 0.75, 0.999])
#: Templates and the number of their values; the words around come last.
TEMPLATES = {"bias": 1, "length": 16, "kinds": 64 * 8, "digits": 8 * 8, "changes": 8 * 8, "hexadecimal": 16, "long kinds": 128, "long digits": 16, "long changes": 16, "long hexadecimal": 4, "sign": 256, "file": 64, "word": _HASHED, "before": _HASHED, "second": _HASHED, "third": _HASHED, "after": _HASHED}
_OFFSETS = dict(zip(TEMPLATES, np.cumsum([0, *TEMPLATES.values()]).tolist(), strict=False))
N_FEATURES = sum(TEMPLATES.values())
AROUND = slice(list(TEMPLATES).index("before"), None)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the patterns' matches, in order."""
    found = []
    small = text.encode().lower()
    if any(w in small for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if b"akia" in small:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


@dataclass
class Tokens:
    """Tokens of texts laid end to end: runs of letters, digits, _-+/ and non-ASCII; any other sign is one of its own."""

    doc: np.ndarray  # number of the text
    start: np.ndarray  # code points in the text
    end: np.ndarray
    length: np.ndarray
    kinds: np.ndarray
    digits: np.ndarray
    hexes: np.ndarray
    changes: np.ndarray
    sign: np.ndarray
    word: np.ndarray


def _slices(data: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield at, data[at:end]
        at = end


def _tokens_of(data: bytes, doc: int, points: int) -> tuple[dict[str, np.ndarray], int]:
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    in_word = (kind != _SPACE) & (kind != _SIGN)
    joined = np.zeros(len(raw), bool)
    joined[1:] = in_word[1:] & in_word[:-1]
    filled = kind != _SPACE
    heads = np.flatnonzero(filled & ~joined)
    point = points + np.cumsum((raw & 0xC0) != 0x80)
    new_points = int(point[-1])
    if not len(heads):
        return {}, new_points
    owner = np.cumsum(filled & ~joined)[filled] - 1
    length = np.bincount(owner, minlength=len(heads))
    per = lambda flags: np.add.reduceat(flags, heads, dtype=np.int32)
    place = np.arange(len(raw))[filled] - heads[owner]
    parts = np.zeros(len(raw), np.uint32)
    parts[filled] = _SMALL[raw[filled]] * _POWERS[np.minimum(place, 63)]
    changed = np.zeros(len(raw), bool)
    changed[1:] = joined[1:] & (kind[1:] != kind[:-1])
    masks = np.where(filled, np.uint8(1) << (np.maximum(kind, 1) - 1).astype(np.uint8), 0).astype(np.uint8)
    word = np.add.reduceat(parts, heads, dtype=np.uint32)
    word ^= word >> np.uint32(15)
    return {
        "doc": np.full(len(heads), doc, np.int32), "start": (point[heads] - 1).astype(np.int64), "end": point[heads + length - 1].astype(np.int64), "length": length.astype(np.int32),
        "kinds": np.bitwise_or.reduceat(masks, heads), "digits": per(kind == _DIGIT), "hexes": per(_HEX[raw]), "changes": per(changed),
        "sign": np.where(kind[heads] == _SIGN, raw[heads], 0).astype(np.uint8), "word": (word * np.uint32(2246822519) >> np.uint32(20)).astype(np.int32),
    }, new_points


def tokens_of(texts: list[str], slice_bytes: int = GROUP_BYTES) -> Tokens:
    parts: list[dict[str, np.ndarray]] = []
    for doc, text in enumerate(texts):
        points = 0
        for _, data in _slices(text.encode(), slice_bytes):
            found, points = _tokens_of(data, doc, points)
            if found:
                parts.append(found)
    names = Tokens.__dataclass_fields__
    return Tokens(**{n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in names})


def features(t: Tokens, n_docs: int) -> Iterator[np.ndarray]:
    """For each template the tokens' rows of the weight table."""
    n = len(t.doc)
    coarse = np.searchsorted(_COARSE, t.length)
    exact = np.searchsorted(_LENGTHS, t.length)
    long = (t.length >= LONG).astype(np.int32)
    tenth = lambda part: np.searchsorted(_TENTHS, part / np.maximum(t.length, 1))
    per_doc = np.maximum(np.bincount(t.doc, minlength=n_docs), 1)
    signs = np.searchsorted([0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5], np.bincount(t.doc, t.sign > 0, n_docs) / per_doc)
    size = np.minimum(np.log2(per_doc).astype(int) // 2, 7)

    def beside(step: int) -> np.ndarray:
        """The word so many tokens away in the same text, 0 beyond its ends."""
        out = np.zeros(n, np.int32)
        if abs(step) < n:
            here, there = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
            out[here] = np.where(t.doc[here] == t.doc[there], t.word[there], 0)
        return out

    found = {
        "bias": np.zeros(n, np.int32), "length": exact, "kinds": t.kinds.astype(np.int32) * 8 + coarse, "digits": tenth(t.digits) * 8 + coarse, "changes": tenth(t.changes) * 8 + coarse,
        "hexadecimal": np.where(t.hexes == t.length, exact, 15), "long kinds": t.kinds * np.int32(2) + long, "long digits": tenth(t.digits) * 2 + long, "long changes": tenth(t.changes) * 2 + long,
        "long hexadecimal": (t.hexes == t.length) * 2 + long, "sign": t.sign.astype(np.int32), "file": (signs * 8 + size)[t.doc] if n else t.doc,
        "word": np.where(t.digits == 0, t.word, 0), "before": beside(-1), "second": beside(-2), "third": beside(-3), "after": beside(1),
    }
    for name in TEMPLATES:
        yield _OFFSETS[name] + found[name]


def _window(text: str, pick: int) -> tuple[bytes, bytes] | None:
    """A window of a text's tokens: their features and tags; around one of the patterns' values if there is one, else around any token or the longest."""
    spans = base_spans(text)
    t = tokens_of([text])
    n = len(t.doc)
    if not n or not spans and pick // 7 % CLEAN_SHARE:
        return None
    tags = np.zeros(n, np.int32)
    for _, _, end, value in spans:
        at = np.flatnonzero((t.start >= value) & (t.end <= end) & (tags == 0))
        tags[at] = chain.INSIDE
        tags[at[:1]] = chain.BEGIN
    begins = np.flatnonzero(tags == chain.BEGIN)
    middle = int(begins[pick % len(begins)]) if len(begins) else int(t.length.argmax()) if pick % 2 else pick % n  # long words are learned as none
    low = max(0, middle - MARGIN)
    while low and tags[low] == chain.INSIDE:
        low -= 1
    part = slice(low, low + WINDOW)
    return np.stack([f[part] for f in features(t, 1)], 1).astype(np.int32).tobytes(), tags[part].astype(np.uint8).tobytes()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [w for text, pick in zip(batch.column("text").to_pylist(), batch.column("pick").to_pylist(), strict=True) if (w := _window(text, pick))]
        yield pa.record_batch({"features": pa.array([f for f, _ in found], pa.binary()), "tags": pa.array([t for _, t in found], pa.binary())})


def fit_field(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> chain.Field | None:
    """A field fitted on windows of about sample_documents texts; None if the patterns find nothing in them."""
    n = docs.count()
    share = min(1.0, sample_documents / max(n, 1))
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    chosen = docs.select(text_or_empty().alias("text"), pick.alias("pick")).filter(F.col("pick") < int(share * (1 << 30)))
    rows = sorted((bytes(r["features"]), bytes(r["tags"])) for r in chosen.mapInArrow(_windows, "features binary, tags binary").collect())
    if not any(chain.BEGIN in t for _, t in rows):
        return None
    lengths = np.array([len(t) for _, t in rows])
    ids = np.full((len(rows), WINDOW, len(TEMPLATES)), N_FEATURES, np.int32)
    tags = np.zeros((len(rows), WINDOW), np.int64)
    for k, (f, t) in enumerate(rows):
        ids[k, : lengths[k]] = np.frombuffer(f, np.int32).reshape(-1, len(TEMPLATES))
        tags[k, : lengths[k]] = np.frombuffer(t, np.uint8)
    return chain.fit(ids, tags, lengths, N_FEATURES, AROUND)


def field_spans(texts: list[str], field: chain.Field | None) -> list[list[tuple[int, int]]]:
    """The spans that the field tags in each text, in code points."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if field is None:
        return out
    t = tokens_of(texts)
    if not len(t.doc):
        return out
    emit = np.zeros((len(t.doc), chain.N_TAGS), np.float32)
    for rows in features(t, len(texts)):
        emit += field.weights[rows]
    first = np.ones(len(t.doc), bool)
    first[1:] = t.doc[1:] != t.doc[:-1]
    tags = chain.viterbi(emit, first, field.start, field.step)
    begins = np.flatnonzero(tags == chain.BEGIN)
    stops = np.flatnonzero(np.append(tags, 0) != chain.INSIDE)
    for b, e in zip(begins, stops[np.searchsorted(stops, begins, "right")] - 1, strict=True):
        out[t.doc[b]].append((int(t.start[b]), int(t.end[e])))
    return out


def _scan(batches: Iterator[pa.RecordBatch], field: chain.Field | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        tagged: list[list[tuple[int, int]]] = []
        group: list[str] = []
        size = 0
        for text in [*texts, None]:
            if group and (text is None or size + len(text) > GROUP_BYTES):
                tagged += field_spans(group, field)
                group, size = [], 0
            if text is not None:
                group.append(text)
                size += len(text)
        counts: list[tuple[int, int, int]] = []
        digests, spans = [], []
        for text, more in zip(texts, tagged, strict=True):
            base = [(start, kind, end) for start, kind, end, _ in base_spans(text)]
            added = [(a, 3, b) for a, b in more if all(b <= start or end <= a for start, _, end in base)]
            counts.append(tuple(sum(kind == k for _, kind, _ in base) for k in range(3)))
            digests.append(hashlib.sha256(spelled(base).encode()).hexdigest())
            spans.append(spelled(base + added))
        made = [*[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        kept = [c for c in batch.schema.names if c != "_text"]
        yield pa.record_batch([*[batch.column(c) for c in kept], *made], names=[*kept, *MADE])


MADE = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def scan_secrets(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """docs without text, with n_assign, n_access, n_hex, base_sha256 and spans; one row per input row.

    spans lists the patterns' matches and those of the field that touch none of them, as
    kind:start:end in code points, the field's kind being `field`. Null and empty texts have none.
    Repeated rows are scanned alike. Where the sample has no match of a pattern there is nothing to
    learn from, and the field adds nothing. Columns of docs with the names made here are replaced; an
    empty table gives an empty result.
    """
    field = fit_field(docs, sample_documents)
    kept = [c for c in docs.columns if c != "text" and c not in MADE]
    rows, own = own_columns(docs.select(*kept, "text"))
    rows = rows.select(*[own[c] for c in kept], text_or_empty(own["text"]).alias("_text"))
    kinds = ", ".join(f"{own[c]} {docs.schema[c].dataType.simpleString()}" for c in kept)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # N_FEATURES rows of three numbers, some 260 KB
    found = rows.mapInArrow(lambda b: _scan(b, shared.value), f"{kinds}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.select(*[F.col(own[c]).alias(c) for c in kept], *MADE)
