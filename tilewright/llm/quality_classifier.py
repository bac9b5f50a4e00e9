"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed inside Arrow batches. Trees are grown on a bounded sample of labelled rows
and flattened into arrays of perfect binary trees, which numpy walks for a whole batch at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import text_or_empty
from tilewright.llm.minhash import WordHashes

#: At most about so many labelled rows (chosen by a hash of doc_id) are fitted; it bounds what the driver gathers.
MAX_TRAIN = 40_000
ROUNDS, DEPTH, BINS, RATE, RIDGE = 60, 5, 64, 0.15, 1.0
THRESHOLD = 0.7
FEATURES = (
    "log_words log_bytes mean_word std_word max_word unique_words repeat_pairs repeat_triples upper lower digit space newline symbol exclaim comma stop other_ascii high entropy "
    "log_lines repeat_lines mean_line short_words lines_end top_word"
).split()
_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "newline": (10, 13), "symbol": b"#*$%&|<>", "exclaim": b"!?", "comma": b",;:", "stop": b".", "high": range(128, 256),
}


def _group_matrix() -> np.ndarray:
    out = np.zeros((256, len(_GROUPS) + 1))
    for k, codes in enumerate(_GROUPS.values()):
        out[list(codes), k] = 1
    out[:, -1] = out.sum(axis=1) == 0
    return out


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; an empty text is a row of zeros."""
    hashes, groups, out = WordHashes(), _group_matrix(), np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        share = counts / len(text)
        parts = share @ groups
        seen = share[share > 0]
        h = hashes.of(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        _, times = np.unique(h, return_counts=True)
        pairs = h[:-1] * np.uint64(3) + h[1:]
        triples = pairs[:-1] * np.uint64(5) + h[2:]
        lines = [x for x in text.split(b"\n") if x.strip()]
        n = len(words)
        out[i] = (
            math.log(n), math.log(len(text)), lengths.mean(), lengths.std(), lengths.max(), len(times) / n,
            1 - len(np.unique(pairs)) / max(1, n - 1), 1 - len(np.unique(triples)) / max(1, n - 2),
            *(parts[k] for k in range(9)), parts[-1], parts[9], -(seen * np.log(seen)).sum(),
            math.log(len(lines)), 1 - len(set(lines)) / len(lines), len(text) / len(lines), (lengths <= 3).mean(),
            sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), times.max() / n,
        )
    return out


@dataclass
class Forest:
    """Perfect binary trees of one depth: inner nodes in level order, then leaf values."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2**depth)
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        depth = self.value.shape[1].bit_length() - 1
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (len(value) - 1)]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE) -> Forest:
    """Boosting with the logistic loss on quantile bins; splits by gain over gradient histograms."""
    n, f = x.shape
    inner = (1 << depth) - 1
    if not n or y.min() == y.max():
        p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), math.log(p / (1 - p)))
    cuts = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0)  # (bins - 1, f)
    code = np.stack([np.searchsorted(cuts[:, k], x[:, k], side="left") for k in range(f)], axis=1)
    flat = code + np.arange(f) * bins
    p = y.mean()
    start = math.log(p / (1 - p))
    total = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-total))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        feature, threshold, split = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = (((node - first) * (f * bins))[:, None] + flat).ravel()
            shape = (width, f, bins)
            gs = np.bincount(at, np.repeat(g, f), width * f * bins).reshape(shape).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, f), width * f * bins).reshape(shape).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[(hs < 1) | (ha - hs < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                c, b = divmod(int(best[k]), bins)
                if gain[k, c, b] > 1e-6 and b < bins - 1:
                    feature[first + k], threshold[first + k], split[first + k] = c, cuts[b, c], b
            node = 2 * node + 1 + (code[np.arange(n), feature[node]] > split[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), start)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text").cast(pa.binary()).to_pylist()).astype(np.float32)
        ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], names=["quality", "x"])


def _scored(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text").cast(pa.binary()).to_pylist()).astype(np.float32).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(forest.scores(x))], names=["doc_id", "score"])

    return run


def held_out(part: int = 2, parts: int = 4):
    """Whether a row's doc_id, as text, falls into the part that is never learned from; a null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Forest:
    """Learn labels.quality from rows that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))  # the least of several labels
    share = min(1.0, max_train / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id").select("quality", "text")
    rows = sample.mapInArrow(_measured, "quality int, x array<float>").toPandas()
    x = np.stack(rows["x"].to_numpy()).astype(float) if len(rows) else np.zeros((0, len(FEATURES)))
    y = rows["quality"].to_numpy(float)
    order = np.lexsort((y, *x.T[::-1])) if len(rows) else np.zeros(0, int)  # independent of the order of tasks
    return fit_forest(x[order], y[order])


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Only the text is an input of the score. Null and empty texts are scored as rows of zeros.
    Without labelled rows every score is 0.5; with labels of one kind, near that kind. Repeated rows
    score alike; an empty table gives an empty result; other columns of docs are ignored.
    """
    forest = train(docs, labels, max_train)
    scored = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_scored(forest), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
