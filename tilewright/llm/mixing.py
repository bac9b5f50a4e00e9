"""Soft-membership mixing of sources to target weights.

A classifier learned from the labelled table gives every document posteriors over domains. Rates
r(d) >= 0 are then fitted so that the expected domain token totals, the sums of r(d) tokens(d) p(k|d),
match the targets in the least-squares sense. Projected gradient steps run on the cluster: an
iteration needs one aggregate of as many numbers as there are domains, and a document's rate is a
fold over those few residuals, so no per-document state is kept between iterations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import materialize, own_columns, row_ids, text_or_empty, with_names
from tilewright.llm.minhash import WordHashes

DOMAINS = ("good", "toxic", "poor")
#: Shares of the tokens that should remain.
WEIGHTS = {"good": 0.94, "toxic": 0.03, "poor": 0.03}
N_BUCKETS = 1 << 14
MAX_LABELLED = 50_000
#: Word evidence saturates at so many words: posteriors stay soft for long documents.
EVIDENCE_WORDS = 40.0
MAX_STEPS, TOLERANCE = 40, 1e-3
#: After so many steps the rates are written, so that plans stay short.
STEPS_A_PLAN = 8


def domain_of() -> Column:
    """The domain that a row of labels (quality, toxic) belongs to; null if its labels are null."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def _counts(n_domains: int, n_buckets: int):
    """Per task: counts of word buckets by domain, and of documents (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, total, seen = WordHashes(), np.zeros((n_domains, n_buckets), np.int64), np.zeros(n_domains, np.int64)
        for batch in batches:
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                at = (words_of.of(text.lower().split()) % np.uint64(n_buckets)).astype(np.int64)
                total[k] += np.bincount(at, minlength=n_buckets)
                seen[k] += 1
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(k, np.arange(n_domains)).astype(np.int32)), pa.array(np.append(b, np.full(n_domains, -1)).astype(np.int32)), pa.array(np.append(total[k, b], seen))], names=["k", "bucket", "n"]
        )

    return run


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, n_buckets: int = N_BUCKETS, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Naive Bayes over hashed words: array (domain, n_buckets + 1) of log likelihoods, the last column log priors.

    labelled: (doc_id, domain). A hash of doc_id picks about max_labelled rows at most, which bounds
    the broadcast; null labels and ids are left out, and of several domains of one id the least counts.
    """
    ids = labelled.filter("doc_id is not null").filter(F.col("domain").isin(*domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = min(1.0, max_labelled / max(ids.count(), 1))
    ids = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    k = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int") - 1
    known = docs.join(F.broadcast(ids.select("doc_id", k.alias("k"))), "doc_id").select("k", text_or_empty().alias("text"))
    found = known.mapInArrow(_counts(len(domains), n_buckets), "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).collect()  # domains x buckets
    counts, priors = np.ones((len(domains), n_buckets)), np.ones(len(domains))
    for r in found:
        if r["bucket"] < 0:
            priors[r["k"]] += r["n"]
        else:
            counts[r["k"], r["bucket"]] += r["n"]
    return np.column_stack([np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(priors / priors.sum())])


def _posteriors(model: np.ndarray, evidence: float, keys: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, n_buckets = WordHashes(), model.shape[1] - 1
        table = np.ascontiguousarray(model[:, :-1].T)
        for batch in batches:
            tokens, out = [], np.empty((batch.num_rows, len(model)))
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = text.lower().split()
                at = (words_of.of(words) % np.uint64(n_buckets)).astype(np.int64)
                score = model[:, -1] + (table[at].sum(axis=0) * min(1.0, evidence / len(words)) if words else 0)
                p = np.exp(score - score.max())
                out[i] = p / p.sum()
                tokens.append(len(words) + 1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(model), dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(tokens, pa.int64()), flat], names=[*keys, "tokens", "p"])

    return run


def posteriors(docs: DataFrame, model: np.ndarray, evidence: float = EVIDENCE_WORDS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys (whole numbers), tokens (words and one end), p (array of posteriors in the model's order), one row per input row."""
    source = docs.select(*keys, text_or_empty().alias("text"))
    return source.mapInArrow(_posteriors(model, evidence, keys), "".join(f"{k} long, " for k in keys) + "tokens long, p array<double>")


def _rate(steps: list[list[float]], top: float | None) -> Column:
    """The projected steps from the rate written last: one nested expression over the residuals of the iterations since."""
    rate = F.col("rate")
    for g in steps:
        move = sum((F.get("p", F.lit(k)) * x for k, x in enumerate(g[1:], 1)), F.get("p", F.lit(0)) * g[0])
        rate = F.greatest(F.lit(0.0), rate - move)
        rate = rate if top is None else F.least(F.lit(float(top)), rate)
    return rate


def fit_rates(members: DataFrame, targets: list[float] | None = None, weights: list[float] | None = None, max_rate: float | None = 1.0, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict]:
    """members (doc_id, tokens, p) with a column rate, and a report of totals.

    Either targets (tokens by domain) or weights (shares) are given. With weights, the domain of the
    largest weight keeps its tokens and the others are held to their weight beside it; with max_rate 1
    no domain is asked for more than it has, so a scarce one stays whole and drags nothing down.
    A document's metric is its tokens, and residuals are whitened by
    the Gram matrix sum tokens p p', for which the step 1 / L is 1 exactly. While it lowers the misfit,
    the matrix is that of the documents at neither bound, which takes longer steps. The fit ends when
    every domain is within `tolerance` of its own goal, or where no step helps or moves the totals, or
    after max_steps; the report's `ended` says which (goal, stuck, steps), beside the goal and the totals
    reached. With max_rate, targets may be out of reach.
    """
    n = len(weights if targets is None else targets)
    base = members.withColumn("rate", F.lit(1.0))

    def measure(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Totals by domain, and the Gram matrix of the documents whose rate can still move."""
        rated = base.withColumn("rate", _rate(steps, max_rate))
        free = F.col("tokens") * (F.lit(1.0) if not taken + len(steps) else ((F.col("rate") > 0) & (F.lit(True) if max_rate is None else F.col("rate") < max_rate)).cast("double"))
        p = [F.get("p", F.lit(k)) for k in range(n)]
        row = rated.agg(
            *[F.coalesce(F.sum(F.col("tokens") * F.col("rate") * p[k]), F.lit(0.0)).alias(f"s{k}") for k in range(n)],
            *[F.coalesce(F.sum(free * p[i] * p[j]), F.lit(0.0)).alias(f"m{i}_{j}") for i in range(n) for j in range(i + 1)],
        ).first()
        return np.array([row[f"s{k}"] for k in range(n)]), np.array([[row[f"m{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)])

    taken = 0  # steps in the rates of base
    invert = lambda m: np.linalg.pinv(m, rcond=1e-9, hermitian=True)
    start, gram = measure([])
    total = float(start.sum())
    if targets is None:
        share = np.array(weights, float) / sum(weights)
        most = int(share.argmax())
        goal = share * (start[most] / share[most])
        goal = goal if max_rate is None or max_rate > 1 else np.minimum(goal, start)
    else:
        goal = np.array(targets, float)
    safe = invert(gram)
    miss = lambda x: float((x - goal) @ safe @ (x - goal))
    steps: list[list[float]] = []
    now, metric, near = start, safe, tolerance * np.maximum(goal, 1.0)
    met = lambda x: bool((np.abs(x - goal) <= near).all())
    stuck = not total
    while not stuck and taken + len(steps) < max_steps and not met(now):
        step = [float(x) for x in metric @ (now - goal)]
        new, free = measure([*steps, step])
        if miss(new) >= miss(now):
            stuck = metric is safe  # no step helps: the targets are out of reach
            metric = safe
            continue
        moved = np.abs(new - now)
        steps.append(step)
        now, metric = new, invert(free) if np.linalg.matrix_rank(free, hermitian=True) == n else safe
        stuck = bool((moved < near / 10).all()) and not met(now)
        if len(steps) == STEPS_A_PLAN:
            base, taken, steps = materialize(base.withColumn("rate", _rate(steps, max_rate)), "rates"), taken + len(steps), []
    return base.withColumn("rate", _rate(steps, max_rate)), {"start": start.tolist(), "goal": goal.tolist(), "reached": now.tolist(), "steps": taken + len(steps), "ended": "goal" if met(now) else "stuck" if stuck else "steps"}


#: Rates are counted in this part of one.
_UNIT = 1 << 20


def whole_copies(rated: DataFrame, key: str, tie: str) -> DataFrame:
    """rated (key, tie, tokens, p, rate) with copies, whole numbers whose totals meet those of the rates.

    Rows are put in order of their likeliest domain, then their tokens, then tie, and the rates are
    cumulated: a row has as many copies as whole numbers lie between the sums before and after it.
    Neighbours have nearly equal tokens, so in a domain the copies' tokens differ from the rates' by
    little more than its longest document. The order is dealt by ranges; a row for each range is all
    that is summed in one place.
    """
    domain = F.array_position("p", F.array_max("p"))
    order = ["_domain", "tokens", tie, key]
    ranged = rated.withColumn("_domain", domain).repartitionByRange(*order)
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_units", F.floor(F.col("rate") * _UNIT).cast("long"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # equal rows one after the other
    placed = materialize(placed.withColumn("_sum", F.sum("_units").over(inside)), "placed")
    sums = placed.groupBy("_part").agg(F.sum("_units").alias("_of"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_of").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + _UNIT // 2).drop("_of")
    counted = placed.join(F.broadcast(before), "_part")  # a row for each range
    whole = lambda c: F.floor(c / F.lit(_UNIT)).cast("long")
    after = F.col("_before") + F.col("_sum")
    return counted.withColumn("copies", whole(after) - whole(after - F.col("_units"))).drop("_domain", "_part", "_units", "_sum", "_before")


def _mixed(rows: DataFrame, labels: DataFrame, weights: dict[str, float], max_rate: float | None, key: str) -> DataFrame:
    """rows (key, doc_id, text), a row each: key, tokens, p, rate, copies."""
    domains = tuple(weights)
    whole = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))  # the worst of several labels
    labelled = whole.select("doc_id", domain_of().alias("domain")).dropna()
    model = fit_classifier(rows, labelled, domains)
    hashed = rows.withColumn("_tie", F.xxhash64("doc_id", "text"))
    members = materialize(posteriors(hashed, model, keys=(key, "_tie")), "members")
    if labelled.isEmpty():  # nothing tells the domains apart
        rated = members.withColumn("rate", F.lit(1.0))
    else:
        rated, _ = fit_rates(members, weights=[weights[d] for d in domains], max_rate=max_rate)
    return whole_copies(rated, key, "_tie").drop("_tie")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, max_rate: float | None = 1.0) -> DataFrame:
    """One row per input row: doc_id, tokens, p_<domain>, rate, copies.

    copies are whole numbers whose token totals meet those of the rates in every domain to within its
    longest document (`whole_copies`). Null and empty texts have one token (the end) and the prior as
    posteriors. Repeated rows have equal rates and are drawn each by itself, as are rows without a
    doc_id. Without labels all posteriors are equal and every rate is 1. An empty table gives an empty
    result; other columns of docs are ignored.
    """
    found = _mixed(docs.select("doc_id", text_or_empty().alias("text")), labels, weights, max_rate, "doc_id")
    return found.select("doc_id", "tokens", *[F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(weights)], "rate", "copies")


def drawn(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, max_rate: float | None = 1.0) -> DataFrame:
    """docs with every row as often as `copies` says, with all columns of docs, whatever their names.

    Null and empty texts count as one token; rows of one doc_id, or without one, are drawn each by
    itself. Without labels every row stays once; an empty table gives an empty result.
    """
    rows, own = own_columns(docs)
    rows = materialize(row_ids(rows, "_row"), "rows")
    found = _mixed(rows.select("_row", F.col(own["doc_id"]).alias("doc_id"), F.col(own["text"]).alias("text")), labels, weights, max_rate, "_row")
    joined = rows.join(found.filter("copies > 0").select("_row", "copies"), "_row")
    if max_rate is None or max_rate > 1:
        joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return with_names(joined, own)
