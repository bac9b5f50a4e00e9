"""Source divergence audit: how the sources of each language differ in their words.

Words are counted inside tasks, a bounded table at a time, and Spark sums the tables. Each kept term
then becomes a wide vector, an array of counts by the language's sources; smoothed shares are whole
numbers in billionths. Higher-order functions turn a vector into the differences of its pairs of
sources, one source after the other, so a row never holds more than one array; the sums over all terms
are partial on the map side. All arithmetic is in whole numbers.

Counting in DataFrame expressions (split, translate, array_distinct, explode) gives the same but took
some 750 CPU seconds a GB on check_s, over the 600 of the check tool.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import materialize

MIN_DOCUMENTS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
#: The arrays of all languages are broadcast up to so many (lang, source) groups, some 100 MB; beyond, an ordinary join whose hot language is split.
BROADCAST_GROUPS = 1_000_000
#: A task hands its counts on when it holds so many terms, and reads a text in slices of so many bytes.
TABLE_TERMS = 400_000
SLICE_BYTES = 1 << 20
#: Letters and bytes from 0x80 on stay, A-Z in lower case; every other byte parts terms.
_BYTES = bytes(b if b >= 0x80 or chr(b) in string.ascii_lowercase else b + 32 if chr(b) in string.ascii_uppercase else 0x20 for b in range(256))


def slices_of(text: bytes, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    text, at = text.translate(_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in counts.items():
            if n:
                yield pa.record_batch({"lang": pa.repeat(lang, len(n)), "source": pa.repeat(source, len(n)), "term": pa.array(list(n), pa.binary()).cast(pa.string()), "n": pa.array(n.values(), pa.int64()), "documents": pa.array([documents[t] for t in n], pa.int64())})
        counts.clear()

    for batch in batches:
        langs, sources, texts = (batch.column(c) for c in ("lang", "source", "text"))
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts.cast(pa.binary()), strict=True):
            n, documents = counts.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in slices_of(text.as_py()):
                n.update(terms)
                seen.update(terms)
            documents.update(seen)
        if sum(len(n) for n, _ in counts.values()) > TABLE_TERMS:
            yield from handed()
    yield from handed()


def _share(count: Column, total: Column, kept: Column, smoothing: int) -> Column:
    """1 + floor(UNIT * (count + smoothing) / (total + smoothing * kept)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(count + smoothing), wide(total + kept * smoothing))


def wide_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, by_source (map of source to occurrences), total: the terms in at least min_documents documents of the language."""
    parts = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, documents long")
    parts = parts.repartition("lang", "term")  # for both groupings; a term comes once a table and source, so no key is hot
    sides = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    by_source = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    terms = sides.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("total"), by_source.alias("by_source"))
    return terms.filter(F.col("documents") >= min_documents).select("lang", "term", "by_source", "total")


def _languages(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row a language: its sources in order, their totals over kept terms in the same order, the language's total and number of kept terms."""
    totals = terms.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["n"])
    rows = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"), F.sum("n").alias("lang_total"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    return rows.join(sizes, "lang", "left").select("lang", F.col("g.source").alias("sources"), F.col("g.n").alias("totals"), "lang_total", F.coalesce("kept", F.lit(0)).alias("kept"))


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit_sources(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, smoothing: int = SMOOTHING, top_terms: int = TOP_TERMS, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank.

    `pair`: every other source of the language by the summed difference of the shares of all kept
    terms. `term`: the terms a source uses more than its language does, the first top_terms. Null
    text, lang and source count as ''; other columns are not read. A document without terms still
    makes its group; a language without kept terms gives 0 for all its pairs; a language of one source
    has no pairs. Repeated rows count each. Equal values are ordered by the item's bytes. An empty
    table gives an empty result.
    """
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    terms = materialize(wide_terms(clean, min_documents), "terms")
    languages = materialize(_languages(clean, terms), "languages")
    n_groups = languages.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0]
    counts = F.transform("sources", lambda s: F.coalesce(F.element_at("by_source", s), F.lit(0)))
    vectors = terms.join(F.broadcast(languages) if n_groups <= broadcast_groups else languages, "lang").withColumn("counts", counts)
    vectors = vectors.withColumn("shares", F.zip_with("counts", "totals", lambda c, n: _share(c, n, F.col("kept"), smoothing)))
    return _ranked(_pairs(vectors, languages), "pair").unionByName(_ranked(_leading(vectors, smoothing), "term").filter(F.col("rank") <= top_terms))


def _pairs(vectors: DataFrame, languages: DataFrame) -> DataFrame:
    """The summed differences of all pairs of sources of a language, in both directions; languages adds a 0 to each pair."""
    first = F.explode(F.sequence(F.lit(0), F.size("sources") - 2)).alias("i")
    later = lambda values: F.expr(f"slice({values}, i + 2, size(sources))")
    several = F.size("sources") > 1
    differ = F.transform(later("shares"), lambda p: F.abs(p - F.get("shares", F.col("i"))))
    parts = vectors.filter(several).select("lang", "sources", "shares", first).select("lang", "i", F.posexplode(differ).alias("k", "value"))
    zeros = languages.filter(several).select("lang", "sources", first).select("lang", "i", F.posexplode(F.transform(later("sources"), lambda _: F.lit(0).cast("long"))).alias("k", "value"))
    sums = parts.unionByName(zeros).groupBy("lang", "i", F.expr("i + 1 + k").alias("j")).agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("i").alias("own"), F.col("j").alias("other")), F.struct(F.col("j").alias("own"), F.col("i").alias("other")))).alias("p"))
    names = languages.select("lang", F.posexplode("sources").alias("at", "name"))
    own = names.select("lang", F.col("at").alias("own"), F.col("name").alias("source"))
    other = names.select("lang", F.col("at").alias("other"), F.col("name").alias("item"))
    return both.select("lang", "value", "p.own", "p.other").join(own, ["lang", "own"]).join(other, ["lang", "other"]).select("lang", "source", "item", "value")


def _leading(vectors: DataFrame, smoothing: int) -> DataFrame:
    """Terms whose share in a source that has them is above the language's."""
    whole = vectors.withColumn("q", _share(F.col("total"), F.col("lang_total"), F.col("kept"), smoothing))
    entries = whole.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "counts", "shares")).alias("e"))
    above = entries.filter((F.col("e.counts") > 0) & (F.col("e.shares") > F.col("q")))
    return above.select("lang", F.col("e.sources").alias("source"), F.col("term").alias("item"), (F.col("e.shares") - F.col("q")).alias("value"))
