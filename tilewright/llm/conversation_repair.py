"""Repair of conversation structure by the cheapest edits that make the roles fit (s?(ua)+)?.

Rows are dealt and sorted by ranges of conversation and turn, so any conversation, however long, is
spread over as many tasks as its rows need. Each task streams its range. A conversation that lies
inside one range and has at most `max_rows` rows is repaired there and then (`role_grammar.repair`). The
first and the last of a range, which may go on in the next, and longer ones are written out as rows:
their blocks are searched apart, each block's ways from state to state are joined in order, and only
then the repaired rows are made, block by block, and hashed in order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import role_grammar as grammar
from tilewright.llm.common import materialize

#: Conversations of more rows or bytes of text are repaired by blocks.
MAX_ROWS = 2048
MAX_BYTES = 16 << 20
BLOCK_ROWS = 256
LEGAL = ("su", "ua", "au")
_NOT_SPACE = r"[^\x20\x09-\x0D]"
_SPACES = " \t\n\v\f\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32('conv_id:turn') % 20 deals: 0 drops a
    row, 1 empties its text, 2 takes its [.!?] out, 3 repeats it, 4 makes it the user's. A null counts
    as one space in the key and as role or text."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    once_or_twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), once_or_twice.alias("copy")).drop("copy")


def fault_of(text: str, seen: bool) -> str | None:
    kept = text.rstrip(_SPACES)
    return "blank" if not kept else "duplicate" if seen else "truncated" if kept[-1] not in ".!?" else None


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in pairwise(initials))


def repaired_lines(labels: str, start: int, rows: list[tuple[str, str]]) -> list[str]:
    left = grammar.given(labels, [role[:1] for role, _ in rows], start)
    return [f"{rows[row][0] if role is None else role}:{'' if row is None else rows[row][1]}" for role, row in left]


def repair_rows(rows: list[tuple[int | None, str, str]]) -> dict:
    """All results of one conversation from its (turn, role, text) in order."""
    seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        symbols.append(grammar.symbol(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = grammar.repair("".join(symbols))
    lines = repaired_lines(audit, 0, [(role, text) for _, role, text in rows])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return faults | {"gaps": gaps, "illegal": illegal_pairs([role[:1] for _, role, _ in rows]), "cost": cost, "audit": audit, "repaired_sha256": digest}


def _conversations(batches: Iterator[pa.RecordBatch], max_rows: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: results of the conversations that lie inside, rows (with part and pos) of the others."""
    names = ["conv_id", "turn", "role", "text", "part", "pos", *COUNTS, "audit", "repaired_sha256"]
    schema: pa.Schema | None = None
    out: list[dict] = []
    held: list[tuple] = []
    size, pos, first, apart, last_apart = 0, 0, True, False, None

    def put_apart() -> None:
        nonlocal pos
        for conv, turn, role, text, part in held:
            out.append({"conv_id": conv, "turn": turn, "role": role, "text": text, "part": part, "pos": pos})
            pos += 1
        held.clear()

    def flushed() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array([r.get(n) for r in out], schema.field(n).type) for n in names], names=names)
        out.clear()
        return batch

    for batch in batches:
        if schema is None:
            number, word = pa.int64(), pa.string()
            kinds = {"conv_id": batch.schema.field("conv_id").type, "turn": batch.schema.field("turn").type, "role": word, "text": word, "part": pa.int32(), "audit": word, "repaired_sha256": word}
            schema = pa.schema([(n, kinds.get(n, number)) for n in names])
        for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "part")], strict=True):
            if held and row[0] != held[0][0] or apart and row[0] != last_apart:
                if held and not first and not apart:
                    out.append({"conv_id": held[0][0]} | repair_rows([r[1:4] for r in held]))
                    held.clear()
                put_apart()
                size, first, apart = 0, False, False
            held.append(row)
            size += len(row[3])
            if len(held) > max_rows or size > max_bytes:
                last_apart, apart, size = row[0], True, 0
                put_apart()
            if len(out) >= 4096:
                yield flushed()
        if out:
            yield flushed()
    put_apart()
    if out:
        yield flushed()


def repair_conversations(rows: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of rows.

    Rows are taken by turn, nulls first; rows of one turn by role, then the text's first 64 characters,
    then its hash, so repeated rows stand side by side. A null role or text counts as one space; rows
    without a conv_id are one conversation; rows without a turn do not count for gaps. Texts may be of
    any length and conversations too (the audit of one is a cell, and its digest one stream). An empty
    table gives an empty result; other columns are not read.
    """
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), "row"]
    ranged = clean.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    number, word = T.LongType(), T.StringType()
    made = [T.StructField(c, number) for c in COUNTS] + [T.StructField("audit", word), T.StructField("repaired_sha256", word)]
    held = T.StructType([conv, T.StructField("turn", number), T.StructField("role", word), T.StructField("text", word), T.StructField("part", T.IntegerType()), T.StructField("pos", number), *made])
    streamed = ranged.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part")).mapInArrow(lambda b: _conversations(b, max_rows, max_bytes), held)
    streamed = materialize(streamed, "conversations")
    names = ["conv_id", *[f.name for f in made]]
    done = streamed.filter("part is null").select(*names)
    apart = streamed.filter("part is not null").select("conv_id", "turn", "role", "text", "part", "pos")
    return done.unionByName(_by_blocks(apart, conv, block_rows).select(*names))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys that may be null; the keys of a stay."""
    b = b.select(*[F.col(c).alias(f"_b_{c}" if c in keys else c) for c in b.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    return a.join(b, on, how).drop(*[f"_b_{k}" for k in keys])


def _symbols(initial: Column, must_go: Column, cut: Column) -> Column:
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(grammar.OTHER)
    return F.when(must_go, grammar.MUST_GO).when(cut, F.upper(known)).otherwise(known)


def _by_blocks(rows: DataFrame, conv: T.StructField, block_rows: int) -> DataFrame:
    """The same results for conversations whose rows (in the order of part and pos) lie in many tasks."""
    number, word, small = T.LongType(), T.StringType(), T.IntegerType()
    key = F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256)
    rows = rows.withColumn("key", key).withColumn("block", (F.col("pos") / block_rows).cast("long"))
    firsts = rows.groupBy("conv_id", "key").agg(F.min(F.struct("part", "pos")).alias("first"))
    blank = ~F.col("text").rlike(_NOT_SPACE)
    known = _same(rows, firsts, ["conv_id", "key"])
    faults = known.select(
        "conv_id", "turn", "part", "pos", "block", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
        (~blank & (F.struct("part", "pos") != F.col("first"))).alias("duplicate"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
    )
    cut = ~F.col("blank") & ~F.col("duplicate") & F.col("open")
    facts = materialize(faults.withColumn("truncated", cut).withColumn("symbol", _symbols(F.col("initial"), F.col("blank") | F.col("duplicate"), cut)).drop("open"), "facts")
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    turns = facts.groupBy("conv_id").agg(F.max("turn").alias("t1"), F.min("turn").alias("t0"), F.countDistinct("turn").alias("turns"), *[count(c) for c in ("blank", "duplicate", "truncated")])
    summary = turns.withColumn("gaps", F.coalesce(F.col("t1") - F.col("t0") + 1 - F.col("turns"), F.lit(0))).drop("t0", "t1", "turns")

    listed = F.sort_array(F.collect_list(F.struct("pos", "symbol", "initial")))  # block_rows entries at most
    blocks = facts.groupBy("conv_id", "part", "block").agg(listed.alias("l")).select("conv_id", "part", "block", F.array_join("l.symbol", "").alias("symbols"), F.col("l.initial").alias("initials"))
    ways_type = "array<struct<start:int,end:int,cost:long,labels:string>>"
    ways = F.udf(lambda s: [(a, b, c, labels) for (a, b), (c, labels) in grammar.block_ways(s).items()], ways_type)
    searched = materialize(blocks.select("conv_id", "part", "block", F.element_at("initials", 1).alias("head"), F.element_at("initials", -1).alias("tail"), _illegal(F.col("initials")).alias("illegal"), ways("symbols").alias("ways")), "ways")

    joined = T.StructType([conv, T.StructField("part", small), T.StructField("block", number), T.StructField("start", small), T.StructField("labels", word), T.StructField("illegal", number), T.StructField("cost", number), T.StructField("audit", word)])

    def join_blocks(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
        (cost, audit), states = grammar.follow([{(w["start"], w["end"]): (w["cost"], w["labels"]) for w in r["ways"]} for r in found])
        out = []
        for r, (start, end) in zip(found, states, strict=True):
            labels = next(w["labels"] for w in r["ways"] if (w["start"], w["end"]) == (start, end))
            out.append({"part": r["part"], "block": r["block"], "start": start, "labels": labels})
        used = sum(len(r["labels"]) for r in out)
        out.append({"part": 2**31 - 1, "block": 0, "start": states[-1][1], "labels": audit[used:]})  # insertions after the last row
        illegal = sum(r["illegal"] for r in found) + sum(a["tail"] + b["head"] not in LEGAL for a, b in pairwise(found))
        out.append({"illegal": illegal, "cost": cost, "audit": audit})
        names = ["part", "block", "start", "labels", "illegal", "cost", "audit"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        one = table.column("conv_id").combine_chunks().slice(0, 1)
        return pa.table([one.take(pa.array([0] * len(out))), *[pa.array([r.get(n) for r in out], k) for n, k in zip(names, kinds, strict=True)]], names=["conv_id", *names])

    found = materialize(searched.groupBy("conv_id").applyInArrow(join_blocks, joined), "joined")
    whole = found.filter("part is null").select("conv_id", "illegal", "cost", "audit")
    texts = rows.groupBy("conv_id", "part", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows"))
    steps = _same(found.filter("part is not null").select("conv_id", "part", "block", "start", "labels"), texts, ["conv_id", "part", "block"], "left")
    lines = F.udf(lambda labels, start, block: repaired_lines(labels, start, [(r["role"], r["text"]) for r in block or []]), "array<string>")
    pieces = steps.select("conv_id", "part", "block", lines("labels", "start", "rows").alias("lines"))
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").select("conv_id", F.size("lines").alias("n"), F.array_join("lines", "\n").alias("piece"))
    digests = pieces.mapInArrow(_digests, T.StructType([conv, T.StructField("repaired_sha256", word)]))
    return _same(_same(whole, summary, ["conv_id"]), digests, ["conv_id"])


def _illegal(initials: Column) -> Column:
    pairs = F.zip_with(F.slice(initials, 1, F.size(initials) - 1), F.slice(initials, 2, F.size(initials)), lambda a, b: F.concat(a, b))
    return F.when(F.size(initials) > 1, F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL)))).otherwise(0).cast("long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's pieces, which come in order."""
    at, started, digest, lines = None, False, None, 0
    for batch in batches:
        conv = batch.schema.field("conv_id").type
        done = []
        for own, n, piece in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "n", "piece")], strict=True):
            if not started or own != at:
                if started:
                    done.append((at, digest.hexdigest()))
                at, started, digest, lines = own, True, hashlib.sha256(), 0
            if n:
                digest.update((("\n" if lines else "") + piece).encode())
                lines += n
        yield pa.record_batch([pa.array([c for c, _ in done], conv), pa.array([d for _, d in done], pa.string())], names=["conv_id", "repaired_sha256"])
    if started:
        yield pa.record_batch([pa.array([at], conv), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def audit_conversations(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """`repair_conversations(rows)` with every conv_id of conversations: those without rows have zeros, an empty audit and the empty text's digest."""
    found = repair_conversations(rows)
    every = conversations.select("conv_id").distinct()
    out = _same(every, found, ["conv_id"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
