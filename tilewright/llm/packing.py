"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document's full windows are emitted as they
are; its rest enters the open window it fits most tightly, and when none fits and the space is used
up, the fullest open window is emitted. What is still open at the end of a partition is merged
afterwards: open windows are items of the same packing, dealt to fewer and fewer tasks.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import materialize, scratch_path, text_or_empty

WINDOW = 1024
OPEN_WINDOWS = 64
END_ID = 0
#: Open windows that one merging task takes.
MERGE_ITEMS = 8192
#: Units whose ids a worker remembers for good, and as many late ones; so many fillings of the late ones, and they take the first ones' place.
REMEMBERED, FILLINGS = 400_000, 8
#: White space as the tokenizer's pattern sees it.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class UnitTokenizer(dict):
    """Token ids of texts as little-endian uint32 bytes, by a tokenizers file; maps units to their ids.

    Texts are cut where a byte-level BPE with this pattern never merges: before the single space that
    leads a word, around longer runs of white space, and between letters and the full stops or commas
    that end a word. Units repeat, so their ids are remembered: the first ones seen, among which the
    frequent ones are, in the dict itself, and late ones in a second one that starts anew when it is
    full. If it fills again and again, texts have changed, and it takes the place of the first. A unit of letters, or of full stops and commas, is one piece of the pattern: the file's merges
    take it as it is. Other units go through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        words = f" ?[{_LETTERS}]+(?![^{_WS}.,])|[.,]+(?![^{_WS}])"
        self.units = re.compile(f"{words}| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
        split = self.tokenizer.pre_tokenizer
        self.one_piece = re.compile(f" ?[{_LETTERS}]+|[.,]+").fullmatch
        as_bytes = [ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0] for c in range(256)]
        self.as_bytes = dict(enumerate(as_bytes))  # how the file writes the UTF-8 bytes of a character of such units
        self.space = as_bytes[32]
        self.named = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # each one id wherever a text has it
        self.plain = self.tokenizer.normalizer is None and isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space
        self.plain = self.plain and not any(map(self.one_piece, self.named))
        self.named_at = re.compile("(" + "|".join(map(re.escape, self.named)) + ")")
        self.remembered, self.late, self.filled = remembered, {}, 0

    def _units(self, text: str) -> list[str]:
        if not any(t in text for t in self.named):
            return self.units.findall(text)
        return [u for k, part in enumerate(self.named_at.split(text)) for u in ([part] if k % 2 else self.units.findall(part))]

    def __missing__(self, unit: str) -> bytes:
        made = self.late.get(unit)
        if made is not None:
            return made
        lead, rest = (self.space, unit[1:]) if unit[0] == " " else ("", unit)
        if self.plain and rest.isascii() and rest.isalpha():  # ASCII letters stand for themselves in the file
            ids = [t.id for t in self.model.tokenize(lead + rest)]
        elif self.plain and self.one_piece(unit):
            ids = [t.id for t in self.model.tokenize(unit.translate(self.as_bytes))]
        else:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        made = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.remembered:
            self[unit] = made
            return made
        if len(self.late) >= self.remembered:
            self.filled += 1
            if self.filled % FILLINGS == 0:
                self.clear()
                self.update(self.late)
            self.late = {}
        self.late[unit] = made
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        ids = self.__getitem__
        return [b"".join(map(ids, self._units(t))) for t in texts]


@functools.lru_cache(maxsize=1)
def tokenizer_for(path: str) -> UnitTokenizer:
    """One tokenizer a Python worker: what it remembers serves the worker's later tasks too."""
    return UnitTokenizer(path)


class OpenWindows:
    """At most `space` open windows; names come from `new_name`. place() says where an item goes."""

    def __init__(self, window: int, space: int, new_name) -> None:
        self.window, self.space, self.new_name = window, space, new_name
        self.by_room: list[tuple[int, int]] = []  # (room, name), sorted
        self.closed: list[int] = []

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of an item of up to a window's length."""
        at = bisect.bisect_left(self.by_room, (length, -1))
        if at < len(self.by_room):
            room, name = self.by_room.pop(at)
        else:
            if len(self.by_room) >= self.space:
                self.closed.append(self.by_room.pop(0)[1])  # the fullest
            room, name = self.window, self.new_name()
        if room > length:
            bisect.insort(self.by_room, (room - length, name))
        else:
            self.closed.append(name)
        return name, self.window - room


def _namer():
    """Names that no other task gives: the partition's number above, a counter below."""
    state = [TaskContext.get().partitionId() << 36]

    def new() -> int:
        state[0] += 1
        return state[0] - 1

    return new


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, bin long, offset long, open boolean"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def _batch(rows: list[tuple], still_open: bool) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, [still_open] * len(rows)], _KINDS, strict=True)], names=[c.split()[0] for c in _PIECES.split(", ")])


def _pack_texts(path: str, window: int, space: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, new_name = tokenizer_for(path), _namer()
        open_windows = OpenWindows(window, space, new_name)
        waiting: dict[int, list[tuple]] = {}  # pieces in open windows: a few windows of ids at most
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                done: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokenizer.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        piece = (doc_id, start, length, ids[4 * start : 4 * (start + length)], total)
                        if length == window:
                            done.append((*piece, new_name(), 0))
                            continue
                        name, offset = open_windows.place(length)
                        waiting.setdefault(name, []).append((*piece, name, offset))
                        for name in open_windows.closed:
                            done += waiting.pop(name)
                        open_windows.closed.clear()
                yield _batch(done, False)
        yield _batch([row for rows in waiting.values() for row in rows], True)

    return run


def _pack_windows(window: int, space: int):
    """Items are windows (bin, fill), the largest first; out: bin, into, base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_name = _namer()
        open_windows = OpenWindows(window, space, new_name)
        for batch in batches:
            placed = [open_windows.place(n) for n in batch.column("fill").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("bin"), pa.array([p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())], names=["bin", "into", "base"])

    return run


def _merge_open(fills: DataFrame, window: int, space: int, merge_items: int) -> DataFrame:
    """fills (bin, fill) of windows that are not full: bin, into, base after merging, round by round."""
    moved = fills.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("base"))
    left, n, depth = fills, fills.count(), 0
    while n > 1:
        tasks = -(-n // merge_items)
        depth += 1
        dealt = left.repartition(tasks, F.xxhash64(F.col("bin"), F.lit(depth))).sortWithinPartitions(F.desc("fill"), "bin") if tasks > 1 else left.coalesce(1).sortWithinPartitions(F.desc("fill"), "bin")
        to = dealt.mapInArrow(_pack_windows(window, space), "bin long, into long, base long")
        to = materialize(to.select("bin", (F.col("into") + F.lit(-(depth << 58))).alias("into"), "base"), "merged")
        step = to.select(F.col("bin").alias("into"), F.col("into").alias("_into"), F.col("base").alias("_base"))
        moved = materialize(moved.join(step, "into", "left").select("bin", F.coalesce("_into", "into").alias("into"), (F.col("base") + F.coalesce("_base", F.lit(0))).alias("base")), "moved")
        left = left.join(to, "bin").groupBy("into").agg(F.sum("fill").alias("fill")).filter(F.col("fill") < window).select(F.col("into").alias("bin"), "fill")
        left = materialize(left, "left")
        before, n = n, left.count()
        if tasks == 1 or n >= before:
            break
    return moved


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, merge_items: int = MERGE_ITEMS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Null text counts as empty: one piece of the end id alone. Rows repeated under one doc_id are
    packed each. Documents longer than a window are cut at its multiples only; every other document
    stays whole. Ties between equally tight windows go to the older one. An empty table gives an
    empty result; other columns of docs are ignored.
    """
    source = docs.select("doc_id", text_or_empty().alias("text"))
    made = source.mapInArrow(_pack_texts(tokenizer_path, window, open_windows, end_id), _PIECES)
    place = scratch_path(docs.sparkSession, "pieces")
    made.write.option("compression", "zstd").parquet(place)
    pieces = docs.sparkSession.read.schema(made.schema).parquet(place)
    fills = materialize(pieces.filter("open").groupBy("bin").agg(F.sum("length").alias("fill")), "fills")
    moved = _merge_open(fills, window, open_windows, merge_items)
    joined = pieces.filter("open").join(moved, "bin")
    out = ["doc_id", "start", "length", "ids", "doc_tokens"]
    return pieces.filter("not open").select(*out, F.col("bin").alias("sequence_id"), "offset").union(
        joined.select(*out, F.col("into").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"))
    )
