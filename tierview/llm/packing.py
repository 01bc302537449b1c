"""Packing documents into sequences: dominance reduction, then best fit, for all documents at once.

How documents fill sequences depends only on how many pieces there are of each length, and
lengths are at most the capacity. So the plan is made from that histogram (``capacity`` rows at
most, whatever the input): Martello and Toth's criterion permanently fixes sets that dominate every
other set holding the same piece, the remainder is packed by best fit decreasing, each
step for all equal sequences together. The plan has O(capacity) entries. Pieces are then ranked
within their length, in salted groups, and the n-th piece of a length takes the n-th place that the
plan has for it.

Defined cases: a null text is an empty one and a piece of one token (the end id); repeated rows are
packed each on its own; equal lengths take places in any order; an empty table gives an empty result;
texts are tokenised whole, whatever they hold; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters
from .chunks import row_ranges
from .common import cut, rank_in_group, table

CAPACITY = 2048
# The byte-level pre-tokenizer and its pattern.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankTokenizer:
    """The ids of a byte-level BPE file of the tokenizers library, by tiktoken, which is several times as fast.

    In such a file ids beyond the 256 bytes follow the merges' order, so they serve as ranks; a
    file where they don't is left to the library, and so is a text that tiktoken gives up on, as it does on
    about a million white-space characters in a row.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.fast = self.held = None
        if spec["pre_tokenizer"] != BYTE_LEVEL or spec["normalizer"] or any(vocab["".join(m)] != 256 + i for i, m in enumerate(merges)):
            return
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; added tokens are found in the text."""
        ids = None
        if self.fast is not None:
            try:
                ids = self.fast.encode(text, allowed_special="all")
            except ValueError:  # its pattern's backtracking ran out of stack
                pass
        return np.array(self.library().encode(text, add_special_tokens=False).ids if ids is None else ids, "<u4").tobytes()

    def library(self) -> Any:
        from tokenizers import Tokenizer

        if self.held is None:
            self.held = Tokenizer.from_file(self.path)
        return self.held


def pieces(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, with ``keep_ids``, ids (binary). Only the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = RankTokenizer(path)
        for batch in batches:
            for at, to in row_ranges(batch.column(1)):
                part = batch.slice(at, to - at)
                rows: list[tuple] = []
                for i, text_ in enumerate(part.column(1).to_pylist()):
                    ids = tokenizer.encode(text_ or "")
                    ids += struct.pack("<I", end)
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    rows += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                row, *rest = zip(*rows)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), *[pa.array(c, k) for c, k in zip(rest, kinds)]], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    kind = dict(df.dtypes)[id_column]
    return df.select(df[id_column].alias("doc_id"), df[text].alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


Pattern = tuple[tuple[int, int], ...]  # (length, how many), largest first


class Stock:
    """Lengths still to be packed, with counts, in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.remove(size)

    def largest(self, room: int, without: dict[int, int]) -> int | None:
        """The largest length up to ``room`` that is there besides ``without``."""
        for i in range(bisect_right(self.sizes, room) - 1, -1, -1):
            if self.counts[self.sizes[i]] > without.get(self.sizes[i], 0):
                return self.sizes[i]
        return None

    def smallest(self, n: int, without: dict[int, int]) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.counts[s] - without.get(s, 0))
            if len(out) >= n:
                break
        return out


def dominating(stock: Stock, size: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``size`` that dominates every other one with it, or None if this can't be told from sets of up to three.

    A set dominates another if the other's pieces can be shared out among its own, none
    getting more than its length; some optimal packing then has the dominating set.
    """
    room, own = capacity - size, {size: 1}
    first = stock.largest(room, own)
    if first is None:
        return (size,)
    least = stock.smallest(3, own)
    if first == room or len(least) < 2 or least[0] + least[1] > room:
        return size, first
    if len(least) == 3 and sum(least) <= room:
        return None
    # Two others at most: the best first piece must come with a second at least as long as the second of any pair.
    taken = own | {first: own.get(first, 0) + 1}
    second = stock.largest(room - first, taken)
    middle = _middle(stock, room, own)
    if second is not None and middle is not None and second >= middle:
        return size, first, second
    return None


def _middle(stock: Stock, room: int, own: dict[int, int]) -> int | None:
    """The longest second piece of any pair within ``room``."""
    sizes = stock.sizes
    for i in range(bisect_right(sizes, room // 2) - 1, -1, -1):
        y = sizes[i]
        left = stock.counts[y] - own.get(y, 0)
        if left >= 2:
            return y
        if left == 1:
            j = i + 1
            while j < len(sizes) and stock.counts[sizes[j]] <= own.get(sizes[j], 0):
                j += 1
            if j < len(sizes) and y + sizes[j] <= room:
                return y
    return None


def reduce_by_dominance(stock: Stock, capacity: int) -> list[tuple[Pattern, int]]:
    """Fixes dominating sets, for all equal pieces at once, until none is left; ``stock`` keeps the rest."""
    out: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for size in sorted(stock.sizes, reverse=True):
            while size in stock.counts and (found := dominating(stock, size, capacity)):
                need = {s: found.count(s) for s in found}
                times = min(stock.counts[s] // n for s, n in need.items())
                # Repeating a set is right while what makes it dominate stays: the same lengths are there.
                for s, n in need.items():
                    stock.take(s, n * times)
                out.append((tuple(sorted(need.items(), reverse=True)), times))
                changed = True
    return out


def best_fit(stock: Stock, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing, equal sequences in one step."""
    open_by: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(pattern: list[tuple[int, int]], room: int, n: int) -> None:
        if n:
            if room not in open_by:
                open_by[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_by[room].append((pattern, n))

    for size in sorted(stock.sizes, reverse=True):
        left = stock.counts[size]
        while left:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                pattern, n = open_by[room].pop()
                if not open_by[room]:
                    del open_by[room]
                    rooms.pop(i)
            else:
                room, pattern, n = capacity, [], -(-left // (capacity // size))
            each = room // size
            full = min(n, left // each)
            put([*pattern, (size, each)], room - each * size, full)
            left, n = left - full * each, n - full
            if n and left:
                put([*pattern, (size, left)], room - left * size, 1)
                left, n = 0, n - 1
            if pattern:
                put(pattern, room, n)
    return [(tuple(pattern), n) for groups in open_by.values() for pattern, n in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences have each; together they hold ``counts`` exactly."""
    stock = Stock(counts)
    return reduce_by_dominance(stock, capacity) + best_fit(stock, capacity)


def places(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Sorted arrays: from which rank of which length an entry holds, and where its pieces go."""
    rows, taken, base = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for size, each in pattern:
            rows.append((size, taken.get(size, 0), each, base, offset))
            taken[size] = taken.get(size, 0) + each * times
            offset += size * each
        base += times
    rows.sort()
    size, low, each, first, offset = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": (size << 44) + low, "low": low, "each": each, "first": first, "offset": offset}


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``. Give narrow rows of a written table."""
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    index = places(plan(counts, capacity))
    ranked = rank_in_group(cut_pieces, "length", ["doc_id", "piece", "ids_crc32"], "__rank", sum(counts.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            at = np.searchsorted(index["key"], (length << 44) + rank, side="right") - 1
            seq, inside = np.divmod(rank - index["low"][at], index["each"][at])
            table_ = pa.Table.from_batches([batch]).drop_columns(["__rank"])
            table_ = table_.append_column("sequence_id", pa.array(index["first"][at] + seq, pa.int64())).append_column("offset", pa.array(index["offset"][at] + inside * length, pa.int64()))
            yield from table_.to_batches()

    kinds = ", ".join(f"`{c}` {k}" for c, k in ranked.dtypes if c != "__rank")
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def op4_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(cut(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))))
