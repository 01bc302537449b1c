"""Texts in batches: row ranges of bounded size, chunks, and which keys the rows of all chunks share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def row_ranges(texts: pa.Array, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) with about ``size`` bytes of text each, a longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(ends)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield at, to
        at = to


@dataclass
class Chunk:
    """Some rows: their ids (nulls last of all) and their texts as one array of bytes."""

    name: int
    ids: np.ndarray
    nulls: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    @classmethod
    def read(cls, row: dict) -> Chunk:
        import zstandard

        ends = np.frombuffer(row["ends"], np.int64)
        size = int(ends[-1]) if len(ends) else 0
        data = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(size, 1)) if size else b""
        return cls(row["chunk"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool), ends, np.frombuffer(data, np.uint8))


CHUNK_SCHEMA = "chunk long, ids binary, nulls binary, ends binary, blob binary, rest binary"
LAST_ID = np.iinfo(np.int64).max


def to_chunks(df: DataFrame, id_column: str, text: str, size: int = 4_000_000, carry: list[str] | None = None) -> DataFrame:
    """``df`` as a written table of chunks of about ``size`` bytes of text (a longer text alone), compressed.

    Columns to ``carry`` go along as an Arrow stream, for ``carried``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        packer, name = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            nonlocal name, held
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, texts = rows.column(0).combine_chunks(), pc.fill_null(rows.column(1).combine_chunks(), "")
            nulls = pc.is_null(ids).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            blob = packer.compress("".join(texts.to_pylist()).encode())
            stream = pa.BufferOutputStream()
            with pa.ipc.new_stream(stream, rows.select(range(2, rows.num_columns)).schema) as writer:
                writer.write_table(rows.select(range(2, rows.num_columns)))
            rest = packer.compress(stream.getvalue().to_pybytes()) if rows.num_columns > 2 else b""
            out = [[name], [pc.fill_null(ids, int(LAST_ID)).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], [nulls.tobytes()], [ends.tobytes()], [blob], [rest]]
            name, held = name + 1, []
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["chunk", "ids", "nulls", "ends", "blob", "rest"])

        filled = 0
        for batch in batches:
            for at, to in row_ranges(batch.column(1), size):
                part = batch.slice(at, to - at)
                filled += part.column(1).nbytes
                held.append(part)
                if filled >= size:
                    yield packed()
                    filled = 0
        if held:
            yield packed()

    rows = df.select(df[id_column].cast("long").alias("__id"), df[text].cast("string").alias("__text"), *(carry or []))
    return cut(rows.mapInArrow(run, CHUNK_SCHEMA), "none")


def carried(row: dict) -> pa.Table:
    """The columns that a chunk carries."""
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(row["rest"])).read_all()


def bucketed(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys) for each bucket that has any."""
    of = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint64)
    order = np.argsort(of, kind="stable")  # by radix where 16 bits do
    edges = np.flatnonzero(np.diff(of[order])) + 1
    for places in np.split(order, edges):
        if len(places):
            yield int(of[places[0]]), places


def shared_keys(chunks: DataFrame, features: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], buckets: int, hot: int) -> DataFrame:
    """(chunk, shared, hot): per chunk, the keys that more than one row has, and those that more than ``hot`` have.

    ``features`` gives keys (64 bits, well mixed) and their row numbers in the chunk. A chunk sends each
    bucket its distinct keys, 4 bytes each, with counts only where two rows of the chunk share one.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                every, rows = features(Chunk.read(row))
                keys, counts = np.unique(every, return_counts=True)
                # Rows, not places, count; only keys with several places need a look.
                again = np.flatnonzero(_in_sorted(every, keys[counts > 1]))
                again = again[np.lexsort((rows[again], every[again]))]
                new = np.ones(len(again), bool)
                new[1:] = (every[again][1:] != every[again][:-1]) | (rows[again][1:] != rows[again][:-1])
                counts[counts > 1] = np.unique(every[again[new]], return_counts=True)[1]
                out: list[list] = [[], [], [], []]
                for bucket, places in bucketed(keys, buckets):
                    low, n = keys[places].astype(np.uint32), counts[places]
                    many = n > 1
                    out[0].append(bucket)
                    out[1].append(row["chunk"])
                    out[2].append(low[~many].tobytes())
                    out[3].append(low[many].tobytes() + np.minimum(n[many], 2**32 - 1).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["bucket", "chunk", "once", "many"])

    def answer(group: pa.Table) -> pa.Table:
        once = [np.frombuffer(x, np.uint32) for x in group.column("once").to_pylist()]
        many = [np.frombuffer(x, np.uint32).reshape(2, -1) for x in group.column("many").to_pylist()]
        keys = np.concatenate([*once, *[m[0] for m in many]])
        counts = np.concatenate([*[np.ones(len(o), np.int64) for o in once], *[m[1].astype(np.int64) for m in many]])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        total = np.add.reduceat(counts, first) if len(keys) else counts
        keys = keys[first]
        some, lots = keys[total > 1], keys[total > hot]
        shared, hots = [], []
        for o, m in zip(once, many):
            own = np.concatenate([o, m[0]])
            own = own[_in_sorted(own, some)]
            shared.append(own.tobytes())
            hots.append(own[_in_sorted(own, lots)].tobytes())
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "shared": pa.array(shared, pa.binary()), "hot": pa.array(hots, pa.binary())})

    asked = chunks.mapInArrow(ask, "bucket int, chunk long, once binary, many binary")
    return cut(asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, shared binary, hot binary"), "none")


def _in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


class Known:
    """Keys that an answer of ``shared_keys`` names, for one chunk."""

    def __init__(self, answers: pa.Table, column: str, buckets: int):
        self.buckets = np.uint64(buckets)
        parts = [np.frombuffer(x, np.uint32).astype(np.uint64) | (np.uint64(b) << np.uint64(32)) for b, x in zip(answers.column("bucket").to_pylist(), answers.column(column).to_pylist())]
        self.sorted = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        return _in_sorted((((keys >> np.uint64(32)) % self.buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF)), self.sorted)


def bucket_count(chunks: DataFrame, least: int, size: int) -> int:
    """Buckets so that each has about ``size`` bytes of compressed text."""
    total = chunks.agg(F.sum(F.length("blob"))).first()[0] or 0
    return max(least, -(-total // size))
