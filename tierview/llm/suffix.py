"""Removal of repeated passages by longest-previous-factor arrays over suffix order.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id.
Whether a string does is told by suffix order: among suffixes sorted by their first bytes, the
nearest one before and the nearest one after that belong to smaller documents have the longest
common prefixes with it that any smaller document offers (its longest previous factor).

No task sees the whole corpus:

1. Texts are written as compressed chunks. Every window of 50 bytes names its least 24-byte string
   by hash; equal windows name equal strings. Runs of windows with one such anchor make
   pieces of 50 to 76 bytes.
2. Chunks ask buckets which anchors occur in more than one document (4 bytes an anchor).
3. Only pieces at shared anchors travel, to the bucket of their anchor; of equal pieces in a chunk
   only the smallest document's, the others being covered already. Windows at an anchor that very
   many documents share are dealt out by their own content instead, so that none is hot.
4. Each bucket builds the suffix order of its distinct pieces by prefix doubling, previous and
   next smaller documents by pointer jumping, and answers with a bit for each window.
5. Answers meet their chunks again, and covered bytes are removed.

Defined cases: a null text is an empty one; a null id counts as larger than any other; rows with equal
ids never cover each other; texts under 50 bytes lose nothing; equal texts lose all but the first;
removal may cut a character, so ``kept`` is binary, unless characters are kept or removed ``whole``; an empty
table gives an empty result; other columns are not read. Windows are held equal by 64-bit hashes of the strings that
cover them; ``HOT`` decides how windows travel, never what is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Chunk, Known, bucket_count, bucketed, carried, shared_keys, to_chunks
from .common import cut, discard, partitions, table

LENGTH, SEED = 50, 24
#: Documents that share an anchor before its windows are dealt out one by one.
HOT = 4096
#: Bytes of distinct pieces that one bucket should have.
BUCKET_BYTES = 2_000_000
#: Places hashed or compared at a time, so that intermediate arrays stay small.
PLACES = 1 << 17


def mix(x: np.ndarray, multiplier: int, shift: int) -> np.ndarray:
    x = x * np.uint64(multiplier)
    x ^= x >> np.uint64(shift)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as little-endian integers; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).tobytes()
    out = np.empty(len(data), np.uint64)
    for k in range(min(8, len(data))):
        out[k::8] = np.frombuffer(padded, "<u8", (len(data) - k + 7) // 8, k)
    return out


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` bytes from each place on."""
    out = np.empty(max(0, len(data) - SEED + 1), np.uint64)
    for at in range(0, len(out), PLACES):
        x = eights(data[at : at + PLACES + SEED - 1])
        n = len(x) - SEED + 1
        h = mix(x[:n], 0x9E3779B97F4A7C15, 32)
        h = mix(h + x[8 : n + 8], 0xD6E8FEB86659FD93, 29)
        out[at : at + n] = mix(mix(h + x[16 : n + 16], 0xC2B2AE3D27D4EB4F, 32), 0x165667B19E3779F9, 31)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Pieces:
    """Runs of windows with one anchor, in a chunk: first and last window, document, anchor's key."""

    def __init__(self, chunk: Chunk, length: int = LENGTH):
        data, starts, ends = chunk.data, chunk.starts, chunk.ends
        self.hashes = np.zeros(0, np.uint64)
        self.first = self.last = self.rows = np.zeros(0, np.int64)
        self.keys = np.zeros(0, np.uint64)
        if len(data) < length:
            return
        self.hashes = h = seed_hashes(data)
        order = np.arange(len(h), dtype=np.uint64)
        order |= h & np.uint64(0xFFFFFFFF00000000)
        # A seed over the end of a document is never the least.
        for inner in ends[:-1]:
            order[max(0, inner - SEED + 1) : inner] = np.uint64(0xFFFFFFFFFFFFFFFF)
        width = length - SEED + 1
        anchor = np.empty(len(order) - width + 1, np.uint32)
        for begin in range(0, len(anchor), PLACES):
            anchor[begin : begin + PLACES] = sliding_min(order[begin : begin + PLACES + width - 1], width) & np.uint64(0xFFFFFFFF)
        del order
        edge = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(anchor)]]) - 1
        at = anchor[first].astype(np.int64)
        good = at < len(h)
        first, last, at = first[good], last[good], at[good]
        rows = np.searchsorted(ends, at, side="right")
        first, last = np.maximum(first, starts[rows]), np.minimum(last, ends[rows] - length)
        good = (first <= last) & (first <= at)
        self.first, self.last, self.rows = first[good], last[good], rows[good]
        self.keys = mix(mix(h[at[good]], 0xFF51AFD7ED558CCD, 33), 0xC4CEB9FE1A85EC53, 33)

    def content(self, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """A hash of the bytes of each piece, from seeds that cover it."""
        end = last + length - SEED
        out = (last - first).astype(np.uint64)
        for at in (first, np.minimum(first + SEED, end), np.minimum(first + 2 * SEED, end), end):
            out = mix(out ^ self.hashes[at], 0x9E3779B97F4A7C15, 32)
        return mix(out, 0xFF51AFD7ED558CCD, 33)


def gather(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``data`` one after another."""
    ends = np.cumsum(sizes)
    return data[np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)  # equal keys get one rank, so their order is free
    ordered, step = keys[order], np.zeros(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=step[1:])
    del ordered
    out = np.empty(len(keys), np.uint32)
    out[order] = np.cumsum(step, dtype=np.uint32)
    return out


def joined(ranks: np.ndarray, first: np.ndarray, ahead: int) -> np.ndarray:
    """The ranks at ``first`` and ``ahead`` of it, as one number."""
    out = ranks[first].astype(np.uint64)
    out <<= np.uint64(32)
    out |= ranks[first + ahead]
    return out


class SuffixOrder:
    """Suffixes of ``data`` from the places ``at``, sorted by their first ``depth`` bytes (32 to 63)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, depth: int = LENGTH):
        padded = np.concatenate([data, np.zeros(64, np.uint8)])
        self.depth, self.words = depth, eights(padded).byteswap(inplace=True)
        self.levels: dict[int, np.ndarray] = {8: ranks(self.words)}
        for level in (8, 16):
            # Only places whose bytes lie within the depth of some suffix are ever looked at.
            to = self.inner(at, 2 * level)
            self.levels[2 * level] = np.zeros(len(padded), np.uint32)
            self.levels[2 * level][to] = ranks(joined(self.levels[level], to, level))
        del self.levels[8]
        self.order = at[np.argsort(joined(self.levels[32], at, depth - 32))]

    def inner(self, at: np.ndarray, size: int) -> np.ndarray:
        """Places whose ``size`` bytes lie within the first ``depth`` bytes of a suffix."""
        edge = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.depth - size + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1], out=edge[:-1]) > 0)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes at ``a`` and ``b``, ``depth`` at most."""
        size = np.zeros(len(a), np.int64)
        for level in (32, 16, 8):
            r = self.levels[level] if level > 8 else self.words
            size += level * (r[a + size] == r[b + size])
        rest = self.words[a + size] ^ self.words[b + size]
        for k in range(7):
            rest_same = (rest >> np.uint64(8 * (7 - k))) == 0
            size += rest_same & (size < self.depth)
        return np.minimum(size, self.depth)


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier one with a smaller value, or -1, by pointer jumping."""
    found = np.arange(-1, len(values) - 1)
    todo = np.arange(len(values))
    while len(todo):
        to = found[todo]
        todo = todo[(to >= 0) & (values[np.maximum(to, 0)] >= values[todo])]
        found[todo] = found[found[todo]]
    return found


def previous_factors(data: np.ndarray, at: np.ndarray, owners: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix places in order, and how long a prefix of each (``depth`` at most) a smaller owner has."""
    suffixes = SuffixOrder(data, at, depth)
    order = suffixes.order
    by = np.empty(len(data), np.int64)
    by[at] = owners
    owner = by[order]
    before = previous_smaller(owner)
    after = len(order) - 1 - previous_smaller(owner[::-1])[::-1]
    out = np.zeros(len(order), np.int64)
    for near in (before, after):
        there = np.flatnonzero((near >= 0) & (near < len(order)))
        out[there] = np.maximum(out[there], suffixes.common(order[there], order[near[there]]))
    return order, out


def _pack(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "chunk": pa.int64()}
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for c, n in zip(columns, names)], names)


_PIECE = ["bucket", "chunk", "owners", "places", "sizes", "data", "covered"]


def slice_hashes(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each slice, of SEED bytes to four times as many, from seeds that cover it."""
    h = seed_hashes(data)
    end = first + sizes - SEED
    out = sizes.astype(np.uint64)
    for at in (first, np.minimum(first + SEED, end), np.minimum(first + 2 * SEED, end), end):
        out = mix(out ^ h[at], 0x9E3779B97F4A7C15, 32)
    return mix(out, 0xFF51AFD7ED558CCD, 33)


def covered_windows(chunks: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(chunk, places, masks): bit i of a mask says that the window at its place + i is also in a smaller document."""
    spark = chunks.sparkSession
    buckets = bucket_count(chunks, 2 * partitions(spark), 4_000_000)

    def anchors(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        p = Pieces(chunk, length)
        return p.keys, p.rows

    known = shared_keys(chunks, anchors, buckets, hot)
    shared = known.agg(F.sum(F.length("shared"))).first()[0] or 0
    wide = max(2 * partitions(spark), -(-shared * 17 // BUCKET_BYTES))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        out: list[tuple] = []
        packer = zstandard.ZstdCompressor(level=3)
        for row in left.to_pylist():
            chunk = Chunk.read(row)
            p = Pieces(chunk, length)
            at = np.flatnonzero(Known(right, "shared", buckets).has(p.keys))
            very = Known(right, "hot", buckets).has(p.keys[at])
            single = at[very]
            many = p.last[single] - p.first[single] + 1
            windows = np.repeat(p.first[single] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            first, last = np.concatenate([p.first[at[~very]], windows]), np.concatenate([p.last[at[~very]], windows])
            rows = np.concatenate([p.rows[at[~very]], np.repeat(p.rows[single], many)])
            content = p.content(first, last, length)
            keys = np.concatenate([p.keys[at[~very]], content[len(first) - len(windows) :]])
            owners = chunk.ids[rows]
            order = np.lexsort((owners, content))
            start = np.ones(len(order), bool)
            start[1:] = content[order][1:] != content[order][:-1]
            least = owners[order][start][np.cumsum(start) - 1]
            mine = order[owners[order] == least]
            others = order[owners[order] != least]
            done = np.concatenate([first[others], last[others] + length])
            # What the chunk settles itself goes through some bucket with the rest.
            out.append((chunk.name % wide, chunk.name, b"", b"", b"", packer.compress(b""), done.astype(np.int64).tobytes()))
            first, last, content, keys, owners = first[mine], last[mine], content[mine], keys[mine], owners[mine]
            for bucket, i in bucketed(keys, wide):
                i = i[np.argsort(first[i])]
                sizes = last[i] - first[i] + length
                steps = np.diff(first[i], prepend=0).astype(np.uint32)
                out.append((bucket, chunk.name, owners[i].tobytes(), steps.tobytes(), sizes.astype(np.uint8).tobytes(), packer.compress(gather(chunk.data, first[i], sizes).tobytes()), b""))
        return pa.Table.from_batches([_pack(out, _PIECE)])

    schema = "bucket int, chunk long, owners binary, places binary, sizes binary, data binary, covered binary"
    sent = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(send, schema)

    def judge(group: pa.Table) -> pa.Table:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        parts = {n: [np.frombuffer(x, t) for x in group.column(n).to_pylist()] for n, t in (("owners", np.int64), ("places", np.uint32), ("sizes", np.uint8))}
        parts["places"] = [np.cumsum(x, dtype=np.uint32) for x in parts["places"]]
        counts = [len(x) for x in parts["owners"]]
        owners, sizes = (np.concatenate(parts[n]) for n in ("owners", "sizes"))
        sizes = sizes.astype(np.int64)
        data = np.frombuffer(b"".join([unpacker.decompress(x) for x in group.column("data").to_pylist()]), np.uint8)
        settled = [(c, b"", b"", x) for c, x in zip(group.column("chunk").to_pylist(), group.column("covered").to_pylist()) if x]
        names = ["chunk", "places", "masks", "covered"]
        if not len(owners):
            return pa.Table.from_batches([_pack(settled, names)])
        begins = np.cumsum(sizes) - sizes
        content = slice_hashes(data, begins, sizes)
        order = np.lexsort((owners, content))
        new = np.ones(len(order), bool)
        new[1:] = content[order][1:] != content[order][:-1]
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        first = order[new]  # of each kind the smallest owner's piece
        text = gather(data, begins[first], sizes[first])
        windows = sizes[first] - length + 1
        ends = np.cumsum(sizes[first])
        inside = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        at = np.repeat(ends - sizes[first], windows) + inside
        places, factors = previous_factors(text, at, np.repeat(owners[first], windows), length)
        hit = np.zeros(len(text), bool)
        hit[places[factors >= length]] = True
        of = np.repeat(np.arange(len(first)), windows)
        masks = np.zeros(len(first), np.int64)
        np.add.at(masks, of, hit[at].astype(np.int64) << inside)
        whole = (np.int64(1) << windows) - 1
        mask = np.where(owners > owners[first][kind], whole[kind], masks[kind]).astype(np.uint32)
        rows, done = [], 0
        for chunk, n, place in zip(group.column("chunk").to_pylist(), counts, parts["places"]):
            m = mask[done : done + n]
            rows.append((chunk, place[m != 0].tobytes(), m[m != 0].tobytes(), b""))
            done += n
        return pa.Table.from_batches([_pack(settled + rows, names)])

    found = cut(sent.groupBy("bucket").applyInArrow(judge, "chunk long, places binary, masks binary, covered binary"))
    discard(known)
    return found


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, carry: list[str] | None = None, whole: bool = False) -> DataFrame:
    """Per row: the columns to ``carry``, doc_id, n_bytes, n_removed, spans (array of from, to) and kept (binary).

    With ``whole``, a character of which a byte goes is removed altogether, so that ``kept`` is UTF-8.
    """
    chunks = to_chunks(df, id_column, text, carry=carry)
    found = covered_windows(chunks, length, hot)

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        rest: list[pa.Table] = []
        for row in left.to_pylist():
            chunk = Chunk.read(row)
            rest += [carried(row)] if carry else []
            edge = np.zeros(len(chunk.data) + 1, np.int32)
            for covered in filter(None, right.column("covered").to_pylist()):
                first, last = np.frombuffer(covered, np.int64).reshape(2, -1)
                np.add.at(edge, first, 1)
                np.add.at(edge, last, -1)
            p, m = (np.frombuffer(b"".join(filter(None, right.column(c).to_pylist())), np.uint32) for c in ("places", "masks"))
            p = p.astype(np.int64)
            for i in range(32):
                on = p[(m >> np.uint32(i)) & np.uint32(1) == 1] + i
                np.add.at(edge, on, 1)
                np.add.at(edge, on + length, -1)
            gone = np.cumsum(edge[:-1], out=edge[:-1]) > 0
            if whole and len(gone):
                lead = np.flatnonzero((chunk.data & 0xC0) != 0x80)
                gone = np.repeat(np.logical_or.reduceat(gone, lead), np.diff(lead, append=len(gone)))
            raw = chunk.data.tobytes()
            for doc, null, a, b in zip(chunk.ids.tolist(), chunk.nulls.tolist(), chunk.starts.tolist(), chunk.ends.tolist()):
                cover = gone[a:b]
                if cover.any():
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]]))).reshape(-1, 2)
                    kept = chunk.data[a:b][~cover].tobytes()
                else:
                    turn, kept = np.zeros((0, 2), np.int64), raw[a:b]
                rows.append((None if null else doc, b - a, b - a - len(kept), [{"from": int(x), "to": int(y)} for x, y in turn], kept))
        columns = list(zip(*rows)) or [()] * 5
        spans = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        along = pa.concat_tables(rest) if rest else None
        own = {f"__carried_{c}": along.column(c) for c in carry} if along else {}
        return pa.table(own | {n: pa.array(c, k) for n, c, k in zip(("doc_id", "n_bytes", "n_removed", "spans", "kept"), columns, (pa.int64(), pa.int64(), pa.int64(), spans, pa.binary()))})

    kinds = dict(df.dtypes)
    schema = "".join(f"`__carried_{c}` {kinds[c]}, " for c in carry or []) + "doc_id long, n_bytes long, n_removed long, spans array<struct<`from`: long, `to`: long>>, kept binary"
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(strip, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
