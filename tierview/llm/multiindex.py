"""Near-duplicate vectors through an inverted multi-index.

Unit vectors are halved; each half is quantised by a codebook of its own (k-means on a bounded sample), and the
product of the two makes the cells of a grid, one grid per label. A vector
searches cells in the order of the multi-sequence algorithm: a heap over the two lists of codes,
nearest pair first, each popped pair opening its two neighbours. A linked vector can lie in a cell
only if it is beyond the bisectors of its halves, at distances b1 and b2 from the query, so the order is by
b1**2 + b2**2, and traversal ends at a limit.

The limit is set for a target recall. Of two vectors at the threshold's distance r, the step from
one to the other has about r / sqrt(dimensions) along any fixed direction, a bisector's normal among them, so cells beyond
``DEVIATIONS`` times that are left out; should linked pairs of the sample need more, the limit is what ``RECALL``
of them need. It never exceeds 2 - 2 * threshold, from which on recall is 1 for certain. A pair is found if either
vector visits the other's cell. Members of visited cells are verified by cosine in double precision.

Equal vectors of a label form a class, and one row a class is indexed; links count all rows. Cells
are dealt out in blocks of at most ``BLOCK`` members, queries come in blocks too, and a task gets
one pair of blocks at a time and returns counts and, for the components, one link for each vector and
component of the block; pairs are never written out. Where only one of two linked vectors visits the other's cell, the
task counts the link for both: members carry the list of cells that they visit.

The ``LABELS`` most frequent labels have codebooks of their own, others share one pair for each vector length; labels of
up to ``CELL`` vectors are one cell.

Defined cases: a null label, a null vector, one with null or non-finite components, and a zero vector
link with nothing and are kept; labels of any type are compared as text; vectors of different lengths never link; a null id has a null
component and is kept; rows that repeat an id share a component; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, partitions, table
from .components import components

#: Rows of each label that its codebooks are fitted on, and bytes of all samples, at most; labels with codebooks of their own; members of a block.
SAMPLE, SAMPLE_BYTES, LABELS, BLOCK = 4000, 64_000_000, 256, 1024
#: Vectors that a cell should have; codes of a half, and bytes of all codebooks, at most.
CELL, CODES, CODE_BYTES = 32, 256, 32_000_000
#: Of the step between linked vectors along a bisector's normal, and the share of the sample's linked pairs to find.
DEVIATIONS, RECALL = 3.0, 0.999
OTHERS = "\0others"
#: Rounding of single components and of bounds must not lose a link.
SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centres of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (((centres**2).sum(1))[None] - 2 * x @ centres.T).argmin(1)
        for j in np.unique(near):
            centres[j] = x[near == j].mean(0)
    return np.unique(centres, axis=0)


def code_bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of each row, and for every code the least distance at which its region can be."""
    d = np.maximum(((x**2).sum(1))[:, None] + ((centres**2).sum(1))[None] - 2 * x @ centres.T, 0)
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart[own])
    return own, np.where(np.arange(len(centres))[None] == own[:, None], 0, np.maximum(bound, 0))


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) by rising first[i]**2 + second[j]**2, up to ``limit``."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one] ** 2, second[two] ** 2
    heap, opened, out = [(float(a[0] + b[0]), 0, 0)], {(0, 0)}, []
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > limit:
            break
        out.append((int(one[i]), int(two[j])))
        for n, m in ((i + 1, j), (i, j + 1)):
            if n < len(a) and m < len(b) and (n, m) not in opened:
                opened.add((n, m))
                heapq.heappush(heap, (float(a[n] + b[m]), n, m))
    return out


Index = dict[tuple[str, int], tuple[np.ndarray, np.ndarray, float]]


def search_limit(x: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float) -> float:
    """Up to which cost cells are visited, from the sample ``x``."""
    half, most = x.shape[1] // 2, 2 - 2 * threshold + SLACK
    limit = most * DEVIATIONS**2 / x.shape[1]
    own1, b1 = code_bounds(x[:, :half], one)
    own2, b2 = code_bounds(x[:, half:], two)
    costs = [np.zeros(0)]
    for at in range(0, len(x), 512):
        i, j = np.nonzero(x[at : at + 512] @ x.T >= threshold)
        i, j = i[i + at < j] + at, j[i + at < j]
        costs.append(np.minimum(b1[i, own1[j]] ** 2 + b2[i, own2[j]] ** 2, b1[j, own1[i]] ** 2 + b2[j, own2[i]] ** 2))
    cost = np.concatenate(costs)
    return min(most, max(limit, float(np.quantile(cost, RECALL)) if len(cost) else 0.0))


def fit(rows: DataFrame, threshold: float) -> Index:
    """Codebook pairs and limits by (label, dimensions), from a bounded sample; (OTHERS, dimensions) for labels without their own."""
    counts = cut(rows.where(F.col("dim") > 1).groupBy("label", "dim").agg(F.count("*").alias("n")))
    kinds = [(r["label"], r["dim"], r["n"]) for r in counts.where(F.col("n") > CELL).orderBy(F.desc("n"), "label", "dim").limit(LABELS + 1).collect()]
    own, found = kinds[:LABELS], {}
    if not own:
        return found
    sizes = {(label, dim): n for label, dim, n in own}
    group = F.when(F.concat_ws("/", F.hex(F.encode("label", "utf-8")), "dim").isin([f"{label.encode().hex().upper()}/{dim}" for label, dim, _ in own]), F.col("label")).otherwise(OTHERS)
    grouped = rows.where(F.col("dim") > 1).withColumn("label", group)
    if len(kinds) > LABELS:
        rest = counts.withColumn("label", group).where(F.col("label") == OTHERS).groupBy("dim").agg(F.max("n").alias("n"), F.sum("n").alias("all")).orderBy(F.desc("all"), "dim").limit(8).collect()
        sizes |= {(OTHERS, r["dim"]): r["n"] for r in rest}
        totals = sizes | {(OTHERS, r["dim"]): r["all"] for r in rest}
    else:
        totals = sizes
    budget = SAMPLE_BYTES // (8 * max(dim for _, dim in sizes)) // len(sizes)
    most = max(1, min(SAMPLE, budget))
    share = F.create_map(*[v for (label, dim), n in totals.items() for v in (F.lit(f"{label}/{dim}"), F.lit(min(1.0, 1.2 * most / n)))])
    wanted = F.try_element_at(share, F.concat_ws("/", "label", "dim"))
    sample: dict[tuple[str, int], list] = {}
    chosen = grouped.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) <= wanted * (1 << 20)).select("label", "dim", "v").orderBy(F.xxhash64("v")).limit(most * len(sizes))
    for r in chosen.collect():
        sample.setdefault((r["label"], r["dim"]), []).append(np.frombuffer(r["v"], np.float64))
    for key, vs in sample.items():
        x = unit(np.stack(vs))
        codes = int(min(CODES, len(vs) / 4, CODE_BYTES / (8 * key[1] * len(sizes)), (sizes[key] / CELL) ** 0.5))
        if codes > 1:
            half = x.shape[1] // 2
            one, two = codebook(x[:, :half], codes), codebook(x[:, half:], codes)
            found[key] = one, two, search_limit(x, one, two, threshold)
    return found


_PROBE = "label string, dim int, c1 int, c2 int, member boolean, own int, visits binary, rep long, weight long, v binary"


def _probe(index: Index, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class's own cell and the others that it searches; ``visits`` lists them all, for members."""
    for batch in stream:
        out: list[tuple] = []
        rows: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())):
            rows.setdefault(key, []).append(i)
        raw, reps, weights = (batch.column(c).to_pylist() for c in ("v", "rep", "weight"))
        for key, at in rows.items():
            books = index.get(key) or index.get((OTHERS, key[1]))
            if books is None:  # one cell for all
                out += [(*key, 0, 0, True, 0, b"", reps[i], weights[i], raw[i]) for i in at]
                continue
            one, two, limit = books
            for part in range(0, len(at), 4096):
                some = at[part : part + 4096]
                x = unit(np.stack([np.frombuffer(raw[i], np.float64) for i in some]))
                half = x.shape[1] // 2
                own1, b1 = code_bounds(x[:, :half], one)
                own2, b2 = code_bounds(x[:, half:], two)
                for k, i in enumerate(some):
                    cells = multi_sequence(b1[k], b2[k], limit)
                    own, visits = (int(own1[k]), int(own2[k])), np.array([a << 16 | b for a, b in cells], np.int32).tobytes()
                    out += [(*key, *c, c == own, own[0] << 16 | own[1], visits if c == own else None, reps[i], weights[i], raw[i]) for c in cells]
        names = [c.split()[0] for c in _PROBE.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 10, kinds)], names)


def _compare(threshold: float, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks: per query the rows linked, and one link into each group of members linked among themselves.

    Members linked with a query whose cell they don't visit themselves are counted too, without a link.
    """
    columns = ("dim", "cell", "q_reps", "q_weights", "q_own", "q_vs", "m_reps", "m_weights", "m_visits", "m_vs")
    for batch in stream:
        out: list[tuple] = []
        for dim, cell, qs, qw, own, qv, ms, mw, visits, mv in zip(*[batch.column(c).to_pylist() for c in columns]):
            q, m = (unit(np.frombuffer(b"".join(v), np.float64).reshape(-1, dim)) for v in (qv, mv))
            qs, qw, own, ms, mw = (np.array(v) for v in (qs, qw, own, ms, mw))
            hit = (q @ m.T >= threshold) & (qs[:, None] != ms[None])
            count = hit @ mw
            group = _groups(m, threshold)
            for i in np.flatnonzero(count):
                j = np.flatnonzero(hit[i])
                _, firsts = np.unique(group[j], return_index=True)
                out += [(qs[i], count[i] if k == 0 else 0, ms[j[f]]) for k, f in enumerate(firsts)]
            strange = np.flatnonzero(own != cell)
            back = hit[strange]
            for j in np.flatnonzero(back.any(axis=0)):
                i = strange[np.flatnonzero(back[:, j])]
                n = qw[i][~np.isin(own[i], np.frombuffer(visits[j], np.int32))].sum()
                if n:
                    out.append((ms[j], n, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [()] * 3], ["rep", "n", "other"])


def _groups(m: np.ndarray, threshold: float) -> np.ndarray:
    """Components of a block's members by their links among themselves."""
    near = m @ m.T >= threshold
    group, n = np.full(len(m), -1), 0
    for i in range(len(m)):
        if group[i] < 0:
            front = np.zeros(len(m), bool)
            front[i] = True
            while front.any():
                group[front] = n
                front = near[front].any(axis=0) & (group < 0)
            n += 1
    return group


def near_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    spark = df.sparkSession
    v = F.col("v")
    rows = df.select(df[id_column].cast("long").alias("vec_id"), df[vector].cast("array<double>").alias("v"), df[label].cast("string").alias("label"))
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("dim", F.when(F.col("label").isNotNull() & sound, F.size(v)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([None if d is None else np.array(x.as_py(), np.float64).tobytes() for d, x in zip(b.column(2).to_pylist(), b.column(3))], pa.binary())], ["vec_id", "label", "dim", "v"])

    rows = cut(rows.select("vec_id", "label", "dim", "v").mapInArrow(packed, "vec_id long, label string, dim int, v binary"))
    real = rows.where("dim is not null and vec_id is not null").withColumn("h", F.sha2("v", 256))
    counts = real.groupBy("label", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    members = cut(real.select("vec_id", "label", "h").join(cut(counts), ["label", "h"]).select("vec_id", "label", "rep", "weight"))
    classes = cut(real.join(members.where("vec_id = rep").select("vec_id", "label", "rep", "weight").distinct(), ["vec_id", "label"]).dropDuplicates(["label", "h"]).select("label", "dim", "rep", "weight", "v"))
    index = fit(classes, threshold)
    probes = cut(classes.mapInArrow(lambda stream: _probe(index, stream), _PROBE))
    cell = ["label", "dim", "c1", "c2"]
    sizes = cut(probes.groupBy(*cell).agg(F.count_if("member").alias("members"), F.count("*").alias("queries")).where("members > 0"))
    placed = probes.join(sizes, cell)
    blocked = lambda n: F.pmod(F.xxhash64("rep"), F.ceil(F.col(n) / BLOCK)).cast("int")
    gather = lambda prefix, names: [F.collect_list(c).alias(f"{prefix}_{n}") for c, n in names.items()]
    m = placed.where("member").groupBy(*cell, blocked("members").alias("mb")).agg(*gather("m", {"rep": "reps", "weight": "weights", "visits": "visits", "v": "vs"}))
    q = placed.groupBy(*cell, blocked("queries").alias("qb")).agg(*gather("q", {"rep": "reps", "weight": "weights", "own": "own", "v": "vs"}))
    m, q = cut(m), cut(q)
    pairs = q.join(m, cell).repartition(2 * partitions(spark), *cell, "qb", "mb").withColumn("cell", F.expr("c1 * 65536 + c2"))
    pairs = pairs.select("dim", "cell", "q_reps", "q_weights", "q_own", "q_vs", "m_reps", "m_weights", "m_visits", "m_vs")
    links = cut(pairs.mapInArrow(lambda s: _compare(threshold, s), "rep long, n long, other long"))
    discard(probes, sizes, m, q, classes)
    found = components(links, "rep", "other")
    per = cut(links.groupBy("rep").agg(F.sum("n").alias("n")).join(found.withColumnRenamed("node", "rep"), "rep", "left"))
    linked = members.join(per, "rep", "left").select(F.col("vec_id").alias("__id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("__component"))
    linked = linked.groupBy("__id").agg(F.max("n_links").alias("n_links"), F.min("__component").alias("__component"))
    out = rows.select("vec_id").join(cut(linked), F.col("vec_id") == F.col("__id"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("__component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
