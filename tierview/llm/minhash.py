"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Each text's set of distinct 5-word shingles gets a 128-place MinHash signature; texts with equal
   sets form a class, and one row a class goes on.
2. Signatures are cut into 32 bands of 4. Documents at similarity 0.85 share none with probability 6e-11.
3. In every band's bucket each document is first paired with the bucket's first and last document
   only. Signatures are compared 16 places at a time, and a pair is dropped as soon
   as the posterior probability (uniform prior) that its similarity reaches the threshold falls below
   ``MISS``. Survivors are verified on full shingle sets: first each document's two likeliest, then all others whose ends
   these have not linked yet.
4. Pairs that survive pruning for a lower similarity, 0.7, make families. A bucket whose other documents
   are of several families has the signatures of those outside its largest family compared with all of
   them, block by block, and families with a pair that survives pruning are joined.
5. What that leaves apart is settled on full sets. A family that still holds several components has each document outside
   its largest one compared with all its documents, block by block. Blocks are dealt out, and a
   task returns only links that join families or components, so no group's pairs are ever written.

Defined cases: null or blank texts have no shingles and are linked with nothing; fewer than five words
make one shingle; a null id is its own component (null) and kept; rows that repeat an id share
its component; equal texts are linked; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import row_ranges
from .common import cut, discard, few, partitions, table
from .components import components

PLACES, ROWS, STEP, MISS, PERCENT, WORDS = 128, 4, 16, 1e-5, 85, 5
#: Similarity in percent that pairs of one family may have; bytes of text and signatures in a block; pairs compared at once.
FAMILY, BLOCK_BYTES, BLOCK_SIGNATURES, TILE = 70, 500_000, 2_000, 200_000
#: Pairs of signatures, bytes of text, and texts or pairs of them, that make a task worth while, where more shuffle partitions are set.
TASK_SIGNATURES, TASK_BYTES, TASK_TEXTS = 4_000_000, 2_000_000, 2_000
WORDS_KEPT = 500_000


class WordHashes(dict):
    """64-bit hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS_KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def words_of(text: str | None) -> list[bytes]:
    """Words of bytes other than space and 09-0D, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def sequence_hashes(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hash of every run of ``k`` words; with fewer, of the whole sequence; with none, nothing."""
    if not len(words):
        return words
    n = min(k, len(words))
    mixed = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        mixed = (mixed ^ words[j : len(words) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def shingle_set(text: str | None, cache: WordHashes, k: int = WORDS) -> np.ndarray:
    return np.unique(sequence_hashes(word_hashes(text, cache), k))


def permutations(n: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(add), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (x[at : at + 2048, None] * multiply + add).min(axis=0), out=out)
    return out


def least_matches(threshold: float, places: int = PLACES, step: int = STEP, miss: float = MISS) -> list[tuple[int, int]]:
    """(compared, fewest matches to go on): below, P(similarity >= threshold | matches) < miss under a uniform prior."""
    out = []
    for n in range(step, places + 1, step):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def prune(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of signature pairs that survive all batches, and their matches."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in bounds:
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive, matches


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two shingle sets have 100 * intersection >= percent * union."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig, bands): h1 and h2 name the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache, (multiply, add) = WordHashes(), permutations()
        for batch in batches:
            for at, to in row_ranges(batch.column(1)):
                sizes, h1, h2, sigs, bands = [], [], [], [], []
                for text_ in batch.column(1).slice(at, to - at).to_pylist():
                    s = shingle_set(text_, cache)
                    sizes.append(len(s))
                    name = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    h1.append(int(name[0]))
                    h2.append(int(name[1]))
                    if not len(s):
                        sigs.append(None)
                        bands.append([])
                        continue
                    sig = signature(s, multiply, add)
                    raw = sig.tobytes()
                    sigs.append(raw)
                    bands.append([xxhash.xxh64_intdigest(raw[4 * ROWS * j : 4 * ROWS * (j + 1)], j) - (1 << 63) for j in range(PLACES // ROWS)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "h1", "h2", "sig", "bands"],
                )

    return df.select(df[id_column].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), PLACES)


def likely(pairs: DataFrame, sigs: DataFrame, percent: int, rows: int) -> DataFrame:
    """(x, y, matches) of the about ``rows`` ``pairs`` (x, y) that survive pruning."""
    bounds = least_matches(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive, matches = prune(_matrix(batch.column("sx")), _matrix(batch.column("sy")), bounds)
            rows = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column("x").take(rows), batch.column("y").take(rows), pa.array(matches, pa.int64())], ["x", "y", "matches"])

    of_x, of_y = sigs.select(F.col("doc_id").alias("x"), F.col("sig").alias("sx")), sigs.select(F.col("doc_id").alias("y"), F.col("sig").alias("sy"))
    return few(few(few(pairs, rows).join(of_x, "x"), rows).join(of_y, "y"), rows).select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long, matches long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, rows: int) -> DataFrame:
    """The about ``rows`` ``pairs`` (x, y) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, kept = WordHashes(), {}
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            ok = []
            for a, b, i in zip(x, y, range(len(x))):
                if b not in kept:  # rows come sorted by y
                    kept = {b: shingle_set(batch.column("ty")[i].as_py(), cache)}
                ok.append(linked(shingle_set(batch.column("tx")[i].as_py(), cache), kept[b], percent))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

    of_x, of_y = texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty"))
    joined = few(few(few(pairs.select("x", "y"), rows).join(of_x, "x"), rows, TASK_TEXTS).join(of_y, "y"), rows, TASK_TEXTS)
    return joined.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def apart(pairs: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """The about ``rows`` ``pairs`` (x, y) whose components in ``found`` (node, component) differ; a node that isn't there is its own."""
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"__{side}")).hint("merge")
    both = few(pairs.select("x", "y").join(of("x"), "x", "left"), rows).join(of("y"), "y", "left")
    return cut(both.where(F.coalesce("__x", "x") != F.coalesce("__y", "y")).select("x", "y"), rows=rows)


def across(bands: DataFrame, families: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between families with a likely pair in one bucket, none needless within one pair of blocks.

    ``bands`` has (key, doc_id, low, high), ``families`` (doc_id, family). A bucket's ``low`` and ``high``
    have been compared with all its documents; of the others, those outside the largest family are
    compared with all. A document that no pair put into a family is its own.
    """
    inner = bands.where("doc_id != low and doc_id != high").select("key", "doc_id")
    rows = inner.count()
    placed = cut(inner.join(families, "doc_id", "left").select("key", "doc_id", F.coalesce("family", "doc_id").alias("family")), rows=rows)
    size = cut(placed.groupBy("key", "family").agg(F.count("*").alias("n")), rows=rows)
    mixed = size.groupBy("key").agg(F.max(F.struct("n", "family")).alias("top"), F.sum("n").alias("docs"), F.count("*").alias("parts")).where("parts > 1")
    mixed = cut(mixed.select("key", F.col("top.family").alias("top"), F.ceil(F.col("docs") / BLOCK_SIGNATURES).alias("blocks"), F.ceil((F.col("docs") - F.col("top.n")) / BLOCK_SIGNATURES).alias("few_blocks"), (F.col("docs") * (F.col("docs") - F.col("top.n"))).alias("work")), rows=rows)
    work = mixed.agg(F.sum("work")).first()[0] or 0
    dealt = cut(few(placed.join(mixed.drop("work"), "key"), rows).join(sigs.select("doc_id", "sig"), "doc_id"), rows=rows)

    def blocks(some: DataFrame, count: str, prefix: str) -> DataFrame:
        block = F.pmod(F.xxhash64("doc_id"), F.col(count))
        return cut(some.groupBy("key", block.alias(f"{prefix}block")).agg(*[F.collect_list(c).alias(f"{prefix}{c}") for c in ("family", "sig")]), rows=rows)

    pairs = blocks(dealt.where("family != top"), "few_blocks", "x_").join(blocks(dealt, "blocks", "y_"), "key")
    pairs = few(pairs.repartition(2 * partitions(bands.sparkSession), "key", "x_block", "y_block"), work, TASK_SIGNATURES)
    bounds = least_matches(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs: list[int] = []
            ys: list[int] = []
            for i in range(len(batch)):
                x, y = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("x_family", "y_family"))
                for a, b in joining_families(x, _matrix(batch.column("x_sig")[i].values), y, _matrix(batch.column("y_sig")[i].values), bounds):
                    xs.append(a)
                    ys.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    return pairs.select("x_family", "x_sig", "y_family", "y_sig").mapInArrow(run, "x long, y long")


def joining_families(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links between families x and y of signatures that survive pruning, one for each two that aren't joined yet."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    (first, least), places = bounds[0], np.ascontiguousarray(ys[:, : bounds[0][0]].T)
    out = []
    tile = max(1, TILE // len(y))
    for at in range(0, len(x), tile):
        matches = np.zeros((len(x[at : at + tile]), len(y)), np.uint8)
        for p in range(first):
            matches += xs[at : at + tile, p, None] == places[p]
        i, j = np.nonzero((matches >= least) & (x[at : at + tile, None] != y))
        total, i, done = matches[i, j].astype(np.int64), i + at, first
        for n, fewest in bounds[1:]:
            total = total + (xs[i, done:n] == ys[j, done:n]).sum(axis=1)
            keep = total >= fewest
            total, i, j, done = total[keep], i[keep], j[keep], n
        for a, b in zip(x[i].tolist(), y[j].tolist()):
            c, d = find(a), find(b)
            if c != d:
                root[c] = d
                out.append((a, b))
    return out


def settle(labels: DataFrame, families: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) that join the components within each family, none needless within one pair of blocks.

    ``labels`` has (doc_id, component), ``families`` (doc_id, family). A family's documents outside
    its largest component are compared on full shingle sets with all of its documents, block by
    block: an inverted index over one block's shingles counts a document's intersections with all.
    """
    placed = cut(labels.join(families, "doc_id"))
    rows = placed.count()
    size = placed.groupBy("family", "component").agg(F.count("*").alias("n"))
    # One number orders components by size, then by name.
    rank = F.col("n").cast("decimal(17,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + F.col("component").cast("decimal(19,0)")
    size = cut(size.withColumn("rank", rank.cast("decimal(38,0)")), rows=rows)
    mixed = cut(size.groupBy("family").agg(F.max("rank").alias("top"), F.count("*").alias("parts")).where("parts > 1"), rows=rows)
    aside = cut(size.join(mixed, "family").select("family", "component", (F.col("rank") != F.col("top")).alias("aside")), rows=rows)
    chosen = placed.join(aside, ["family", "component"]).select("family", "component", "doc_id", "aside")
    docs = few(chosen, rows).join(texts, "doc_id").select("family", "component", "doc_id", "aside", "text", F.octet_length("text").alias("n"))
    docs = cut(few(docs, rows, TASK_TEXTS))
    bulk = docs.groupBy("family").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("aside"), F.col("n"))).alias("few"))
    bulk = bulk.select("family", "n", "few", F.ceil(F.col("n") / BLOCK_BYTES).alias("blocks"), F.ceil(F.col("few") / BLOCK_BYTES).alias("few_blocks"))
    bulk = cut(bulk, rows=rows)
    every, work = bulk.agg(F.sum("n"), F.sum(F.col("n") * F.greatest("few_blocks", F.lit(1)) + F.col("few") * F.greatest("blocks", F.lit(1)))).first()
    dealt = docs.join(bulk.drop("n", "few"), "family")

    def blocks(some: DataFrame, count: str, prefix: str) -> DataFrame:
        block = F.pmod(F.xxhash64("doc_id"), F.greatest(F.col(count), F.lit(1)))
        out = some.groupBy("family", block.alias(f"{prefix}block")).agg(*[F.collect_list(c).alias(f"{prefix}{c}") for c in ("doc_id", "component", "text")])
        return cut(few(out, every or 0, TASK_BYTES))

    pairs = blocks(dealt.where("aside"), "few_blocks", "x_").join(blocks(dealt, "blocks", "y_"), "family")
    pairs = few(pairs.repartition(2 * partitions(labels.sparkSession), "family", "x_block", "y_block"), work or 0, TASK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            xs: list[int] = []
            ys: list[int] = []
            for i in range(len(batch)):
                x, xc, xt, y, yc, yt = (batch.column(c)[i].as_py() for c in ("x_doc_id", "x_component", "x_text", "y_doc_id", "y_component", "y_text"))
                for a, b in joining(x, xc, [shingle_set(t, cache) for t in xt], y, yc, [shingle_set(t, cache) for t in yt], percent):
                    xs.append(a)
                    ys.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    columns = [f"{p}{c}" for p in ("x_", "y_") for c in ("doc_id", "component", "text")]
    return pairs.select(*columns).mapInArrow(run, "x long, y long")


def joining(x: list[int], xc: list[int], xs: list[np.ndarray], y: list[int], yc: list[int], ys: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between documents x and y, one for each pair of components that isn't joined yet."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    sizes = np.array([len(s) for s in ys])
    shingles = np.concatenate(ys)
    owners = np.repeat(np.arange(len(ys)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owners = shingles[order], owners[order]
    out = []
    for doc, component, s in zip(x, xc, xs):
        low, high = np.searchsorted(shingles, s, "left"), np.searchsorted(shingles, s, "right")
        many = high - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        both = np.bincount(owners[at], minlength=len(ys))
        for j in np.flatnonzero((100 * both >= percent * (len(s) + sizes - both)) & (both > 0)).tolist():
            a, b = find(component), find(yc[j])
            if a != b:
                root[a] = b
                out.append((doc, y[j]))
    return out


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept."""
    docs = df.select(df[id_column].cast("long").alias("doc_id"), df[text].alias("text"))
    sig = cut(signatures(docs, "doc_id", "text"))
    rows = sig.count()
    real = sig.where("n_shingles > 0 and doc_id is not null")
    classes = cut(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), rows=rows)
    member = cut(real.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "rep"), rows=rows)
    reps = classes.select("h1", "h2", F.col("rep").alias("doc_id"))
    sigs = few(real.select("doc_id", "h1", "h2", "sig", "bands").join(reps, ["doc_id", "h1", "h2"], "left_semi"), rows)
    sigs = cut(sigs.dropDuplicates(["doc_id", "h1", "h2"]).select("doc_id", "sig", "bands"), rows=rows)
    bands = sigs.select("doc_id", F.explode("bands").alias("key"))
    ends = cut(bands.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"), rows=rows * PLACES // ROWS)
    bands = cut(bands.join(ends, "key").select("key", "doc_id", "low", "high"), rows=rows * PLACES // ROWS)
    many = 2 * bands.count()
    pairs = bands.where("doc_id != low").select(F.col("doc_id").alias("x"), F.col("low").alias("y")).union(bands.where("doc_id != high and doc_id != low").select(F.col("doc_id").alias("x"), F.col("high").alias("y"))).distinct()
    near = cut(likely(pairs, sigs.select("doc_id", "sig"), FAMILY, many))
    best = Window.partitionBy("x").orderBy(F.desc("matches"), "y")
    ids = few(bands.select("doc_id").distinct(), rows)
    texts = cut(few(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), rows, TASK_TEXTS))
    sure = near.where(F.col("matches") >= least_matches(percent / 100)[-1][1])
    likely_ = sure.count()
    links = cut(verified(sure.withColumn("__n", F.row_number().over(best)).where("__n <= 2"), texts, percent, likely_))
    found = components(links, "x", "y")
    open_ = apart(sure, found, likely_)
    if n_open := open_.count():
        links = cut(links.union(verified(open_, texts, percent, n_open)))
        found = components(links, "x", "y")
    families = components(near, "x", "y").select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    met = cut(across(bands, families, sigs, percent))
    if not met.isEmpty():
        # A family's name is one of its documents, so a document not yet in a family comes in by name.
        merged = components(met, "x", "y").select(F.col("node").alias("__node"), F.col("component").alias("__to"))
        alone = merged.join(families, F.col("__node") == F.col("doc_id"), "left_anti").select(F.col("__node").alias("doc_id"), F.col("__to").alias("family"))
        families = cut(families.join(merged, F.col("family") == F.col("__node"), "left").select("doc_id", F.coalesce("__to", "family").alias("family")).union(alone), rows=rows)
    labels = few(families.select("doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")), rows)
    more = cut(settle(labels, families, texts, percent))
    discard(texts, bands, near)
    if not more.isEmpty():
        found = components(links.union(more), "x", "y")
    grouped = member.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(F.col("doc_id").alias("__id"), F.coalesce("component", "rep").alias("__component"))
    grouped = cut(few(grouped, rows).groupBy("__id").agg(F.min("__component").alias("__component")), rows=rows)
    return (
        sig.select("doc_id", "n_shingles")
        .join(grouped, F.col("doc_id") == F.col("__id"), "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("__component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op8_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
