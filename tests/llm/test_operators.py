"""Each operator against brute force, a round trip or the library that defines its results, and its edge cases."""

import hashlib
import random
import struct
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tierview.llm import bpe, hilbert, language, minhash, multiindex, ogg, packing, passages, queries, rotation, suffix

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sample(spark, rows=None, empty=False):
    """Documents with null columns, empty, blank, short, long, repeated and equal texts, and extra columns."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=80)) for _ in range(3)]
    made = rows or [
        (7, base[0], "en", "a", 1), (3, base[0], "en", "a", 1), (3, base[0], "en", "a", 1), (9, base[0].replace("w5", "x"), None, None, None), (1, None, "en", "b", None), (2, "", "en", "b", 0), (4, " \t\n", "en", "b", 3),
        (None, base[0], "fr", "c", 1), (None, None, None, None, None), (5, "one two", "en", "b", 7), (6, "ONE Two", "en", "b", 7), (8, base[1] + " " + base[2], "en", "b", 9), (10, base[2] + " é€ 🤦", "en", "b", 9), (11, "a" * 300, "en", "d", 300), (12, base[1] * 60, "en", "d", 1),
    ]
    df = spark.createDataFrame([] if empty else made, DOCS)
    return df.withColumn("id", F.lit("clash")).withColumn("chunk", F.lit(1)).withColumn("sig", F.lit(None).cast("string")), [] if empty else made


@pytest.mark.parametrize("empty", [False, True])
def test_hilbert(spark, empty):
    df, rows = sample(spark, empty=empty)
    dims = {"lang": hilbert.quantise_text("lang"), "size": hilbert.quantise_size(F.octet_length("text"))}
    out = hilbert.hilbert_shards(df.select("doc_id", "lang", "text"), dims, ["doc_id"], 4).collect()
    assert len(out) == len(rows)
    shards = [[r for r in out if r["shard"] == s] for s in range(4)]
    assert max(map(len, shards)) - min(map(len, shards)) <= 1 and all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards)
    ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert_index"] for r in ordered] == sorted(r["hilbert_index"] for r in out)


def test_hilbert_curve_is_one_walk(spark):
    grid = spark.range(16**2).select((F.col("id") % 16).cast("int").alias("x"), F.floor(F.col("id") / 16).cast("int").alias("y"))
    walk = [(r["x"], r["y"]) for r in hilbert.with_hilbert_index(grid, {"a": F.col("x"), "b": F.col("y")}, "h").orderBy("h").collect()]
    assert len(set(walk)) == 256 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(walk, walk[1:]))


def test_hilbert_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.QUERIES["op2_hilbert_shards"](spark, SF)
    hilbert.write_shards(docs, out, "doc_id", f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == docs.count() and back.select("shard_id").distinct().count() == 16
    crc = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out.collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        assert crc[r["doc_id"]] == (len(raw) + 1, zlib.crc32(raw))
    assert hilbert.manifest(out, ["size"]).count() == 16


def test_multi_index(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.normal(size=16) * rng.choice([0, 0.03, 0.3])
        rows.append((i if i % 40 else i // 40 * 40, [float(x) for x in v.astype(np.float32)], int(i % 2) if i % 17 else None))
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [float("inf")] + [1.0] * 15, 0), (1005, [1.0] * 8, 0), (1006, [2.0] * 8, 0), (1007, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit("clash")).withColumn("rep", F.lit(1))
    got = {r["vec_id"]: r for r in multiindex.near_vectors(df).collect()}
    good = [(i, np.array(v), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    parent = {i: i for i, _, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = {i: 0 for i in parent}
    for a, (i, v, lab) in enumerate(good):
        for j, w, other in good[:a]:
            if lab == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i], links[j] = links[i] + 1, links[j] + 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in parent}
    assert multiindex.near_vectors(df.limit(0)).count() == 0


def test_multi_sequence_order():
    a, b = np.array([0.3, 0.0, 0.1]), np.array([0.2, 0.0])
    cells = multiindex.multi_sequence(a, b, 0.06)
    cost = [a[i] ** 2 + b[j] ** 2 for i, j in cells]
    assert cost == sorted(cost) and len(cells) == sum(x**2 + y**2 <= 0.06 for x in a for y in b)


def small_bins(items, room):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for r in sorted(set(bins)):
            if r >= items[i]:
                left = list(bins)
                left[left.index(r)] -= items[i]
                go(i + 1, left)
        go(i + 1, [*bins, room - items[i]])

    go(0, [])
    return best[0] if items else 0


def test_dominance_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(150):
        items = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))]
        stock = packing.Stock({x: items.count(x) for x in items})
        fixed = packing.reduce_by_dominance(stock, 20)
        rest = [s for s, n in stock.counts.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + small_bins(rest, 20) == small_bins(items, 20)
        plan = packing.plan({x: items.count(x) for x in items}, 20)
        assert sorted(s for p, n in plan for s, k in p for _ in range(k * n)) == sorted(items) and all(sum(s * k for s, k in p) <= 20 for p, _ in plan)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    df, rows = sample(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    out = packing.pack(packing.cut(packing.pieces(df, path, capacity=256, keep_ids=True)), 256).collect()
    total = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r["length"] for r in out) == total
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == 256)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    lengths = [r["length"] for r in out]
    assert len(seqs) == lengths.count(256) + small_bins([n for n in lengths if n < 256], 256)
    long = sorted((r["start"], bytes(r["ids"])) for r in out if r["doc_id"] == 12)
    assert struct.pack(f"<{sum(len(b) for _, b in long) // 4}I", *library.encode(rows[-1][1]).ids, 0) == b"".join(b for _, b in long)
    assert packing.pack(packing.cut(packing.pieces(df.limit(0), path))).count() == 0


HARD = ["a", "B", "th", "ing", " ", "  ", "\n", "\n\n", " \n", "\t", ".", "'s", "'ll", "É", "ß", "1", "23", "½", "²", "€", "Ω", "Σ", "ς", "中", "é", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|", "İ", "🤦", "%%%", "\r\n", "ﬁ"]


def test_tokenizers_agree_with_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["".join(rng.choices(HARD, k=rng.randrange(0, 30))) for _ in range(1500)]
    byte_path, word_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    fast, library = packing.RankTokenizer(byte_path), Tokenizer.from_file(byte_path)
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in map(fast.encode, texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    library = Tokenizer.from_file(word_path)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (None, "a", "x")], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in bpe.bpe_encode(df, word_path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), t
    assert got[-1]["n_tokens"] == 0 and None in got
    assert bpe.bpe_encode(df.limit(0), word_path).count() == 0


def test_speculation_is_used():
    import public_tokenizers

    b = bpe.SpeculativeBpe(public_tokenizers.path("word_bpe_49k.json"))
    words = ["the", "understanding", "tokenization", "zzqx", "in", "information"]
    assert b.encode_words(words) == [b.merge(b.symbols(w)) for w in words] and b.encode_words([]) == []
    assert b.tried == 6 and b.merged < 6


def test_word_batches(spark):
    """Batches without a new word, without any word, and words long enough for the heap, which gives what the list gives."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, b = Tokenizer.from_file(path), bpe.SpeculativeBpe(path)
    for texts in (["", ""], ["one two"], ["two one", ""], ["two"]):
        assert [list(struct.unpack(f"<{len(i) // 4}I", i)) for i, _ in b.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    for rows in ([(1, None)], [(1, "")], [(1, None), (2, ""), (None, None)]):
        out = bpe.bpe_encode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
        assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out] == [(0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest())] * len(rows)
    rng = random.Random(12)
    for n in (2, 30, 47, 48, 49, 400, 30_000):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "thein"):
            word = "".join(rng.choices(letters, k=n))
            began = time.perf_counter()
            (got, text), *_ = b.encode_batch([word])
            assert time.perf_counter() - began < 5
            ids = library.encode(word, add_special_tokens=False).ids
            assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids and text == library.decode(ids, skip_special_tokens=False)
            if n < 500:
                assert b.merge(b.symbols(word)) == b.merge_long(b.symbols(word))
    b.letters_held = bpe.LETTERS_KEPT + 1
    assert [i for i, _ in b.encode_batch(["one two"])] == [struct.pack("<2I", *library.encode("one two", add_special_tokens=False).ids)] and len(b.number) == 2


def test_ogg_round_trip_and_damage():
    rng = random.Random(8)
    for n in (64, 128, 255, 4096, 4096 * 255, 4096 * 3 + 64, 255 * 255 * 2):
        payload = bytes(rng.getrandbits(8) for _ in range(min(n, 9000))) * (n // min(n, 9000) + 1)
        payload = payload[:n]
        for streams, packet in ((1, 255 * 300), (2, 4096), (3, 510)):
            media = ogg.mux(payload, streams, packet)
            back, found = ogg.demux(media)
            assert back == payload and len(found) == streams
            assert all(b - a == len(p) * 10**6 // ogg.RATE for s in found.values() for a, b, p in zip(s.starts_us[1:], s.starts_us[2:], s.packets[1:]) if len(p) == packet and len(p) * 10**6 % ogg.RATE == 0)
    media = ogg.mux(bytes(10_000))
    for at in (0, 5, 23, 40, len(media) - 3):
        with pytest.raises(ogg.OggError):
            ogg.demux(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    for broken in (media[:-5], media[: len(media) // 2], b"", b"OggS"):
        with pytest.raises(ogg.OggError):
            ogg.demux(broken)
    # Known value of the polynomial: bit by bit.
    crc = 0
    for byte in b"123456789":
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    assert ogg.checksum(b"123456789") == crc


def test_ogg_fuzzed():
    """Damage of any kind is an OggError; pages without packets, uneven streams and foreign streams too."""
    rng = random.Random(21)
    media = ogg.mux(bytes(rng.getrandbits(8) for _ in range(20_000)))
    for _ in range(400):
        broken = bytearray(media[: rng.randrange(len(media)) if rng.random() < 0.3 else len(media)])
        for _ in range(rng.randrange(1, 4)):
            if broken:
                broken[rng.randrange(len(broken))] ^= 1 << rng.randrange(8)
        try:
            assert ogg.demux(bytes(broken))[0] is not None
        except ogg.OggError:
            pass
    ident = lambda k, n, total: struct.pack(ogg._IDENT, ogg.MAGIC, ogg.RATE, k, n, total)
    packetless = ogg._page(ogg.FIRST | ogg.LAST, 0, 1, 0, b"", b"")
    uneven = b"".join(p for _, p in ogg._pages([ident(0, 2, 8)], 1)) + b"".join(p for _, p in ogg._pages([ident(1, 2, 8), b"abcd", b"efgh"], 2))
    foreign = b"".join(p for _, p in ogg._pages([b"other kind", b"abcd"], 7))
    for odd in (packetless, uneven, foreign):
        with pytest.raises(ogg.OggError):
            ogg.demux(odd)
    assert ogg.demux_streams(foreign)[7].starts_us == []


def test_letters():
    assert not any(map(language.has_letter, ("½ ²", "①", "12 _", "", "٣", "🤦"))) and all(map(language.has_letter, ("a", "½é", "中", "1²x")))


def test_network_by_force():
    """Pooling and softmax against plain loops."""
    net = language.ByteCnn(["a", "b"], language.Settings(window=16, filters=3, embedding=2))
    x = np.random.default_rng(1).integers(0, 256, (3, 16)).astype(np.uint8)
    for i, got in enumerate(net.probabilities(x)):
        h = []
        for f in range(net.convolve.shape[1]):
            sums = [sum(net.embed[x[i, p + j], d] * net.convolve[j * 2 + d, f] for j in range(net.wide) for d in range(2)) for p in range(16 - net.wide + 1)]
            h.append(max(0.0, max(sums) + net.bias[f]))
        z = np.exp(np.array(h) @ net.out + net.out_bias)
        assert np.allclose(got, z / z.sum(), atol=1e-5)


def test_long_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a" + " " * 1_200_000 + "b" + "\n" * 300
    assert np.frombuffer(packing.RankTokenizer(path).encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_hilbert_ranks_and_pruning(spark):
    """Ranks against one global order, and files skipped for filters on one and two dimensions; clashing names are replaced."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("shard", F.lit("clash"))
    dims = {"lang": hilbert.quantise_frequent(docs, "lang"), "source": hilbert.quantise_frequent(docs, "source"), "size": hilbert.quantise_size(F.octet_length("text"))}
    rows = docs.select("doc_id", "shard", *[c.alias(f"q_{n}") for n, c in dims.items()])
    out = hilbert.hilbert_shards(rows, {n: F.col(f"q_{n}") for n in dims}, ["doc_id"], 16)
    got = [(r["hilbert_index"], r["t"], r["doc_id"]) for r in out.withColumn("t", F.xxhash64("doc_id")).orderBy("shard", "slot").collect()]
    assert [h for h, _, _ in got] == sorted(h for h, _, _ in got) and len(got) == docs.count()
    sets = hilbert.manifest(out, [], [f"q_{n}" for n in dims]).collect()
    langs, sources = ({s for r in sets for s in r[f"set_q_{n}"]} for n in ("lang", "source"))
    skipped = lambda wanted: np.mean([not all(v in r[f"set_q_{n}"] for n, v in wanted.items()) for r in sets])
    one = np.mean([skipped({"lang": a}) for a in langs])
    two = np.mean([skipped({"lang": a, "source": b}) for a in langs for b in sources])
    print("shares of shards skipped", one, two)
    assert one > 0.2 and two > one


def test_ogg_columns(spark):
    df = spark.createDataFrame([(1, b"abc"), (2, None), (3, b"")], "doc_id long, media_in binary")
    out = ogg.with_payload(ogg.with_ogg(df, "media_in"), "media").withColumn("bad", F.substring("media", 1, 30))
    rows = {r["doc_id"]: r for r in ogg.with_payload(out, "bad", "broken").collect()}
    assert bytes(rows[1]["demuxed"]["payload"]) == b"abc" and rows[2]["media"] is None and bytes(rows[3]["demuxed"]["payload"]) == b""
    assert rows[1]["broken"]["payload"] is None and rows[1]["broken"]["error"]
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_ogg_media"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw = ogg.padded((r["text"] or "").encode())
        assert got[r["doc_id"]]["payload_sha256"] == hashlib.sha256(raw).hexdigest() and got[r["doc_id"]]["tail_crc32"] == zlib.crc32(raw[-64:])
    assert len(ogg.padded(b"")) == 64 and len(ogg.padded(bytes(65))) == 128


def near_by_force(rows, percent=85):
    cache = minhash.WordHashes()
    sets = [minhash.shingle_set(t, cache) for _, t, *_ in rows]
    parent = {}
    for i, *_ in rows:
        parent.setdefault(i, i)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and minhash.linked(sets[a], sets[b], percent):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                parent[y] = x
    return {i: find(i) for i in parent}, [len(s) for s in sets]


def test_near_duplicates(spark):
    df, rows = sample(spark)
    want, sizes = near_by_force(rows)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want
    assert sorted(r["n_shingles"] for r in got) == sorted(sizes)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) or r["doc_id"] is None for r in got)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicate_families(spark):
    """Chains of edited copies whose ends are far apart, in families large for one bucket."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(4):
        base = rng.choices(words, k=90)
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(90)] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
            if rng.random() < 0.3:
                base = t
    want, _ = near_by_force(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_in_crowded_buckets(spark):
    """A short pair that is mostly a passage of thousands of long documents, so that it is never first or last of a bucket."""
    rng = random.Random(34)
    words = [f"v{i}" for i in range(5000)]
    passage = rng.choices(words, k=44)
    rows = [(i, " ".join(passage + rng.choices(words, k=58))) for i in range(3000)]
    rows[1500:1502] = [(i, " ".join(passage + [f"{x}{k}" for k in (1, 2, 3)])) for i, x in ((1500, "x"), (1501, "y"))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(3000)} | {1501: 1500}


def test_small_tables_have_few_tasks(spark):
    """With many shuffle partitions that aren't merged, what is written between the steps has as many files as its rows are worth."""
    from tierview.llm import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 4000) if i % 4 < 3], "a long, b long")
    few = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        out = components.components(edges, "a", "b")
        assert len(out.inputFiles()) <= 12
        assert all(r["component"] == r["node"] // 4 * 4 for r in out.collect()) and out.count() == 4000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bayesian_bounds():
    bounds = minhash.least_matches(0.85)
    assert [n for n, _ in bounds] == list(range(16, 129, 16)) and all(0 < m < n for n, m in bounds)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, (400, 128), dtype=np.uint32)
    b = np.where(rng.random((400, 128)) < np.where(np.arange(400) < 200, 0.9, 0.3)[:, None], a, 0)
    alive, matches = minhash.prune(a, b, bounds)
    assert set(range(200)) == set(alive.tolist()) and (matches == (a[alive] == b[alive]).sum(1)).all()


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.fitted(docs)
    found = language.identify(docs, net).withColumn("held", language.held_out(F.col("doc_id")))
    right = found.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    df, _ = sample(spark)
    odd = {r["text"]: (r["lang_pred"], r["score"]) for r in language.identify(df, net).collect()}
    assert odd[None] == odd[""] == odd[" \t\n"] == ("und", 0.0) and all(0 <= s <= 1 for _, s in odd.values())
    assert language.identify(df, language.train(df.limit(0).select("text", "lang", F.col("doc_id").alias("key")))).select("lang_pred").distinct().first()[0] == "und"
    assert net.predict(["x" * 10_000])[0] == net.predict(["x" * 10_000])[0]


def repeats_by_force(rows, length=50):
    key = lambda i: 2**63 if i is None else i
    first = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            first[w] = min(first.get(w, 2**64), key(i))
    out = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < key(i):
                gone[p : p + length] = True
        out.append((i, len(raw), int(gone.sum()), bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats(spark, hot):
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("ab é"), rng.integers(0, 300))) for _ in range(12)]
    rows = [(int(rng.integers(0, 60)) if i % 9 else None, "".join(base[j][int(rng.integers(0, 50)) :] for j in rng.integers(0, 12, rng.integers(0, 4))) if i % 13 else None) for i in range(90)]
    rows += [(500, "a" * 1000), (501, "a" * 49), (502, "a" * 50), (499, "a" * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("clash"))
    got = suffix.remove_repeats(df, hot=hot, carry=["chunk"]).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got), key=str) == repeats_by_force(rows)
    assert all(r["__carried_chunk"] == "clash" and sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_repeats_edges(spark):
    df, rows = sample(spark)
    got = suffix.remove_repeats(df).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got), key=str) == repeats_by_force(rows)
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_previous_factors():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    at, owners = np.arange(350), np.repeat(np.arange(7), 50)[:350]
    places, factors = suffix.previous_factors(data, at, owners)
    text = data.tobytes()

    def force(i):
        best = 0
        for j in range(350):
            if owners[j] < owners[i]:
                k = 0
                while k < 50 and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
        return best

    assert factors.tolist() == [force(i) for i in places.tolist()]


def test_passages(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    shared = [list(rng.choice(words, 90)) for _ in range(3)]
    rows, first = [], {}
    for i in range(60):
        text = list(rng.choice(words, int(rng.integers(20, 300))))
        if i % 2:
            at = int(rng.integers(0, len(text)))
            text[at:at] = [w if rng.random() > 0.03 else "changed" for w in shared[i % 3]]
            first.setdefault(i % 3, i)
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (None, rows[1][1]), (102, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(0))
    got = passages.repeated_passages(df).collect()
    want = {i for i in range(60) if i % 2 and i != first[i % 3]}
    assert {r["doc_id"] for r in got if r["doc_id"] is not None} == want and any(r["doc_id"] is None for r in got)
    assert all(r["similarity"] >= 0.8 and r["end_word"] - r["start_word"] >= passages.MIN_WORDS for r in got)
    assert passages.repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("length, edits, even", [(55, 8, True), (40, 4, False), (60, 12, False)])
def test_edited_passages(spark, length, edits, even):
    """Copies of short passages with words substituted, at similarities from 0.9 down to 0.8."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(0, 80, 2):
        passage = rng.choices(words, k=length)
        places = [(2 * k + 1) * length // (2 * edits) for k in range(edits)] if even else rng.sample(range(length), edits)
        copy = [f"edit{j}" if j in places else w for j, w in enumerate(passage)]
        rows += [(i + k, " ".join(rng.choices(words, k=60) + part + rng.choices(words, k=60))) for k, part in enumerate((passage, copy))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["src_doc_id"] == r["doc_id"] - 1 and r["similarity"] >= 0.8 and 60 <= r["start_word"] < r["end_word"] <= 60 + length for r in got)
    assert len({r["doc_id"] for r in got}) >= {55: 40, 40: 38, 60: 34}[length]


def test_every_seed_proposes(spark):
    """Copies with each sixth word changed, so that six runs of five words are all they share with their source."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(20000)]
    rows = []
    for i in range(0, 800, 2):
        passage = rng.choices(words, k=35)
        copy = [f"edit{j}" if j % 6 == 5 else w for j, w in enumerate(passage)]
        rows += [(i + k, " ".join(rng.choices(words, k=9) + part)) for k, part in enumerate((passage, copy))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["src_doc_id"]) for r in got} == {(i + 1, i) for i in range(0, 800, 2)}


def test_first_holder_that_is_no_source(spark):
    """Document 1 has all seeds that 2 and 3 share, yet with too much between them; 4 equals 3, so that 3 alone is enough."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    parts = [rng.choices(words, k=20) for _ in range(3)]
    stuffed = lambda k: parts[0] + rng.choices(words, k=k) + parts[1] + rng.choices(words, k=k) + parts[2]
    made = [stuffed(15), stuffed(3), stuffed(3)]
    rows = [(i, " ".join(rng.choices(words, k=50) + passage + rng.choices(words, k=50))) for i, passage in enumerate([*made, made[2]], 1)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc_id"], r["src_doc_id"]) for r in got}
    assert {(3, 2), (4, 3)} <= found <= {(3, 2), (4, 3), (4, 2)}


def test_passages_without_sources_in_a_chunk(spark):
    """First and later copies in different partitions, and so in different chunks."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    rows = [(i, " ".join(rng.choices(words, k=40) + (passage if i % 2 else []) + rng.choices(words, k=40))) for i in range(6)]
    for parts in (6, 2, 1):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(parts, "doc_id")
        got = {(r["doc_id"], r["start_word"], r["end_word"], r["src_doc_id"]) for r in passages.repeated_passages(df).collect()}
        assert got == {(3, 40, 100, 1), (5, 40, 100, 1)}


def passages_by_force(rows):
    """Per document the words that a passage of any earlier document covers."""
    cache = minhash.WordHashes()
    texts = [minhash.word_hashes(t, cache).astype(np.uint32) for _, t in rows]
    out: dict[int, set[int]] = {}
    for k, x in enumerate(texts[1:], 1):
        for _, (a, b, *_) in passages.aligned([x] * k, texts[:k], [(0, len(x))] * k, [0] * k):
            out.setdefault(rows[k][0], set()).update(range(a, b))
    return out


def test_passages_by_force(spark):
    """Verbatim, edited and patchwork copies; the parts of the last also occur first in other documents."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    stock = [rng.choices(words, k=20) for _ in range(60)]
    made: list[list[str]] = []
    for i in range(300):
        text = rng.choices(words, k=rng.randrange(30, 120))
        kind = i % 5
        if i < 60:
            text += stock[i] + rng.choices(words, k=20)
        elif kind == 0:
            text += [w for part in rng.sample(stock, 3) for w in part]
        elif kind == 1:
            source = made[rng.randrange(60, i)]
            at = rng.randrange(max(1, len(source) - 60))
            text[10:10] = source[at : at + 60]
        elif kind == 2:
            source = made[rng.randrange(i)]
            text += [w if rng.random() > 0.1 else f"edit{i}" for w in source[:70]]
        made.append(text)
    rows = [(i, " ".join(t)) for i, t in enumerate(made)]
    want = passages_by_force(rows)
    got: dict[int, set[int]] = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    total = sum(map(len, want.values()))
    found = sum(len(w & got.get(i, set())) for i, w in want.items())
    assert total > 3000 and found >= 0.97 * total, (found, total)
    assert not set(got) - set(want)


def test_patchwork_passage(spark):
    """A copy of document 4 whose thirds first occur in documents 1, 2 and 3."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    thirds = [rng.choices(words, k=20) for _ in range(3)]
    rows = [(i, " ".join(rng.choices(words, k=50) + t + rng.choices(words, k=50))) for i, t in enumerate(thirds, 1)]
    rows += [(i, " ".join(rng.choices(words, k=50) + sum(thirds, []))) for i in (4, 5)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["src_doc_id"]) for r in got] == [(5, 50, 110, 4)]


def scattered_phrases():
    """Documents of three phrases of six words that occur first in three different earlier ones, and ten verbatim copies."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(20000)]
    phrases = [rng.choices(words, k=6) for _ in range(150)]
    passages_ = [rng.choices(words, k=50) for _ in range(10)]
    made = [rng.choices(words, k=40) + p + rng.choices(words, k=40) for p in [*phrases, *passages_]]
    at = rng.sample(range(150), 150)
    for k in range(0, 150, 3):
        made.append(rng.choices(words, k=40) + [w for j in at[k : k + 3] for w in [*phrases[j], *rng.choices(words, k=4)]] + rng.choices(words, k=40))
    made += [rng.choices(words, k=40) + p for p in passages_]
    return [(i, " ".join(t)) for i, t in enumerate(made)]


@pytest.mark.parametrize("apart", [True, False])
def test_hopeless_regions_stay_behind(spark, monkeypatch, apart):
    """Sources that can't share enough words get no region where the ids of chunks lie apart, nor alignment anywhere; copies are found."""
    rows, made = scattered_phrases(), []
    write = passages.cut
    monkeypatch.setattr(passages, "cut", lambda df, *a, **k: made.append(write(df, *a, **k)) or made[-1])
    monkeypatch.setattr(passages, "discard", lambda *a: None)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    df = df.repartitionByRange(3, "doc_id") if apart else df.repartition(3, F.col("doc_id") % 3)
    got = passages.repeated_passages(df).collect()
    assert {(r["doc_id"], r["src_doc_id"]) for r in got} == {(i + 210, i + 150) for i in range(10)}
    found = next(t for t in made if "shift" in t.columns)
    assert found.count() == 10 if apart else found.count() >= 10


def test_hopeful_by_force():
    """No pair of regions whose seeds cover enough words is left out, and most others are."""
    rng = np.random.default_rng(13)
    x = [rng.integers(0, 1 << 16, int(rng.integers(3, 200))).astype(np.uint16) for _ in range(400)]
    y = [rng.integers(0, 1 << 16, int(rng.integers(3, 200))).astype(np.uint16) for _ in range(400)]
    for i in range(0, 400, 2):
        n = min(len(x[i]), len(y[i]), int(rng.integers(3, 30)))
        y[i][len(y[i]) - n :] = x[i][:n]
    pair, at, to = passages.matches(x, y, np.zeros(400, np.int64))
    covered = [len({p + k for p in at[pair == i].tolist() for k in range(5)}) for i in range(400)]
    want = {i for i, n in enumerate(covered) if n >= passages.LEAST_COVER}
    got = set(passages.hopeful(x, y).tolist())
    assert 50 < len(want) < 150 and want <= got and len(got - want) <= 5


@pytest.mark.parametrize("order", ["apart", "interleaved", "overlapping"])
def test_regions_without_bounds(spark, monkeypatch, order):
    """The passages are those that all regions give, whatever the order of ids in chunks, equal and null ids included."""
    rng = random.Random(14)
    words = [f"w{i}" for i in range(400)]
    stock = [rng.choices(words, k=7) for _ in range(40)]
    made: list[list[str]] = []
    for i in range(240):
        text = [w for _ in range(rng.randrange(3, 12)) for w in [*rng.choice(stock), *rng.choices(words, k=rng.randrange(5))]]
        if i % 3 == 0 and i:
            text[5:5] = [w if rng.random() > 0.08 else "edit" for w in rng.choice(made)[:60]]
        made.append(text)
    rows = [(None if i % 60 == 59 else i - (i % 50 == 7), " ".join(t)) for i, t in enumerate(made)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.monotonically_increasing_id())
    df = {"apart": df.repartitionByRange(4, "doc_id"), "interleaved": df.repartition(4, "n"), "overlapping": df.repartitionByRange(4, F.col("doc_id") + F.col("doc_id") * 7 % 40)}[order]
    df = df.sortWithinPartitions("doc_id", "text").localCheckpoint()
    got = sorted(map(str, passages.repeated_passages(df).collect()))
    monkeypatch.setattr(passages.Matches, "coverable", lambda self, s, start, *_: np.full(len(start), np.inf))
    monkeypatch.setattr(passages, "hopeful", lambda x, y: np.arange(len(x)))
    assert got == sorted(map(str, passages.repeated_passages(df).collect())) and len(got) > 60


def test_sources_come_before(spark, monkeypatch):
    """Different seeds with equal short keys in one chunk, ids interleaved: no document after a row's own is its source."""
    found = passages.Seeds.found

    def collide(self):
        found(self)
        self.keys &= np.uint64(0xFFFFFFFF000000FF)
        return self

    monkeypatch.setattr(passages.Seeds, "found", collide)
    rng = random.Random(16)
    words = [f"w{i}" for i in range(3000)]
    parts = [rng.choices(words, k=40) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=5) + parts[i % 60] + rng.choices(words, k=5))) for i in range(180)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, F.col("doc_id") * 7 % 11)
    got = passages.repeated_passages(df).collect()
    assert all(r["src_doc_id"] < r["doc_id"] for r in got) and len(got) > 10


def test_among():
    rng = np.random.default_rng(15)
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 5, 3000):
            x = rng.integers(0, 1 << 32, 9000).astype(kind)
            x[: n // 2] = x[4000 : 4000 + n // 2]
            table = np.unique(np.concatenate([x[:n], rng.integers(0, 1 << 32, n).astype(kind)]))
            assert (passages.among(x, table) == np.isin(x, table)).all()
            assert passages.several(x).tolist() == [v for v, k in zip(*np.unique(x, return_counts=True)) if k > 1]


def test_chaining_by_force():
    rng = random.Random(2)
    for _ in range(60):
        frags = [(x, x + n, y, y + n, float(n)) for x, y, n in ((rng.randrange(60), rng.randrange(60), rng.randrange(1, 8)) for _ in range(rng.randrange(1, 9)))]

        def best(i):
            x0, _, y0, _, w = frags[i]
            return w + max([0.0, *(best(j) - 0.1 * (x0 - f[1] + y0 - f[3]) for j, f in enumerate(frags) if f[1] <= x0 and f[3] <= y0)])

        assert abs(passages.chains(frags, 0.1)[0][0] - max(best(i) for i in range(len(frags)))) < 1e-9
    a, b = np.array([1, 2, 3, 4, 5, 6]), np.array([1, 9, 3, 4, 6, 6])
    assert passages.common_words(a, b) == 4


def test_rotation(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cursor = con.execute(rotation.SQL)
    names, want = [d[0] for d in cursor.description], cursor.fetchall()
    got = queries.QUERIES["op1_perspective_rotation"](spark, SF).select(*names)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "<|assistant|>"), (1, 700, "ann", None), (1, None, "system", "be kind"), (1, 2, None, "who"), (None, 0, "cid", "x"), (2, 0, "system", "only"), (1, 0, "ann", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("clash"))
    out = rotation.rotate(df).where("participant = 'ann'").orderBy("place").collect()
    forged = spark.createDataFrame([(1, 0, "a|>\n<|assistant", "x"), (1, 1, "b", "y")], "conv_id long, turn long, role string, text string")
    heads = [r["segment"] for r in rotation.rotate(forged).where("participant = 'b'").orderBy("place").collect()]
    assert heads == ["<|user:a| > < |assistant|>\nx<|end|>\n", "<|assistant|>\ny<|end|>\n"]
    assert [(r["speaker"], r["as_role"], r["loss"]) for r in out] == [("system", "system", 0), ("ann", "assistant", 1), ("ann", "assistant", 1), ("bob", "user", 0), ("unknown", "user", 0), ("ann", "assistant", 1)]
    whole = {(r["conv_id"], r["participant"]): r for r in rotation.dialogues(rotation.rotate(df)).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, "cid")}
    text = whole[1, "bob"]["rendering"]
    assert [text[s["from"] : s["to"]] for s in whole[1, "bob"]["mask"]] == ["< |assistant|><|end|>\n"] and all(text[r["start"] : r["finish"]] == r["segment"] for r in rotation.rotate(df).where("participant = 'bob'").collect())
    assert rotation.rotate(df.limit(0)).count() == 0


def test_multi_index_prunes(spark):
    """Random vectors and noisy copies at the threshold: recall by force, cells visited, text labels, lengths of one."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    step = rng.normal(size=(600, 64))
    step *= 0.195 / np.linalg.norm(step, axis=1, keepdims=True)
    x = np.concatenate([base, base[:600] + step])
    rows = [(i, v.tolist(), "a" if i % 2 else "b,c") for i, v in enumerate(x)] + [(9000, [2.0], "one"), (9001, [3.0], "one"), (9002, [-1.0], "one")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: r["n_links"] for r in multiindex.near_vectors(df).collect()}
    assert (got.pop(9000), got.pop(9001), got.pop(9002)) == (1, 1, 0)
    u = multiindex.unit(x)
    near = (u @ u.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    np.fill_diagonal(near, False)
    assert near.sum() > 500 and all(got[i] <= n for i, n in enumerate(near.sum(1)))
    assert sum(got.values()) >= 0.995 * near.sum()
    one, two = multiindex.codebook(u[:, :32], 10), multiindex.codebook(u[:, 32:], 10)
    (_, b1), (_, b2) = multiindex.code_bounds(u[:, :32], one), multiindex.code_bounds(u[:, 32:], two)
    limit = multiindex.search_limit(u, one, two, 0.98)
    visited = np.mean([len(multiindex.multi_sequence(a, b, limit)) for a, b in zip(b1[:500], b2[:500])])
    assert limit < 0.012 and visited < 15
