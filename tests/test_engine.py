import json
import os
import random

import pytest
import zstandard
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from tierview import archive, cli, query, verify, workload
from tierview.errors import CorruptArchive, InputError, QueryRejected, VerificationMismatch
from tierview.operators import dictionary, state, tiers
from tierview.plans import contract as contracts
from tierview.plans import layout as layouts
from tierview.plans.admission import QuerySpec
from tierview.plans.contract import Measure, Retention
from tierview.sources import adapters, canonical, generator
from tierview.streaming import cells as streaming


def events(spark, rows):
    base = {"schema_version": 1, "service": "a", "event_type": "t", "severity": "INFO", "status": "OK", "attributes": {}}
    return spark.createDataFrame([base | {"event_id": f"e{i}"} | r for i, r in enumerate(rows)], canonical.SCHEMA)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_null_measures(spark):
    ms = (Measure("duration_ns", "count_present"), Measure("duration_ns", "sum"), Measure("duration_ns", "min"))
    e = events(spark, [{"timestamp_ns": 0, "duration_ns": 10}, {"timestamp_ns": 1}])
    assert values(state.cells(e, 60, ("service",), ms)) == [(0, "a", 1, 10, 10)]
    assert values(state.cells(e.where("timestamp_ns = 1"), 60, ("service",), ms)) == [(0, "a", 0, None, None)]


def test_histogram_edges(spark):
    m = Measure("duration_ns", "histogram", (10, 20))
    e = events(spark, [{"timestamp_ns": 0, "duration_ns": d} for d in (9, 10, 19, 20, None)])
    assert values(state.cells(e, 60, (), (m,))) == [(0, 1, 2, 1)]
    assert values(state.cells(e, 60, (), (Measure("duration_ns", "histogram", ()),))) == [(0, 4)]


def test_negative_times(spark):
    e = events(spark, [{"timestamp_ns": t} for t in (-1, -60, -61, 59)])
    assert sorted(values(state.cells(e, 60, (), (Measure("*", "count"),)))) == [(-120, 1), (-60, 2), (0, 1)]


def test_overflow(spark):
    big, m = (1 << 63) - 1, (Measure("bytes_in", "sum"),)
    e = events(spark, [{"timestamp_ns": 0, "bytes_in": b} for b in (big, 1, -1)])
    assert values(state.cells(e, 60, (), m)) == [(0, big)]
    with pytest.raises(ArithmeticException):
        state.cells(e.where("bytes_in > 0"), 60, (), m).collect()


def test_orders_and_null_groups(spark):
    e = events(spark, [{"timestamp_ns": 0, "operation": o} for o in ("é", "10", None, "2", "", "b", "Z")])
    c = contracts.telemetry()
    out = query.from_events(e, c, QuerySpec("error-volume", 0, c.bucket_ns, group_by=("operation",)))
    assert [r["operation"] for r in out.collect()] == [None, "", "10", "2", "Z", "b", "é"]
    picked = query.from_events(e, c, QuerySpec("error-volume", 0, c.bucket_ns, {"operation": [None, "2"]}, ("operation",)))
    assert [r["operation"] for r in picked.collect()] == [None, "2"]
    assert query.from_events(e, c, QuerySpec("error-volume", c.bucket_ns, 2 * c.bucket_ns)).count() == 0


def test_merging_is_associative(spark):
    ms = contracts.telemetry().family("latency").measures
    e = generator.generate(spark, "standard", 2000, 3)
    fine = state.cells(e, contracts.DAY_NS, ("service", "operation"), ms)
    assert verify.difference(state.regroup(fine, ("service",), ms), state.cells(e, contracts.DAY_NS, ("service",), ms)).isEmpty()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = values(state.cells(e, contracts.DAY_NS, ("service",), ms).orderBy("bucket_ns", "service"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == values(state.cells(e, contracts.DAY_NS, ("service",), ms).orderBy("bucket_ns", "service"))


def test_tiers_at_the_boundary(spark):
    r = Retention("0", ("ERROR",), ("ERROR",))
    e = events(spark, [{"timestamp_ns": 5}, {"timestamp_ns": 9}, {"timestamp_ns": 1, "severity": "ERROR"}])
    cutoff = tiers.cutoff_ns(r, 1, 9)
    assert cutoff == 9 and tiers.cutoff_ns(Retention("all"), 1, 9) == 1
    found = {x["event_id"]: x["tier"] for x in tiers.classified(e, r, cutoff).collect()}
    assert found == {"e0": None, "e1": "recent", "e2": "errors"}
    with pytest.raises(QueryRejected):
        tiers.filtered(e, {"nope": ["x"]})


def test_dictionaries(spark):
    e = events(spark, [{"timestamp_ns": 0, "model": m} for m in ("b", None, "a", "é", "b", "10", "2")])
    d = dictionary.build(e, "model")
    dictionary.check(d)
    assert values(d.orderBy("id")) == [(0, None), (1, "10"), (2, "2"), (3, "a"), (4, "b"), (5, "é")]
    coded = dictionary.encode(e, "model", d, "id")
    assert sorted(values(dictionary.decode(coded.select("event_id", "id"), "id", d, "model").select("event_id", "model"))) == sorted(values(e.select("event_id", "model")))
    with pytest.raises(Exception, match="outside the dictionary"):
        dictionary.decode(coded.select((F.col("id") + 50).alias("id")), "id", d, "model").collect()
    with pytest.raises(CorruptArchive):
        dictionary.check(d.withColumn("value", F.when(F.col("id") == 3, "zz").otherwise(F.col("value"))))
    with pytest.raises(InputError):
        dictionary.check_ceiling(e, ["model"], 5)


GOOD = '{"schema_version":1,"timestamp_ns":-7,"event_id":"event-α","service":"a","event_type":"t","severity":"INFO","status":"OK","duration_ns":5,"attributes":{"z":null,"a":"λ"},"body":{"b":[1,2.0],"a":null}}'


@pytest.mark.parametrize("change,why", [
    (('"duration_ns":5', '"duration_ns":5.0'), "64-bit integer"), (('"duration_ns":5', '"duration_ns":99999999999999999999'), "64-bit integer"), (('"duration_ns":5', '"duration_ns":"5"'), "64-bit integer"),
    (('"service"', '"surprise":1,"service"'), "unknown field surprise"), (('"a":"λ"', '"a":5'), "attributes"), (('"a":"λ"', '"a":{"b:c":"x"}'), "attributes"), (('"service":"a"', '"service":"a","service":"b"'), "twice"),
    ((GOOD, ""), "not a JSON"), ((GOOD, "x"), "not a JSON"), ((GOOD, "[1]"), "not an object"), (('"service":"a"', '"service":""'), "empty"), (("INFO", "info"), "severity"), (('"schema_version":1', '"schema_version":2'), "schema_version"),
    (('"event_id":"event-α",', ""), "event_id is missing"), (('"service":"a"', '"service":7'), "must be text"),
])
def test_strict_scan(spark, change, why):
    line = GOOD.replace(*change)
    assert why in canonical.scan(spark.createDataFrame([(line,)], "value string")).first()["problem"]


def test_scan_parses_once(spark):
    """A filter on the problem doesn't bring the parsers of a line along, once for each field."""
    lines = spark.createDataFrame([("{}",)], "value string").select(F.concat("value", F.lit("")).alias("value"))
    plan = canonical.scan(lines).where("problem is null").select("event_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_round_trip(spark):
    found = canonical.scan(spark.createDataFrame([(GOOD,), (GOOD.replace('"a":"λ"', '"b:c":"λ"'),)], "value string"))
    assert [r["problem"] for r in found.collect()] == [None, None]
    again = [json.loads(r[0]) for r in found.select(canonical.canonical_json()).collect()]
    assert again[0] == json.loads(GOOD)


def test_compressed_sources_and_line_ends(spark, tmp_path):
    e = generator.generate(spark, "low-cardinality", 50, 1)
    for codec in ("none", "gzip"):
        canonical.write_jsonl(e, f"{tmp_path}/{codec}", codec)
    lines = b"".join(x.read_bytes() for x in sorted((tmp_path / "none").glob("part-*")))
    (tmp_path / "e.jsonl.zst").write_bytes(zstandard.compress(lines, 9))
    for name in ("none", "gzip", "e.jsonl.zst"):
        back = canonical.read_canonical(spark, f"{tmp_path}/{name}")
        assert back.count() == 50 and canonical.content_hash(back) == canonical.content_hash(e)
    (tmp_path / "crlf.log").write_bytes(b"one\r\ntwo\rhalf\n")
    assert [r[0] for r in canonical.read_lines(spark, f"{tmp_path}/crlf.log").collect()] == ["one", "two\rhalf"]
    canonical.write_jsonl(e.unionByName(e), f"{tmp_path}/twice")
    with pytest.raises(InputError, match="2 times"):
        canonical.read_canonical(spark, f"{tmp_path}/twice")


def test_adapters(spark):
    z = adapters.zookeeper(adapters.indexed(spark.createDataFrame([("2015-07-29 17:41:41,536 - INFO  [main:QuorumPeerConfig@101] - Reading configuration",), ("x - y",), ("short",)], "value string").coalesce(1)))
    rows = z.collect()
    assert (rows[0]["timestamp_ns"], rows[0]["operation"], rows[0]["severity"], rows[0]["event_id"], rows[0]["warning"]) == (1438191701536000000, "QuorumPeerConfig", "INFO", "zookeeper-000000000000", False)
    assert (rows[1]["timestamp_ns"], rows[1]["event_type"], rows[1]["severity"], rows[1]["operation"]) == (1, "log.record", "UNKNOWN", "zookeeper")
    assert rows[2]["event_type"] == "unparsed" and rows[2]["warning"]
    b = adapters.bgl(adapters.indexed(spark.createDataFrame([("- 1117838570 2005.06.03 R02 2005-06-03 R02 RAS KERNEL INFO cache corrected",), ("short",), ("- 99999999999999999 d n a b c d e f",)], "value string").coalesce(1))).collect()
    assert (b[0]["timestamp_ns"], b[0]["operation"], b[0]["attributes"], b[0]["severity"]) == (1117838570000000000, "KERNEL", {"node": "R02", "facility": "RAS"}, "INFO")
    assert (b[1]["severity"], b[1]["event_type"], json.loads(b[1]["body"]), b[1]["error_code"]) == ("ERROR", "unparsed", {"raw_line": "short"}, "LOG_ALERT")
    assert b[2]["timestamp_ns"] == (1 << 63) - 1 and b[2]["attributes"]["node"] == "n"
    with pytest.raises(InputError):
        adapters.normalize(spark.createDataFrame([("short",)], "value string"), "bgl")
    with pytest.raises(InputError):
        adapters.normalize(spark.createDataFrame([], "value string"), "bgl")


def test_generator(spark):
    for name, s in generator.SCENARIOS.items():
        e = generator.generate(spark, name, 300, 7)
        assert canonical.scan(e.select(canonical.canonical_json().alias("value"))).where("problem is not null").isEmpty()
        assert canonical.content_hash(e) == canonical.content_hash(generator.generate(spark, name, 300, 7, 3))
        assert e.select("service").distinct().count() <= s.services
    size = generator.metadata(generator.generate(spark, "standard", 300, 7))["canonical_bytes"]
    capped = generator.capped(generator.generate(spark, "standard", 300, 7), size // 2, block=50)
    assert size // 2 - 1000 < generator.metadata(capped)["canonical_bytes"] <= size // 2


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    e = generator.generate(spark, "standard", 600, 19).cache()
    c = contracts.telemetry(bucket="1d")
    path = str(tmp_path_factory.mktemp("archives") / "a")
    return e, c, archive.encode(e, c, path)


def test_archive_answers(built):
    e, c, a = built
    m = a.manifest
    values_of = workload.first_values({f.name: a.view(layouts.route(list(a.views), f.name).name) for f in c.families}, c)
    specs = workload.legal(c, m["min_timestamp_ns"], m["max_timestamp_ns"], values_of)
    assert verify.verify_queries(a, e, specs[::17]) == len(specs[::17])
    got = {}
    for r in query.batch(a, specs[::23]).collect():
        got.setdefault(r["query"], []).append(r)
    for i, s in enumerate(specs[::23]):
        names = [x for x in a.query(s).columns if x not in ("bucket_ns", *s.group_by)]
        want = [(r["bucket_ns"], [r[d] for d in s.group_by], [r[n] for n in names]) for r in a.query(s).collect()]
        found = [(r["bucket_ns"], [r[f"group_{k + 1}"] for k in range(len(s.group_by))], [r[n] for n in names]) for r in got.get(i, [])]
        assert sorted(found, key=str) == sorted(want, key=str)
    for s in workload.illegal(c, m["min_timestamp_ns"], m["max_timestamp_ns"]):
        with pytest.raises(QueryRejected):
            a.query(s)
    with pytest.raises(VerificationMismatch):
        verify.verify_queries(a, e.where("service <> 'service-003'"), [QuerySpec("event-volume", specs[4].start_ns, specs[4].end_ns)])


def test_archive_parts(built):
    e, c, a = built
    info = a.inspect()
    assert info["event_count"] == 600 and info["families"]["traffic"]["view"] == info["families"]["latency"]["view"] or info["layout"] == "unified"
    assert a.events("errors").count() == info["tier_counts"]["errors"] and a.events().count() == sum(info["tier_counts"].values())
    doc = query.envelope(a, QuerySpec("latency", info["min_timestamp_ns"] // contracts.DAY_NS * contracts.DAY_NS, info["max_timestamp_ns"] // contracts.DAY_NS * contracts.DAY_NS + contracts.DAY_NS))
    assert doc["exactness"] == "exact" and doc["rows"][0]["measures"]["duration_ns:histogram"]["type"] == "histogram" and query.rows_hash(doc)


def test_randomised_contract(spark):
    rng = random.Random(5)
    c = contracts.telemetry(bucket="1d")
    rows = [{"timestamp_ns": rng.randrange(-3 * contracts.DAY_NS, 3 * contracts.DAY_NS), "service": rng.choice("abc"), "operation": rng.choice([None, "", "x", "y"]), "status": rng.choice(["OK", "ERROR", "UNSET"]), "duration_ns": rng.choice([None, -5, 10**6, 10**9, 7])} for _ in range(300)]
    e = events(spark, rows).cache()
    cells = state.cells(e, c.bucket_ns, c.family("latency").dimensions, c.family("latency").measures).cache()
    for _ in range(6):
        dims = c.family("latency").dimensions
        filters = {d: rng.sample([None, "", "a", "x", "OK"], rng.randrange(1, 4)) for d in rng.sample(dims, rng.randrange(0, 3))}
        s = QuerySpec("latency", -rng.randrange(0, 4) * c.bucket_ns, rng.randrange(1, 4) * c.bucket_ns, filters, tuple(rng.sample(dims, rng.randrange(0, 4))))
        assert verify.difference(query.over_cells(cells, c, s), query.from_events(e, c, s)).isEmpty()


def test_layouts_and_determinism(spark, tmp_path):
    e = generator.generate(spark, "standard", 200, 19).cache()
    c = contracts.telemetry(bucket="1d", recent="0")
    one, two = (archive.encode(e, c, f"{tmp_path}/{n}", archive.EncodeOptions("separate", files=2)) for n in "ab")
    assert one.manifest["archive_hash"] == two.manifest["archive_hash"]
    auto = archive.encode(e, c, f"{tmp_path}/c", archive.EncodeOptions("auto", files=2)).manifest
    assert auto["candidate_bytes"][auto["layout"]] == min(auto["candidate_bytes"].values())
    with pytest.raises(Exception, match="exists"):
        archive.encode(e, c, f"{tmp_path}/a")
    assert archive.encode(e, c, f"{tmp_path}/a", archive.EncodeOptions("unified", force=True, files=2)).manifest["layout"] == "unified"
    victim = next(f"{tmp_path}/b/{n}" for n in two.manifest["files"] if n.startswith("views"))
    with open(victim, "ab") as f:
        f.write(b"x")
    with pytest.raises(CorruptArchive):
        verify.verify(archive.Archive.open(spark, f"{tmp_path}/b"))
    with open(f"{tmp_path}/c/contract.toml", "a") as f:
        f.write("# changed\n")
    with pytest.raises(CorruptArchive):
        archive.Archive.open(spark, f"{tmp_path}/c")
    assert not [n for n in os.listdir(tmp_path) if "staging" in n or ".old-" in n]


def test_archive_where_only_spark_reads(spark, tmp_path):
    """A path of Hadoop's view file system, which open() and os don't know."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./w", f"file://{tmp_path}")
    e, c = generator.generate(spark, "standard", 200, 5), contracts.telemetry(bucket="1d")
    a = archive.encode(e, c, "viewfs://store/w/a", archive.EncodeOptions("separate"))
    verify.verify(archive.Archive.open(spark, "viewfs://store/w/a"))
    assert archive.encode(e, c, "viewfs://store/w/a", archive.EncodeOptions("separate", force=True)).manifest["archive_hash"] == a.manifest["archive_hash"]
    assert sorted(os.listdir(tmp_path)) == ["a"]


def test_baselines(spark, tmp_path):
    from tierview import report

    generator_out = f"{tmp_path}/e"
    canonical.write_jsonl(generator.generate(spark, "standard", 150, 5), generator_out)
    rows = report.bench_canonical(spark, generator_out, "d", contracts.telemetry(bucket="1d"), f"{tmp_path}/rows.jsonl", ("separate",))["rows"]
    assert [r["baseline"] for r in rows] == ["jsonl", "gzip-6", "parquet-raw-zstd", "separate-zstd9"] and all(r["status"] == "success" and r["legal_queries"] == 200 and r["event_count"] == 150 for r in rows), rows


def test_names_with_backticks(spark):
    e = events(spark, [{"timestamp_ns": 0, "attributes": {"a`b": "x"}}, {"timestamp_ns": 1, "attributes": {}}])
    found = state.regroup(state.cells(e, 60, ("attributes.a`b",), (Measure("*", "count"),)), ("attributes.a`b",), (Measure("*", "count"),))
    assert sorted(values(found), key=str) == [(0, "x", 1), (0, None, 1)]


def test_command_line(spark, tmp_path, capsys):
    c = tmp_path / "c.toml"
    c.write_text(contracts.telemetry(bucket="1d").source)
    assert cli.main(["generate", "--scenario", "error-burst", "--events", "200", "--seed", "1", "--output", f"{tmp_path}/e"], spark) == 0
    assert cli.main(["encode", "--input", f"{tmp_path}/e", "--contract", str(c), "--output", f"{tmp_path}/a", "--layout", "separate"], spark) == 0
    capsys.readouterr()
    assert cli.main(["query", f"{tmp_path}/a", "--family", "event-volume", "--start", "2026-07-01T00:00:00Z", "--end", "2026-09-01T00:00:00Z", "--where", "status=ERROR", "--group-by", "service"], spark) == 0
    assert json.loads(capsys.readouterr().out)["rows"]
    assert cli.main(["verify", f"{tmp_path}/a"], spark) == 0 and cli.main(["events", f"{tmp_path}/a", "--jsonl"], spark) == 0
    assert cli.main(["query", f"{tmp_path}/a", "--family", "nope", "--start", "0", "--end", "1"], spark) == 5
    assert cli.main(["inspect", f"{tmp_path}/none"], spark) == 4
    (tmp_path / "bad").write_text("x\n")
    assert cli.main(["encode", "--input", f"{tmp_path}/bad", "--contract", str(c), "--output", f"{tmp_path}/b"], spark) == 3


def test_stream_of_cells(spark, tmp_path):
    v = layouts.separate(contracts.telemetry(bucket="1d"))[1]
    e = generator.generate(spark, "standard", 300, 2)
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    streaming.keep_cells(stream, contracts.DAY_NS, v, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True).awaitTermination(120)
    assert verify.difference(streaming.read_cells(spark, f"{tmp_path}/out", v), state.cells(e, contracts.DAY_NS, v.dimensions, v.measures)).isEmpty()
