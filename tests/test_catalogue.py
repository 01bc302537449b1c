import duckdb
import pytest

from tierview import catalogue

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr(tuple(int(v) if isinstance(v, bool) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLE_SQL])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    cursor = con.execute(catalogue.ORACLE_SQL[name])
    names, want = [d[0] for d in cursor.description], cursor.fetchall()
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert plain(map(tuple, got.select(*[f"`{n}`" for n in names]).collect())) == plain(want)


def test_workload_batch(spark):
    assert catalogue.QUERIES["workload_batch"](spark, SF).select("query").distinct().count() > 150


def test_report(tmp_path, spark):
    from tierview import report
    from tierview.errors import BenchmarkError

    rows = [{"schema_version": 1, "dataset": "d", "baseline": "b", "status": "success", "archive_bytes": n, "encode_ms": float(n), "query_batch_ms": 1.0} for n in (1, 2, 9)]
    report.append(f"{tmp_path}/r.jsonl", [*rows, {"schema_version": 1, "dataset": "d", "baseline": "b", "status": "failure", "error": "x"}])
    found = report.load(spark, f"{tmp_path}/r.jsonl")
    assert report.primary(found).first()["archive_bytes"] == 2 and report.failures(found).first()["n"] == 1
    report.append(f"{tmp_path}/bad.jsonl", [{"schema_version": 1, "dataset": "d", "baseline": "b", "status": "success"}])
    with pytest.raises(BenchmarkError):
        report.load(spark, f"{tmp_path}/bad.jsonl")
    low, high = report.median_ratio_interval([2.0, 2.1, 1.9] * 5, [1.0] * 15)
    assert 1.8 < low <= high < 2.2 and report.ratios({"canonical_bytes": 10, "archive_bytes": 5})["ratio"] == 2
