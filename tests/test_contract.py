import pytest

from tierview.errors import ContractError, QueryRejected
from tierview.functions.values import duration_ns, parse_filters, safe_name, time_ns
from tierview.plans import contract as contracts
from tierview.plans import layout as layouts
from tierview.plans.admission import QuerySpec, admit, wanted
from tierview import workload

HEAD = 'version = 1\nname = "x"\ntime_bucket = "{bucket}"\n[retention]\nrecent = "24h"\nerror_severities = []\nerror_statuses = []\n'
FAMILY = '[[families]]\nname = "{name}"\ndimensions = {dims}\nmeasures = {measures}\n'


def make(bucket="1m", name="f", dims='["service"]', measures='[{ field = "*", op = "count" }]', more=""):
    return contracts.parse(HEAD.format(bucket=bucket) + FAMILY.format(name=name, dims=dims, measures=measures) + more)


def test_standard_contract():
    c = contracts.telemetry()
    assert [f.name for f in c.families] == ["event-volume", "latency", "traffic", "model-usage", "error-volume"]
    assert c.bucket_ns == 60 * 10**9 and c.retention.recent_ns() == 86400 * 10**9
    assert [v.families for v in layouts.separate(c)] == [("event-volume",), ("latency", "traffic"), ("model-usage",), ("error-volume",)]
    assert len(layouts.unified(c)[0].dimensions) == 7


@pytest.mark.parametrize("text,ns", [("0s", 0), ("1ns", 1), ("3us", 3000), ("2ms", 2 * 10**6), ("24h", 86400 * 10**9), ("1d", 86400 * 10**9)])
def test_durations(text, ns):
    assert duration_ns(text) == ns


@pytest.mark.parametrize("text", ["", "60", "01m", "1.5m", "-1s", "1 s", "1w", "9999999999999d"])
def test_bad_durations(text):
    with pytest.raises(ContractError):
        duration_ns(text)


@pytest.mark.parametrize("change", [
    {"dims": "[]"}, {"dims": '["service", "operation", "model", "status", "severity", "trace_id", "span_id"]'}, {"dims": '["nope"]'}, {"dims": '["service", "service"]'},
    {"bucket": "7m"}, {"bucket": "2d"}, {"bucket": "500ms"}, {"measures": "[]"}, {"measures": '[{ field = "bytes_in", op = "count" }]'}, {"measures": '[{ field = "*", op = "sum" }]'},
    {"measures": '[{ field = "service", op = "sum" }]'}, {"measures": '[{ field = "bytes_in", op = "sum" }, { field = "bytes_in", op = "sum" }]'}, {"measures": '[{ field = "bytes_in", op = "median" }]'},
    {"measures": '[{ field = "bytes_in", op = "histogram", bounds = [2, 1] }]'}, {"measures": '[{ field = "bytes_in", op = "sum", bounds = [1] }]'},
    {"more": FAMILY.format(name="f", dims='["status"]', measures='[{ field = "*", op = "count" }]')}, {"more": "unknown = 1\n"}, {"name": ""},
])
def test_bad_contracts(change):
    with pytest.raises(ContractError):
        make(**change)


def test_legal_edges():
    assert make(measures='[{ field = "bytes_in", op = "histogram", bounds = [] }]').families[0].measures[0].bounds == ()
    assert make(measures='[{ field = "bytes_in", op = "histogram" }]').families[0].measures[0].bounds == ()
    assert make(measures='[{ field = "bytes_in", op = "sum", bounds = [] }]').families[0].measures[0].bounds is None
    assert make(name=" ", dims='["attributes."]').families[0].name == " "
    assert make(dims='["attributes.region"]').families[0].dimensions == ("attributes.region",)


def test_conflicting_bounds_keep_separate():
    h = '[{{ field = "bytes_in", op = "histogram", bounds = [{}] }}]'
    c = make(measures=h.format(1), more=FAMILY.format(name="g", dims='["status"]', measures=h.format(2)))
    assert not layouts.unified_legal(c) and len(layouts.separate(c)) == 2
    with pytest.raises(ContractError):
        layouts.separate(make(measures=h.format(1), more=FAMILY.format(name="g", dims='["service"]', measures=h.format(2))))


def test_times():
    assert time_ns("-5") == -5 and time_ns("1970-01-01T00:00:00.000000001Z") == 1 and time_ns("1970-01-01T01:00:00+01:00") == 0
    for bad in ("", "yesterday", "1970-01-01T00:00:00", "99999999999999999999", "1970-13-01T00:00:00Z"):
        with pytest.raises(QueryRejected):
            time_ns(bad)


def test_filters():
    assert parse_filters(["a=x,null", "b="[:1] + "=y"]) == {"a": ["x", None], "b": ["y"]}
    for bad in (["a"], ["a="], ["=x"], ["a=x", "a=y"]):
        with pytest.raises(QueryRejected):
            parse_filters(bad)


def test_safe_names_differ():
    assert len({safe_name(x) for x in ("attributes.a.b", "attributes.a_b", "attributes.a-b", "attributes.A", "é")}) == 5


def test_admission():
    c = contracts.telemetry()
    w = c.bucket_ns
    ok = QuerySpec("latency", 0, w, {"service": ["a", None]}, ("status",), ("duration_ns:max",))
    assert admit(c, ok).name == "latency" and QuerySpec.from_json(ok.to_json()) == ok
    assert [m.op for m in wanted(c.family("latency"), QuerySpec("latency", 0, w))] == ["count_present", "sum", "min", "max", "histogram"]
    for change in (
        {"family": "x"}, {"end_ns": 0}, {"start_ns": 1}, {"end_ns": w + 1}, {"group_by": ("status", "status")}, {"group_by": ("model",)}, {"filters": {"model": ["a"]}}, {"filters": {"service": []}},
        {"filters": {"service": [1]}}, {"measures": ("count",)}, {"measures": ("duration_ns:max", "duration_ns:max")},
    ):
        with pytest.raises(QueryRejected):
            admit(c, QuerySpec(**({"family": ok.family, "start_ns": 0, "end_ns": w, "filters": {}, "group_by": (), "measures": ()} | change)))
    with pytest.raises(QueryRejected):
        QuerySpec.from_json('{"family": "latency", "start_ns": 0, "end_ns": 1, "limit": 3}')


def test_workload_shapes():
    c = contracts.telemetry()
    values = {(f.name, d): [None, "a"] for f in c.families for d in f.dimensions[:2]}
    specs = workload.legal(c, 5, 10**15, values)
    assert len(specs) == 200
    for s in specs:
        admit(c, s)
    bad = workload.illegal(c, 5, 10**15)
    assert len(bad) == 20
    for s in bad:
        with pytest.raises(QueryRejected):
            admit(c, s)
