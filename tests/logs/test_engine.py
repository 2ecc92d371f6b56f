import json
import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions.attributes import matches, parsed
from stratalog.operators import ops
from stratalog.operators.predicates import selection
from stratalog.operators.store import Catalog, Conflict, Index
from stratalog.plans import cursor
from stratalog.plans.query import Float, Forbidden, Gap, LogQuery, QueryError, default_interval, duration_ms, number, parse_filter, request
from stratalog.sources import ingest
from stratalog.streaming import tail

NOW = 1_800_000_000_000


def condition(key, value):
    return parse_filter(json.dumps({"attributes": [{"key": key, "op": "eq", "value": 0}]}).replace('"value": 0', f'"value": {value}'))


def greenhouse(n=40, seed=3):
    """Events of a few machines, some at the same time, none in the order of their times."""
    r = random.Random(seed)
    for k in range(n):
        machine = r.choice(["pump", "vent", "lamp"])
        event = {
            "time": NOW - r.choice([7, 19, 23, 31, 44, 52]) * 61_000 - r.randint(0, 1) * 500,
            "level": r.choice([10, 30, 30, 40, 50, 60]),
            "service": machine,
            "name": f"{machine}-log",
            "hostname": f"bed-{r.randint(1, 4)}",
            "msg": r.choice(["Valve opened", "valve stuck at 40%", "all quiet_", "reading 3\\4 é"]),
            "n": k,
            "batch": f"b{k % 6}",
            "litres": r.choice([1, 1.0, 2.5, "1", True, None]),
        }
        if r.random() < 0.3:
            del event["service"]
        yield event


def plain(events, start=0, end=NOW + 1, level=None, message=None, **equal):
    """The numbers n of the events that a query takes, newest first, as one would look them up by hand."""
    known = {"service": "service", "logger": "name", "host": "hostname"}
    hits = [
        (e["time"], k)
        for k, e in enumerate(events)
        if start <= e["time"] < end and (level is None or e["level"] >= level) and (message is None or message in e["msg"]) and all(e.get(known[c]) == v for c, v in equal.items())
    ]
    return [events[k]["n"] for _, k in sorted(hits, reverse=True)]


def take(spark, path, events, index, **kw):
    path.write_text("\n\n".join(json.dumps(e) for e in events))
    rows = ingest.project(ingest.read_lines(spark, str(path)))
    return index.append(ingest.accept(rows, ingest.reject_reason(**kw)), "demo", received_at=NOW)


def test_hot_archived_compacted(spark, tmp_path):
    index, events = Index(spark, f"file://{tmp_path}/i"), list(greenhouse())
    assert take(spark, tmp_path / "a", events[:25], index) == 25 and take(spark, tmp_path / "b", events[25:], index) == 15
    span = {"start": NOW - 50 * 61_000, "end": NOW}
    ask = lambda **kw: LogQuery(**{**span, **kw})
    n = lambda **kw: index.count(ask(**kw)).first()[0]

    def answers():
        for kw in ({}, {"service": "vent"}, {"host": "bed-2"}, {"logger": "lamp-log", "service": "lamp"}, {"message": "%"}, {"message": "_"}, {"message": "3\\4 é"}, {"message": "valve"}, {"message": "Valve"}):
            for level in (None, 30, 50, 61):
                assert n(min_level=level, **kw) == len(plain(events, **span, level=level, **kw)), (kw, level)
        inside = [e for e in events if span["start"] <= e["time"] < span["end"]]
        for value, same in (("1", [1, 1.0]), ("2.5", [2.5]), ('"1"', ["1"]), ("true", [True])):
            want = sum(any(type(e["litres"]) is type(x) and e["litres"] == x for x in same) for e in inside)
            assert n(attributes=condition("litres", value)) == want
        assert n(attributes=condition("batch", '"b4"')) == sum(e["batch"] == "b4" for e in inside)
        facets = {(r["facet"], r["value"]): r["count"] for r in index.facets(ask(min_level=40)).collect()}
        high = [e for e in inside if e["level"] >= 40]
        want = {("source", "demo"): len(high)}
        for facet, member in (("service", "service"), ("logger", "name"), ("host", "hostname"), ("level", "level")):
            for e in high:
                if member in e:
                    want[facet, str(e[member])] = want.get((facet, str(e[member])), 0) + 1
        assert facets == want
        buckets = {}
        for e in inside:
            at = span["start"] + (e["time"] - span["start"]) // 90_000 * 90_000
            buckets[at] = buckets.get(at, 0) + 1
        assert {r["time"]: r["count"] for r in index.histogram(ask(), 90_000).collect()} == buckets
        seen, token = [], None
        while True:
            page = index.search(ask(limit=7), token)
            seen += [json.loads(r["attributes"])["n"] for r in page.events]
            token = page.next_cursor
            if token is None:
                break
        assert seen == plain(events, **span)

    older = lambda t: sum(e["time"] < t for e in events)
    answers()
    assert index.archive(NOW - 30 * 61_000) == older(NOW - 30 * 61_000)
    answers()
    assert index.archive(NOW + 1) == len(events) - older(NOW - 30 * 61_000)
    index.promote(("batch", "litres"))
    answers()
    while index.compact():
        answers()
    status = {r["tier"]: (r["rows"], r["covered"]) for r in index.projection_status().collect()}
    assert status["archive"][0] == len(events) and index.digests().count() == len(index.manifest().archives)
    assert index.recover() >= 0 and index.disk_usage()["archives"] > 0
    with pytest.raises(QueryError):
        index.promote(("other",))
    cutoff = NOW - 40 * 61_000
    gone = [k + 1 for k, e in enumerate(events) if e["time"] < cutoff]
    assert index.retain(cutoff) == len(gone) and n() == len(plain(events, cutoff, NOW)) and index.manifest().expired_through == max(gone)
    full = ask()
    with pytest.raises(Gap):
        tail.resume(index, full, cursor.encode_tail(full, 2))
    assert index.enforce_size(0) > 0 and n() == 0


def test_tail_and_stream(spark, tmp_path):
    index, events = Index(spark, f"file://{tmp_path}/i"), list(greenhouse(20, seed=8))
    query, nobody = LogQuery(logger="vent-log"), LogQuery(service="nobody")
    ids = [k + 1 for k, e in enumerate(events) if e["name"] == "vent-log"]
    assert sum(i <= 11 for i in ids) > 2 and max(ids) > 11
    take(spark, tmp_path / "a", events[:11], index)
    rows, start = tail.resume(index, query)
    assert rows == [] and cursor.decode_tail(query, start) == 11
    rows, token = tail.resume(index, query, cursor.encode_tail(query, 0), limit=2)
    assert [r["id"] for r in rows] == ids[:2] and cursor.decode_tail(query, token) == ids[1]
    rows, token = tail.resume(index, nobody, cursor.encode_tail(nobody, 0))
    assert rows == [] and cursor.decode_tail(nobody, token) == 11
    got = []
    run = lambda: tail.follow(index, query, lambda df, _: got.extend(r["id"] for r in df.collect()), f"file://{tmp_path}/c", {"availableNow": True}).awaitTermination(120)
    run()
    take(spark, tmp_path / "b", events[11:], index)
    index.archive(NOW + 1)
    run()
    assert got == ids


def test_batches_are_all_or_nothing(spark, tmp_path):
    index, events = Index(spark, f"file://{tmp_path}/i"), list(greenhouse(6))
    bad = [*events[:2], {"time": NOW, "level": -1, "msg": "x"}, {"time": "no"}]
    with pytest.raises(ingest.Rejected, match=r"event \d+: level"):
        take(spark, tmp_path / "a", bad, index)
    assert index.manifest().next_id == 1
    with pytest.raises(ingest.Rejected, match="older than retention"):
        take(spark, tmp_path / "a", events[:1], index, now_ms=NOW + 30 * 86_400_000)
    own = {"time": NOW, "level": 30, "msg": "m", "id": 9, "source": "forged", "message": "x", "logger": 1, "attributes": {"a": 1}, "pid": 4}
    take(spark, tmp_path / "a", [own], index)
    r = index.read().first()
    assert (r["id"], r["source"], r["message"], r["logger"], r["pid"]) == (1, "demo", "m", None, 4)
    assert json.loads(r["attributes"]) == {"id": 9, "source": "forged", "message": "x", "logger": 1, "attributes": {"a": 1}}
    (tmp_path / "j").write_text(json.dumps(events))
    assert ingest.project(ingest.read_array(spark, str(tmp_path / "j"))).filter("bad IS NULL").count() == 6


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c", most=2)
    c.ensure("a")
    c.ensure("b")
    with pytest.raises(QueryError):
        c.ensure("c")
    with pytest.raises(QueryError):
        c.ensure("../x")
    c.delete("a")
    assert c.names() == ["b"]
    i = c.get("b")
    m = i.manifest()
    i._commit(m)
    with pytest.raises(Conflict):
        i._commit(m)


def spellings():
    """Numbers about the borders of exact doubles and of 64 bits, each written in some ways."""
    for border in (0, 1 << 31, 1 << 53, 1 << 63, 1 << 64):
        for near in (-2, -1, 0, 1, 3):
            for sign in ("", "-"):
                if near + border >= 0:
                    n = f"{sign}{border + near}"
                    yield from (n, f"{n}.0", f"{n}e0", f"{n}.5")
    yield from ("2.5e1", "25", "0.1", "0.10", "1e-400", "4.9e-324", "1e300", "-1e300", "1e19", "1e20")


def meant(token):
    """What a number stands for: an integer of 64 bits, signed or not, or a double."""
    if token.lstrip("-").isdigit() and -(1 << 63) <= int(token) < 1 << 64:
        return "integer", int(token)
    x = float(token)
    return ("integer", int(x)) if x.is_integer() and -(2.0**63) <= x < 2.0**64 else ("double", x)


def test_typed_numbers(spark):
    numbers = list(dict.fromkeys(spellings()))
    other = ['"25"', '"0"', "true", "false", "null", "[25]", '{"n":25}']
    stored = [ingest.canonical(f'{{"n":{v}}}') for v in numbers + other]
    df = spark.createDataFrame([(k, k, a) for k, a in enumerate(stored)], "id long, event_time long, attributes string").cache()
    # a stored number is first written in its shortest form, so a double is rounded before it is compared
    values = [meant(json.dumps(json.loads(a)["n"])) for a in stored[: len(numbers)]]
    asked = [t for t in numbers if "e" in t or len(t) < 4 or t.startswith(("18446", "-9223", "9223", "90071"))] + ['"25"', "true"]
    conditions = [condition("n", t)[0] for t in asked]
    m = parsed(F.col("attributes"))
    got = df.select("id", F.array(*[matches(m, c) for c in conditions]).alias("hits")).collect()
    for k, t in enumerate(asked):
        want = {len(numbers) + other.index(t)} if t in other else {i for i, v in enumerate(values) if v == meant(t)}
        assert {r["id"] for r in got if r["hits"][k]} == want, t
    df.unpersist()


def test_literal_keys(spark):
    keys = ["plain", "x.y.z", "$.x", "x['y']", "~1/", "**", '\\"', "\u0007\t", "ключ", "17", "👍", "a" * 250]
    df = spark.createDataFrame([(k, 1, json.dumps({key: f"v{k}", "z": 1})) for k, key in enumerate(keys)] + [(99, 1, '["v9"]'), (98, 1, "{broken"), (97, 1, '"v1"')], "id long, event_time long, attributes string")
    for k, key in enumerate(keys):
        q = LogQuery(0, 2, attributes=parse_filter(json.dumps({"attributes": [{"key": key, "op": "eq", "value": f"v{k}"}]})))
        assert [r["id"] for r in df.filter(selection(q)).collect()] == [k]


def test_filter_parser():
    one = '{"key":"k","op":"eq","value":%s}'
    doc = lambda *v: '{"attributes":[%s]}' % ",".join(one % x for x in v)
    assert parse_filter(doc("1", "1.0", "1e0"))[0].value == 1
    for bad in (doc("1", "2"), doc("null"), doc("{}"), doc("NaN"), '{"attributes":[],"x":1}', '{"attributes":[{"key":"k","key":"k","op":"eq","value":1}]}', doc('"' + "x" * 1025 + '"'), doc(*["1"] * 17), "[]", doc("1e999")):
        with pytest.raises(QueryError):
            parse_filter(bad)
    assert number("18446744073709551616.0") == Float(2.0**64) and isinstance(number("18446744073709551616.0"), Float) and number("-0.0") == 0


def test_requests_and_cursors():
    ok = {"from": 10, "to": 100, "limit": 2}
    for bad in ({"from": 1}, {**ok, "x": 1}, {"from": 5, "to": 5}, {"from": 0, "to": 40 * 86_400_000}, {**ok, "limit": 1001}, {**ok, "min_level": -1}):
        with pytest.raises(QueryError):
            request(bad)
    with pytest.raises(Forbidden):
        request({**ok, "source": ["b"]}, scope=["a"])
    with pytest.raises(Forbidden):
        request(ok, index="x", indexes=["y"])
    assert request(ok, scope=["a"]).sources == ("a",) and duration_ms("2h") == 7_200_000 and default_interval(0, 31 * 86_400_000) == 1_339_200
    q = LogQuery(10, 100, limit=2)
    assert cursor.fingerprint(q, "search") == "49b3f86267593e7ba22912a3c0d1d414f7a341472f5429ff65d1fe9e0757f727"
    assert cursor.fingerprint(q, "tail") == "71728cd436ed423d5bc00deafe8312b382982e6144954ec7a0a62ec1f698b9ef"
    at = cursor.Position(30, 20, 7)
    assert cursor.decode_search(q, cursor.encode_search(q, at)) == at
    named = LogQuery(10, 100, limit=2, scope=("named", "n"))
    for query, token in ((LogQuery(10, 100, limit=3), cursor.encode_search(q, at)), (named, cursor.encode_search(q, at)), (q, "v1.!!"), (q, cursor.encode_tail(q, 1))):
        with pytest.raises(QueryError):
            cursor.decode_search(query, token)


def test_histogram_extremes(spark):
    far = (1 << 62) + 5
    df = spark.createDataFrame([(1, -7, 1), (2, far, 1)], "id long, event_time long, level int")
    assert [r["b"] for r in df.select(ops.bucket(far, 10).alias("b")).orderBy("id").collect()][1] == far
    plan = ops.count(df, LogQuery(0, 100))
    assert plan.first()[0] == 0
