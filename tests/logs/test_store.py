import json
import threading

import pytest
from pyspark.sql import functions as F

from stratalog.operators import ops, store
from stratalog.operators.store import Conflict, Files, Index
from stratalog.plans import cursor
from stratalog.plans.query import Gap, LogQuery, QueryError, parse_filter, request
from stratalog.sources import ingest
from stratalog.streaming import tail

from .test_engine import NOW, greenhouse, take


def followed(index, tmp_path, query=LogQuery(), **kw):  # noqa: B008
    got = []
    tail.follow(index, query, lambda df, _: got.extend(r["id"] for r in df.collect()), f"file://{tmp_path}/c", {"availableNow": True}, **kw).awaitTermination(120)
    return got


def test_a_batch_that_lost_its_commit_is_not_delivered(spark, tmp_path):
    index, events = Index(spark, f"file://{tmp_path}/i"), list(greenhouse(9))
    take(spark, tmp_path / "a", events[:3], index)
    stale = Index(spark, f"file://{tmp_path}/i")
    m = stale.manifest()
    take(spark, tmp_path / "b", events[3:5], index)
    stale.manifest = lambda: m
    with pytest.raises(Conflict):
        take(spark, tmp_path / "x", events[5:9], stale)
    assert followed(index, tmp_path) == [1, 2, 3, 4, 5] and index.count(LogQuery()).first()[0] == 5
    assert followed(index, tmp_path) == []


def test_a_late_stream_finds_what_was_moved(spark, tmp_path):
    index, events = Index(spark, f"file://{tmp_path}/i"), list(greenhouse(12))
    take(spark, tmp_path / "a", events[:5], index)
    assert followed(index, tmp_path) == [1, 2, 3, 4, 5]
    take(spark, tmp_path / "b", events[5:], index)
    index.archive(NOW + 1)
    index.retain(1)  # a second commit, after which no kept manifest names the files of the log
    assert index.vacuum() > 0 and not any(n.endswith(".parquet") for n, _ in index.files.sizes("log"))
    assert followed(index, tmp_path) == list(range(6, 13))
    take(spark, tmp_path / "z", events[:2], index)
    index.archive(NOW + 1)
    index.retain(NOW + 1)
    index.vacuum()
    with pytest.raises(Exception, match="have expired"):
        followed(index, tmp_path)
    assert followed(index, tmp_path / "new") == []
    with pytest.raises(Gap):
        tail.resume(index, LogQuery(), cursor.encode_tail(LogQuery(), 13))


def test_one_of_two_writers_commits(spark, tmp_path):
    files, won, lost = Files(spark, f"file://{tmp_path}"), [], []

    def write(k):
        try:
            files.create("manifest/000000000001.json", f"writer {k}")
            won.append(k)
        except Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 7 and files.read("manifest/000000000001.json") == f"writer {won[0]}" and files.names("tmp") == []


def test_a_store_that_replaces_files_needs_a_single_writer(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}")

    class Odd:
        def __getattr__(self, name):
            return getattr(real, name)

        def getUri(self):
            return type("U", (), {"getScheme": lambda _: "s3a"})()

    real, files.fs = files.fs, Odd()
    with pytest.raises(QueryError, match="single_writer"):
        files.create("a", "x")
    files.create("a", "x", single_writer=True)
    with pytest.raises(Conflict):
        files.create("a", "y", single_writer=True)


def test_a_damaged_archive_is_noticed(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    take(spark, tmp_path / "a", list(greenhouse(8)), index)
    index.archive(NOW + 1)
    parts = index.manifest().archives
    assert index.verify() == len(parts) and all(len(p.sha256) == 64 for p in parts)
    path = tmp_path / "i" / parts[0].path
    raw = bytearray(path.read_bytes())
    raw[len(raw) // 2] ^= 1
    path.write_bytes(bytes(raw))
    for crc in path.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Conflict, match="committed"):
        index.recover()
    path.unlink()
    with pytest.raises(Conflict, match="missing"):
        index.verify()


def test_rows_move_and_go_in_bounded_batches(spark, tmp_path, monkeypatch):
    index, events = Index(spark, f"file://{tmp_path}/i"), list(greenhouse(24))
    for k in range(4):
        take(spark, tmp_path / f"a{k}", events[6 * k : 6 * k + 6], index)
    versions = index.manifest().version
    middle = NOW - 30 * 61_000
    monkeypatch.setattr(store, "FILE_ROWS", 3)
    old = sum(e["time"] < middle for e in events)
    assert index.archive(middle, most=6) == old and index.manifest().version >= versions + 2
    assert max(p.rows for p in index.manifest().archives) <= 3 and index.count(LogQuery()).first()[0] == 24
    young = sorted(k + 1 for k, e in enumerate(events) if e["time"] >= middle)
    assert index.delete_hot(NOW + 1, 4) == 4 and index.manifest().expired_through == young[3]
    assert sorted(r["id"] for r in index.read().select("id").collect()) == sorted({k + 1 for k in range(24)} - set(young[:4]))
    assert index.delete_hot(0, 4) == 0
    done = index.append_in_batches(ingest.project(ingest.read_lines(spark, str(tmp_path / "a0"))), "later", batch_rows=4, received_at=NOW)
    assert done == 6 and index.manifest().next_id == 31
    while index.manifest().archives:
        index.enforce_size(0, rounds=1)
    hot = sorted(r["event_time"] for r in index.read().select("event_time").collect())
    index.enforce_size(0, rounds=1, batch=2)
    assert sorted(r["event_time"] for r in index.read().select("event_time").collect()) == [t for t in hot if t > hot[1]]


def test_events_that_expired_meanwhile_reject_the_batch(spark, tmp_path):
    index, events = Index(spark, f"file://{tmp_path}/i"), list(greenhouse(6))
    take(spark, tmp_path / "a", events, index)
    index.retain(NOW + 1)
    with pytest.raises(QueryError, match="cutoff"):
        take(spark, tmp_path / "b", events, index)
    assert index.manifest().next_id == 7


def test_nesting_and_names_have_bounds(spark, tmp_path):
    ok = {"time": 1, "level": 1, "msg": "[[[[[[[[[[[[[[[[[[[[{{{{{{{{{{"}
    deep = lambda n: json.loads("[" * n + "]" * n)
    cases = [(ok, None), ({**ok, "a": deep(15)}, None), ({**ok, "a": deep(16)}, "nested"), ({**ok, "a": [[], {}] * 40}, None), ({**ok, "a": {"x" * 1024: 1}}, None), ({**ok, "a": [{"x" * 1025: 1}]}, "name"), ({**ok, "a": [{"é" * 513: 1}]}, "name"), ({**ok, "é" * 512: 1, "b": "y" * 3000}, None), ({**ok, "a": "\\\":" + "z" * 2000 + "\":"}, None)]
    for ascii_ in (True, False):
        (tmp_path / "l").write_text("\n".join(json.dumps(e, ensure_ascii=ascii_) for e, _ in cases))
        got = [r["bad"] for r in ingest.project(ingest.read_lines(spark, str(tmp_path / "l"))).orderBy("position").collect()]
        assert [(w or "") in (g or "") and (w is None) == (g is None) for g, (_, w) in zip(got, cases)] == [True] * len(cases), got


def test_requests_that_are_none():
    for bad in ({"from": "x", "to": 5}, {"from": 1.5, "to": 5}, {"from": 1, "to": 5, "limit": "many"}, {"from": 1, "to": 5, "min_level": "9" * 30}, {"from": None, "to": 5}, {"from": True, "to": 5}):
        with pytest.raises(QueryError):
            request(bad)
    assert request({"from": "1", "to": "5", "min_level": "3"}).min_level == 3
    with pytest.raises(QueryError, match="surrogate"):
        parse_filter('{"attributes":[{"key":"k","op":"eq","value":"\\ud800"}]}')


def test_latency_sketch(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.pow(F.lit(1.004), F.col("id") % 2500) * 0.01).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(0, None), (1, float("nan")), (2, 0.0), (7, 0.001)], "g long, v double"))
    values = {}
    for r in rows.collect():
        if r["v"] is not None and r["v"] == r["v"]:
            values.setdefault(r["g"], []).append(r["v"])
    sketch = ops.latency_sketch(rows, "v", ["g"])
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r["g"]: r["bound"] for r in ops.sketch_quantile(sketch, q, ["g"]).collect()}
        for g, vs in values.items():
            exact = sorted(vs)[max(0, -(-int(q * len(vs) * 1000) // 1000) - 1)]
            assert exact <= got[g] * (1 + 1e-9) and got[g] <= max(exact * 1.02, 0.002) * (1 + 1e-6)


def test_highlights_give_the_text_back(spark):
    df = spark.createDataFrame([("a.b a.b", ), ("axb", ), ("", ), (".b", ), (None, )], "message string")
    got = [[(p["text"], p["hit"]) for p in r["parts"]] if r["parts"] is not None else None for r in ops.highlighted(df, ".b").collect()]
    assert got == [[("a", False), (".b", True), (" a", False), (".b", True)], [("axb", False)], [], [(".b", True)], None]
    odd = spark.createDataFrame([("x\\Ey\\Ez",)], "message string")
    assert [(p["text"], p["hit"]) for p in ops.highlighted(odd, "\\E").first()["parts"]] == [("x", False), ("\\E", True), ("y", False), ("\\E", True), ("z", False)]
