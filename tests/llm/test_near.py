import numpy as np
import pytest

from stratalog.llm import common, decontamination, simhash
from stratalog.llm.components import connected_components
from stratalog.llm.queries import documents


def test_one_row_of_each_group_stays(spark):
    a, b = "one two three four five six seven", "quite another text of some words that is not like it"
    rows = [(5, a, "x"), (5, a, "y"), (6, a, "z"), (7, b, "u"), (7, a, "v"), (8, b, "w"), (None, b, "p"), (None, "alone 1 2 3", "q"), (None, "alone 1 2 3", "r"), (None, "single as well", "s"), (9, None, "t"), (10, "", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string").withColumnsRenamed({"kept_id": "ID"})
    got = [tuple(r) for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted((r[0] or 0, r[1] or "") for r in got) == sorted([(5, a), (7, b), (0, "alone 1 2 3"), (0, "single as well"), (9, "")])
    assert simhash.drop_near_duplicates(df.limit(0)).collect() == [] and simhash.drop_near_duplicates(df).columns == ["doc_id", "text", "ID"]
    for clash in ("kept_id", "fp", "component_id", "root", "row", "again", "bad_id", "salt"):
        again = df.withColumnRenamed("ID", clash)
        assert simhash.drop_near_duplicates(again).columns == ["doc_id", "text", clash]
        assert simhash.drop_near_duplicates(again.filter("doc_id >= 8")).count() == 2


def test_contaminated_rows_go_whatever_the_columns(spark):
    item = "the first words of a test question that nobody may learn"
    df = spark.createDataFrame([(1, f"before it {item} and after", 0), (2, "clean text", 0), (None, item, 0), (1, "another row of it", 0), (3, None, 0)], "doc_id long, text string, bad_id int")
    items = spark.createDataFrame([(4, item), (4, item), (5, None), (None, item)], "item_id long, text string")
    assert sorted((r[0] or 0) for r in decontamination.drop_contaminated(df, items).collect()) == [0, 2, 3]
    assert decontamination.drop_contaminated(df, items.limit(0)).count() == 5 and decontamination.drop_contaminated(df.limit(0), items).count() == 0


def test_shuffled_joins_find_the_same(spark, sf, monkeypatch):
    docs, items = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(tuple, decontamination.find_contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert want and sorted(map(tuple, decontamination.find_contaminated(docs, items).collect())) == want


def roots_of(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in links:
        parent[root(x)] = root(y)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("kind", ["scattered", "same image", "clustered"])
def test_a_large_cell_is_split(kind, monkeypatch):
    r = np.random.default_rng(5)
    n = 3000
    if kind == "scattered":
        f = r.integers(0, 2**63, n).astype(np.uint64)
    elif kind == "same image":  # each segment has one bit
        f = np.zeros(n, np.uint64)
        for s in range(32):
            f |= (np.uint64(1) << r.integers(0, 2, n).astype(np.uint64)) << np.uint64(2 * s)
    else:
        f = r.integers(0, 2**63, n // 10).astype(np.uint64).repeat(10)
        for _ in range(3):
            f ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    f = np.unique(f)
    monkeypatch.setattr(simhash, "SPLIT", 40)
    position = {v: k for k, v in enumerate(f.tolist())}
    a, b = simhash.cell_links(np.zeros(len(f), np.int64), f)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    near = [(i, j) for i in range(len(f)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= 4)).tolist()]
    got = roots_of(len(f), [(position[x], position[y]) for x, y in zip(a.tolist(), b.tolist())])
    want = roots_of(len(f), near)
    assert len({(g, w) for g, w in zip(got, want)}) == len(set(got)) == len(set(want))


def test_a_cell_of_a_hundred_thousand_unlinked_rows():
    f = np.unique(np.random.default_rng(6).integers(0, 2**63, 100_000).astype(np.uint64))
    a, _ = simhash.cell_links(np.zeros(len(f), np.int64), f)
    assert len(a) < 100


def test_a_hub_of_a_hundred_thousand_links(spark):
    links = spark.range(100_000).selectExpr("id + 10 AS a", "3L AS b").union(spark.createDataFrame([(3, 2), (100_500, 100_501), (7, 7)], "a long, b long"))
    got = connected_components(links)
    assert got.filter("root = 2").count() == 100_002 and got.filter("root = 100500").count() == 2 and got.count() == 100_004


def test_a_cluster_has_to_name_its_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"
        getConf = staticmethod(lambda: {})

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session)
