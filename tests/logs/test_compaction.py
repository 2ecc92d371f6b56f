import random
from collections import Counter

import duckdb
from pyspark.sql import DataFrame
from pyspark.sql import types as T

import __spark_entry__
from stratalog.operators.store import Index, Manifest, Part, planned_compactions


def test_the_plan_of_a_table_is_the_plan_of_a_manifest(spark, tmp_path):
    r = random.Random(4)
    archives = tuple(Part(f"{k:05d}", 1, p := r.randrange(60) * 1000, p, 1, 1, r.choice([0, 5, 5, 40, 90, 200])) for k in range(900))
    index = Index(spark, f"file://{tmp_path}/i", partition_ms=1000)
    rows = spark.createDataFrame([(p.min_time // 1000, p.path, p.bytes) for p in archives], "part long, path string, bytes long")
    for files, size in ((16, 500), (3, 10_000), (16, 0), (1, 500)):
        plans = dict(index.compaction_plans(Manifest(archives=archives), files, size))
        got = {(x["part"] * 1000, x["path"]) for x in planned_compactions(rows, files, size).collect()}
        assert got == {(start, p.path) for start, chosen in plans.items() for p in chosen}


def test_candidates_are_planned_off_the_driver(spark, tmp_path, monkeypatch):
    """No row of the orders comes to the driver; ties, nulls and one large customer as in the SQL."""
    r = random.Random(5)
    rows = [(k, r.choice([None, *range(40)]), r.choice([None, 0.0, 9_999.5, 31_250.0, 499_999.9, 500_000.0, 500_001.0])) for k in range(1500)]
    rows += [(10_000 + k, 77, 31_250.0) for k in range(3000)] + [(20_000, 78, 5.0), (20_001, 78, None), (20_002, 79, None), (20_003, 79, None)]
    # copies of an order, whose places nothing decides, where the files or the bytes run out
    rows += [(30_000 + k, 80, 10.0) for k in range(15)] + [(30_100, 80, 300_000.0)] * 3 + [(30_200, 81, 200_000.0)] * 3
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/orders.parquet")
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", None)
        m.setattr(DataFrame, "toPandas", None)
        df = __spark_entry__.queries()["compaction_candidates"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = c.sql(__spark_entry__.oracle_sql()["compaction_candidates"]).fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want) and len(want) > 30
