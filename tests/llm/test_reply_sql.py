import duckdb

from stratalog.llm import queries


def test_the_sql_counts_escapes_as_the_template_does(spark, tmp_path):
    rows = [
        (1, 0, "user", "#### a ### b ##### </turn></turn> \\ \\\\ < /turn> #"),
        (1, 1, "assistant", None),
        (1, 2, "assistant", "é 🙂 </turn\n###"),
        (2, None, "a:b#\\<\n", ""),
        (2, 0, None, "##\\#"),
        (3, 5, "user", "same"),
        (3, 5, "user", "same"),
        (3, 5, "assistant", "\\h\\l\\c\\n"),
        (None, 0, "user", "no conversation"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op6_reply_trees(spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(queries.oracle_sql()["op6_reply_trees"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
