"""Comparison of a Spark query with its SQL in DuckDB."""

import tempfile


def assert_same(spark, duck, query, sql, data):
    out = tempfile.mkdtemp(prefix="chronarch-test-") + "/out"
    query(spark, data).write.parquet(out)
    duck.execute(f"CREATE OR REPLACE VIEW mine AS SELECT * FROM '{out}/*.parquet'")
    duck.execute(f"CREATE OR REPLACE TABLE theirs AS {sql}")
    names = sorted(r[0] for r in duck.execute("DESCRIBE mine").fetchall())
    assert names == sorted(r[0] for r in duck.execute("DESCRIBE theirs").fetchall())
    columns = ", ".join(f'"{n}"' for n in names)
    for a, b in (("mine", "theirs"), ("theirs", "mine")):
        rest = duck.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 5").fetchall()
        assert not rest, f"only in {a}: {rest}"
