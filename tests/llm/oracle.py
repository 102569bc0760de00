"""Compare a Spark result with DuckDB SQL over the same tables."""

import duckdb


def duck(sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        if isinstance(frame, str):
            con.sql(f"create view {name} as select * from '{frame}'")
        else:
            con.register(name, frame)
    return con.sql(sql).arrow()


def same(spark_df, arrow):
    """Equal rows, whatever their order; columns by name."""
    arrow = arrow.read_all() if hasattr(arrow, "read_all") else arrow
    names = sorted(spark_df.columns)
    assert names == sorted(arrow.column_names)
    key = lambda t: tuple((x is None, x) for x in t)
    got = sorted((tuple(r[n] for n in names) for r in spark_df.collect()), key=key)
    want = sorted(zip(*(arrow.column(n).to_pylist() for n in names), strict=True), key=key)
    assert got == want
    return got
