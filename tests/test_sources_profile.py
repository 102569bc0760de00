"""Sources (S1-S5, U1-U2) and the campaign profile."""

import tempfile

from pyspark.sql import functions as F

from ledgerline.functions import columns as C
from ledgerline.plans.profiling import campaign_profile
from ledgerline.sources import first_rows, read_csv, shape, stack_all, stack_rows

SF = "/root/testdata/sf0.001"


def test_csv_with_schema_maps_nan_to_null(spark):
    folder = tempfile.mkdtemp(prefix="ledgerline-csv-")
    with open(f"{folder}/t.csv", "w") as fh:
        fh.write("k,x,s\n1,1.5,a\n2,NaN,b\n3,,\n")
    df = read_csv(spark, f"{folder}/t.csv", "k long, x double, s string")
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(1, 1.5, "a"), (2, None, "b"), (3, None, None)]


def test_first_rows_stack_and_shape(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    top = first_rows(orders, 5, [F.col("o_orderkey")])
    assert [r.o_orderkey for r in top.collect()] == [0, 1, 2, 3, 4]
    a = orders.select("o_orderkey", "o_custkey")
    b = orders.select("o_orderkey", "o_orderstatus")
    both = stack_rows(a, b)
    assert set(both.columns) == {"o_orderkey", "o_custkey", "o_orderstatus"}
    assert shape(both) == (2 * orders.count(), 3)
    assert stack_all([a, a, a]).count() == 3 * orders.count()


def test_name_and_type_selection(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 1)], "FLAG_DOCUMENT_3 int, NAME_TYPE string, AMT_AVG double, LIVE_CITY_NOT_WORK int")
    assert C.matching(df, "NOT") == ["LIVE_CITY_NOT_WORK"]
    assert C.containing(df, "AVG") == ["AMT_AVG"]
    assert C.string_columns(df) == ["NAME_TYPE"]
    assert C.drop_matching(df, "^FLAG_").columns == ["NAME_TYPE", "AMT_AVG", "LIVE_CITY_NOT_WORK"]
    assert C.rename_all(df, list("abcd")).columns == list("abcd")


def test_campaign_profile(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    li = li.withColumn("row_id", F.monotonically_increasing_id())
    out = campaign_profile(li, "label", "row_id", token="R", scales={"l_quantity": 2, "l_tax": 2, "label": 0},
                           drop=["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"])
    rows, cols = out["shape"].first()
    assert rows == li.count() and cols == len(li.columns) - 4
    assert out["preview"].count() == 3
    tokens = {r.column_name: r.n for r in out["token_counts"].collect()}
    assert tokens["l_returnflag"] == li.where("l_returnflag = 'R'").count()
    balance = {r.label: r.n for r in out["class_balance"].collect()}
    assert sum(balance.values()) == rows
    diag = {r.a: r.value for r in out["correlation"].where("a = b").collect()}
    assert abs(diag["l_quantity"] - 1.0) < 1e-12
    strong = out["strong"].collect()
    assert all(r.value > 0.05 for r in strong) and any(r.a == "label" for r in strong)


def test_correlation_batches_agree(spark):
    from ledgerline.operators import profile

    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    one = sorted(map(tuple, profile.correlation_matrix(li, cols, scales={c: 2 for c in cols}).collect()))
    many = sorted(map(tuple, profile.correlation_matrix(li, cols, scales={c: 2 for c in cols}, pairs_per_pass=3).collect()))
    assert one == many and len(one) == 16
