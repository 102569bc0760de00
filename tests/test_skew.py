"""A third of all rows on one key: the salted history and the grouped
recipes must give the same answers as the plain (unsalted) forms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.aggs import Recipe
from ledgerline.operators import grouped, history

SF = "/root/testdata/sf0.01"


def _skewed(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    # every third order moves to customer 0 (a hot key with a third of the rows)
    return o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")))


def test_salted_latest_rows_equal_plain_window(spark):
    o = _skewed(spark)
    salted = history.latest_rows(o, "o_custkey", "o_orderdate", "o_orderkey", 5, salt_buckets=16)
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc())
    plain = o.withColumn("recency", F.row_number().over(w)).where("recency <= 5")
    cols = ["o_custkey", "o_orderkey", "recency"]
    assert sorted(map(tuple, salted.select(*cols).collect())) == sorted(map(tuple, plain.select(*cols).collect()))
    hot = salted.where("o_custkey = 0").count()
    assert hot == 5


def test_hot_key_recipe_matches_brute_force(spark):
    o = _skewed(spark)
    r = Recipe({"o_totalprice": ["sum", "mean", "var", "size"]}, scales={"o_totalprice": 2},
               families={"F_": F.col("o_orderstatus") == "F"})
    got = {row["o_custkey"]: row for row in grouped.group_features(o, "o_custkey", [r]).collect()}
    from fractions import Fraction

    prices = [Fraction(str(row.o_totalprice)) for row in o.where("o_custkey = 0").select("o_totalprice").collect()]
    n = len(prices)
    assert got[0]["o_totalprice_SIZE"] == n >= 5000
    assert got[0]["o_totalprice_SUM"] == float(sum(prices))
    mean = sum(prices) / n
    var = sum((p - mean) ** 2 for p in prices) / (n - 1)
    assert abs(Fraction(got[0]["o_totalprice_VAR"]) - var) <= 2 * var * Fraction(1, 2 ** 52)
