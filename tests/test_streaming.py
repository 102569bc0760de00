"""The streaming recipe aggregate equals the batch one over the same files."""

import tempfile

from pyspark.sql import functions as F

from ledgerline.functions.aggs import Recipe
from ledgerline.operators import grouped
from ledgerline.streaming import detail_stream, feature_stream, run_updates

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    folder = tempfile.mkdtemp(prefix="ledgerline-stream-")
    # two arrivals of detail files
    orders.where("o_orderkey % 2 = 0").write.parquet(f"{folder}/in/a")
    orders.where("o_orderkey % 2 = 1").write.parquet(f"{folder}/in/b")
    recipe = Recipe({"o_totalprice": ["sum", "mean", "var", "max", "size"]}, prefix="S_", scales={"o_totalprice": 2},
                    families={"F_": F.col("o_orderstatus") == "F"})
    stream = detail_stream(spark, f"{folder}/in/*", orders.schema)
    seen = {}

    def sink(batch, _id):
        for r in batch.collect():
            seen[r["o_custkey"]] = tuple(r)

    q = run_updates(feature_stream(stream, "o_custkey", [recipe]), sink, "orders_features", checkpoint=f"{folder}/ckpt")
    q.processAllAvailable()
    q.stop()
    batch = {r["o_custkey"]: tuple(r) for r in grouped.group_features(orders, "o_custkey", [recipe]).collect()}
    assert seen == batch
