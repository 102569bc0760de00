"""Metamorphic check: the same answer for 1 and 8 shuffle partitions and
split scans (the exact fixed-point contract makes this bit-exact)."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["customer_features", "card_features", "corr_matrix", "last_n_mean", "impute_median", "roc_auc"])
def test_partition_count_invariance(spark, name):
    from ledgerline.plans.catalog import REGISTRY

    fn = REGISTRY[name][0]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(map(tuple, fn(spark, SF).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        many = sorted(map(tuple, fn(spark, SF).collect()), key=repr)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert one == many
