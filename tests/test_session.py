"""Lineage cuts go to the folder the session names in spark.checkpoint.dir
(or, in local mode without one, a registered scratch folder)."""

import os

from ledgerline.session import checkpoint_dir, cut_lineage


def test_checkpoint_folder_from_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = checkpoint_dir(spark)
    if named:
        assert folder == named
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    df = cut_lineage(spark.range(1000), min_partitions=4)
    assert df.count() == 1000 and df.rdd.getNumPartitions() >= 4
    local = folder.removeprefix("file:")
    assert any(files for _, _, files in os.walk(local))
