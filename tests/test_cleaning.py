"""The cleaning plan on a hand-made frame: group sums before and after the
flag inversion, excess, indicators, overlapping imputation steps (the
sequential path) and the regression fill."""

from pyspark.sql import functions as F

from ledgerline.plans.cleaning import CleaningPlan, FlagGroup, ImputeStep, clean


def test_cleaning_plan_steps(spark):
    rows = [
        (1, 1, 0, 1, 1, 0, 100.0, 90.0, None, "x", 1.0, 2.0),
        (2, 0, 0, 0, 0, 1, 50.0, 60.0, 3.0, None, 2.0, 4.1),
        (3, 1, 1, 1, 1, 1, None, 10.0, 5.0, "y", 3.0, None),
        (4, 0, 1, 0, 0, 0, 70.0, 70.0, 3.0, "x", 4.0, 8.2),
    ]
    df = spark.createDataFrame(
        rows,
        "id int, REG_CITY_NOT_LIVE int, REG_REGION_NOT_WORK int, LIVE_REGION_NOT_WORK int, "
        "FLAG_DOCUMENT_3 int, FLAG_DOCUMENT_5 int, AMT_CREDIT double, AMT_GOODS double, AGE double, SUITE string, "
        "P double, T double",
    )
    plan = CleaningPlan(
        groups=[
            FlagGroup("NOT", {"city": "CITY", "region": "REGION"}, ["LIVE_REGION_NOT_WORK"], "all"),
            FlagGroup("^FLAG_DOCUMENT", {}, ["FLAG_DOCUMENT_3"], "docs"),
        ],
        excess=("AMT_CREDIT", "AMT_GOODS"),
        indicators={"missing_age": "AGE"},
        imputations=[
            ImputeStep(["AGE"], "median"),
            ImputeStep(["AGE", "SUITE"], "most_frequent"),  # overlaps: sequential path
        ],
        regressions=[("T", ["P"], "t_filled")],
    )
    out = {r.id: r for r in clean(df, plan, materialize=False).collect()}
    # region sum counts both REGION flags before the inversion, the total after
    assert (out[1].city, out[1].region, out[1].all) == (1, 1, 1)
    assert (out[2].city, out[2].region, out[2].all) == (0, 0, 1)
    assert out[3].docs == 1 and out[2].docs == 2
    assert out[3].excess is False and out[3].excess_amt is None
    assert out[1].missing_age == 1 and out[1].AGE == 3.0
    assert out[2].SUITE == "x"
    # T ≈ 2.05·P fitted on the three present rows; row 3 is filled from it
    assert abs(out[3].t_filled - (2.05 * 3.0 - 0.05)) < 0.1 and out[1].t_filled == 2.0
    assert "T" not in out[1].asDict()
