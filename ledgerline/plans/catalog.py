"""Registered queries: the library's jobs run on the driver's test tables.

Role mapping (customer ↔ application, orders ↔ previous applications and
bureau loans, lineitem ↔ loan months / instalments / card lines, events ↔
point-of-sale months, labels ⋈ documents ↔ targets). Every query reads whole
tables; vocabularies are taken from the data at plan time, and the oracle
text lists the same values.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, duckdb_sql | None)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import rows as R
from ledgerline.operators import grouped
from ledgerline.plans import features as FE
from ledgerline.plans import sqlforms as S
from ledgerline.sources import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


# The category vocabularies of the test tables, as the
# oracle text must spell them out (the Spark side derives them from data).
STATUS_VALUES = ["F", "O", "P"]
PRIORITY_VALUES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENT_VALUES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
RETURNFLAG_VALUES = ["A", "N", "R"]
LINESTATUS_VALUES = ["F", "O"]
EVENT_VALUES = ["click", "error", "purchase", "signup", "view"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").withColumn("o_orderday", R.day_number("o_orderdate"))


# ---------------------------------------------------------------- F7 slice
PREV_SPEC = {"o_totalprice": ["min", "max", "mean", "var", "sum"], "o_orderday": ["min", "max", "mean"]}
PREV_SCALES = {"o_totalprice": 2, "o_orderday": 0}
PREV_FAMILIES = {"APPROVED_": "F", "REFUSED_": "O"}


def _prev_sql() -> str:
    items = S.recipe(PREV_SPEC, S.upper("PREV_"), PREV_SCALES, exprs={"o_orderday": "o_orderday"})
    for p, v in PREV_FAMILIES.items():
        items += S.recipe(PREV_SPEC, S.upper(p), PREV_SCALES, where=f"o_orderstatus = {S.lit(v)}", exprs={"o_orderday": "o_orderday"})
    items += S.shares("o_orderpriority", PRIORITY_VALUES, "PREV_") + S.shares("o_orderstatus", STATUS_VALUES, "PREV_")
    return (
        "WITH o AS (SELECT *, " + S.day_number("o_orderdate") + " AS o_orderday FROM orders), "
        "f AS (SELECT o_custkey, " + ", ".join(items) + " FROM o WHERE o_custkey IS NOT NULL GROUP BY o_custkey) "
        "SELECT c.c_custkey, c.c_mktsegment, c.c_acctbal, f.* EXCLUDE (o_custkey) "
        "FROM customer c LEFT JOIN f ON c.c_custkey = f.o_custkey"
    )


@register("prev_features", _prev_sql())
def prev_features(spark: SparkSession, d: str) -> DataFrame:
    feats = FE.previous_features(
        _orders(spark, d), "o_custkey", PREV_SPEC, ["o_orderpriority", "o_orderstatus"],
        "o_orderstatus", PREV_FAMILIES, PREV_SCALES,
    )
    cust = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return grouped.attach(cust, feats, "c_custkey", "o_custkey")


# ------------------------------------------------------- sources, rows (S, X)
# F7 with its row steps: a sentinel day read as missing, the asked / received ratio and its variance
PREV_SENTINEL_DAY = 9000
PREV_STEP_SPEC = {"o_totalprice": ["min", "max", "mean"], "o_orderday": ["min", "max", "mean"], "credit_perc": ["min", "max", "mean", "var"]}
PREV_STEP_SCALES = {"o_totalprice": 2, "o_orderday": 0}
PERC_DIGITS = 6


def _prev_steps_sql() -> str:
    cols = S.recipe(PREV_STEP_SPEC, S.upper("PREV_"), PREV_STEP_SCALES)
    for p, v in PREV_FAMILIES.items():
        cols += S.recipe(PREV_STEP_SPEC, S.upper(p), PREV_STEP_SCALES, where=f"o_orderstatus = {S.lit(v)}")
    cols += S.shares("o_orderstatus", STATUS_VALUES, "PREV_")
    perc = [f"{p}credit_perc_{a}" for p in ("PREV_", *PREV_FAMILIES) for a in ("MEAN", "VAR")]
    rounded = ", ".join(f"FLOOR({S.q(c)} * 1e{PERC_DIGITS} + 0.5) / 1e{PERC_DIGITS} AS {S.q(c)}" for c in perc)
    day = S.day_number("o_orderdate")
    return (
        "WITH l AS (SELECT l_orderkey, MAX(l_extendedprice) AS received FROM lineitem GROUP BY 1), "
        f"o AS (SELECT o_custkey, o_orderstatus, o_totalprice, NULLIF({day}, {PREV_SENTINEL_DAY}) AS o_orderday, "
        "o_totalprice / NULLIF(received, 0) AS credit_perc FROM orders LEFT JOIN l ON o_orderkey = l_orderkey), "
        "f AS (SELECT o_custkey, " + ", ".join(cols) + " FROM o WHERE o_custkey IS NOT NULL GROUP BY o_custkey) "
        f"SELECT * REPLACE ({rounded}) FROM f"
    )


@register("prev_features_steps", _prev_steps_sql())
def prev_features_steps(spark: SparkSession, d: str) -> DataFrame:
    from ledgerline.operators.profile import report

    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("received"))
    rows = _orders(spark, d).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumns(
        {"o_orderday": R.sentinel_to_null("o_orderday", PREV_SENTINEL_DAY), "credit_perc": R.ratio("o_totalprice", "received")}
    )
    feats = FE.previous_features(rows, "o_custkey", PREV_STEP_SPEC, ["o_orderstatus"], "o_orderstatus", PREV_FAMILIES, PREV_STEP_SCALES)
    # true ratios have no fixed scale: floating means and variances are reported to six decimals
    perc = [f"{p}credit_perc_{a}" for p in ("PREV_", *PREV_FAMILIES) for a in ("MEAN", "VAR")]
    return feats.withColumns({c: report(F.col(c), PERC_DIGITS) for c in perc})


@register("scan_limit", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def scan_limit(spark, d):
    from ledgerline.sources import first_rows

    return first_rows(_t(spark, d, "orders"), 1000, [F.col("o_orderkey")])


@register(
    "union_missing_cols",
    "SELECT l.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id "
    "UNION ALL SELECT d.doc_id, d.lang, d.n_chars, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER) FROM documents d "
    "WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def union_missing_cols(spark, d):
    from ledgerline.sources import stack_rows

    docs = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = _t(spark, d, "labels")
    labelled = labels.join(docs, "doc_id")
    unlabelled = docs.join(labels, "doc_id", "left_anti")
    return stack_rows(labelled, unlabelled)


def _payment_sql(x: str = "l") -> str:
    return f"{x}.l_extendedprice * (1 - {x}.l_discount)"


@register(
    "ratio_features",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    "CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS discount_per_tax, "
    "CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS unit_price, "
    "CASE WHEN l_extendedprice = 0 THEN NULL ELSE (l_extendedprice * (1 - l_discount)) / l_extendedprice END AS paid_share, "
    "l_extendedprice - l_extendedprice * (1 - l_discount) AS discount_amount FROM lineitem",
)
def ratio_features(spark, d):
    li = _t(spark, d, "lineitem")
    pay = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        R.ratio("l_discount", "l_tax").alias("discount_per_tax"),
        R.ratio("l_extendedprice", "l_quantity").alias("unit_price"),
        R.ratio(pay, "l_extendedprice").alias("paid_share"),
        R.diff("l_extendedprice", pay).alias("discount_amount"),
    )


def _instalments(spark, d) -> DataFrame:
    """lineitem ⋈ orders as instalments: due day = order day, paid day =
    ship day, instalment = extended price, payment = discounted price."""
    li = _t(spark, d, "lineitem")
    o = _orders(spark, d).select("o_orderkey", "o_custkey", "o_orderday")
    return li.join(o, li.l_orderkey == o.o_orderkey).withColumns(
        {
            "l_shipday": R.day_number("l_shipdate"),
            "l_payment": F.col("l_extendedprice") * (1 - F.col("l_discount")),
        }
    )


_INST_SQL = (
    "SELECT l.*, o.o_custkey, o.o_orderday, " + S.day_number("l.l_shipdate") + " AS l_shipday, "
    + _payment_sql() + " AS l_payment FROM lineitem l JOIN (SELECT o_orderkey, o_custkey, "
    + S.day_number("o_orderdate") + " AS o_orderday FROM orders) o ON l.l_orderkey = o.o_orderkey"
)


@register(
    "clamp_dpd",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    "CASE WHEN l_shipday - o_orderday > 0 THEN l_shipday - o_orderday ELSE 0 END AS DPD, "
    "CASE WHEN o_orderday - l_shipday > 0 THEN o_orderday - l_shipday ELSE 0 END AS DBD "
    "FROM (" + _INST_SQL + ")",
)
def clamp_dpd(spark, d):
    return _instalments(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        R.clamp_zero(R.diff("l_shipday", "o_orderday")).alias("DPD"),
        R.clamp_zero(R.diff("o_orderday", "l_shipday")).alias("DBD"),
    )


# the "end date" role: whole days from 1998-01-01 (negative = in the past)
END_ORIGIN = "1998-01-01"


@register(
    "flag_closed",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS active_flag, "
    "CASE WHEN d_end < 0 THEN 0 ELSE 1 END AS enddate_flag, "
    "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS open_flag, "
    "COALESCE(o_totalprice - 250000 > 0, false) AS above_mid "
    "FROM (SELECT *, CAST(date_diff('day', DATE '" + END_ORIGIN + "', CAST(o_orderdate AS DATE)) AS INTEGER) AS d_end FROM orders)",
)
def flag_closed(spark, d):
    o = _t(spark, d, "orders").withColumn("d_end", R.day_number("o_orderdate", END_ORIGIN))
    return o.select(
        "o_orderkey",
        R.flag_unless_equal("o_orderstatus", "F").alias("active_flag"),
        R.flag_unless_negative("d_end").alias("enddate_flag"),
        R.equal_flag("o_orderstatus", "O").alias("open_flag"),
        R.positive(F.col("o_totalprice") - 250000).alias("above_mid"),
    )


def _order_lines(spark, d) -> DataFrame:
    """orders ⟕ per-order line aggregates: 2 % of orders have no line, so
    their line columns are missing (the null path of the cleaning steps)."""
    li = _t(spark, d, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("l_returnflag").alias("top_flag"),
        F.max("l_quantity").alias("max_qty"),
        F.min("l_discount").alias("min_discount"),
        F.max("l_tax").alias("max_tax"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_open"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
    )
    return _t(spark, d, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


_ORDER_LINES_SQL = (
    "SELECT o.*, p.* EXCLUDE (l_orderkey) FROM orders o LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n_lines, "
    "MAX(l_returnflag) AS top_flag, MAX(l_quantity) AS max_qty, MIN(l_discount) AS min_discount, MAX(l_tax) AS max_tax, "
    "COUNT(*) FILTER (WHERE l_linestatus = 'O') AS n_open, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n_returned "
    "FROM lineitem GROUP BY l_orderkey) p ON o.o_orderkey = p.l_orderkey"
)


@register(
    "sentinel_null",
    "SELECT o_orderkey, NULLIF(n_lines, 7) AS n_lines, NULLIF(max_qty, 50.0) AS max_qty FROM (" + _ORDER_LINES_SQL + ")",
)
def sentinel_null(spark, d):
    return _order_lines(spark, d).select(
        "o_orderkey", R.sentinel_to_null("n_lines", 7).alias("n_lines"), R.sentinel_to_null("max_qty", 50.0).alias("max_qty")
    )


@register(
    "null_indicators",
    "SELECT o_orderkey, CAST(n_lines IS NULL AS INTEGER) AS missing_lines, CAST(top_flag IS NULL AS INTEGER) AS missing_flag, "
    "CAST(max_qty IS NULL AS INTEGER) AS missing_qty FROM (" + _ORDER_LINES_SQL + ")",
)
def null_indicators(spark, d):
    return _order_lines(spark, d).select(
        "o_orderkey",
        R.missing_indicator("n_lines").alias("missing_lines"),
        R.missing_indicator("top_flag").alias("missing_flag"),
        R.missing_indicator("max_qty").alias("missing_qty"),
    )


@register(
    "row_sum_flags",
    "SELECT o_orderkey, COALESCE(n_open, 0) + COALESCE(n_returned, 0) AS open_or_returned, "
    "ABS(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END - 1) AS not_final, "
    "COALESCE(n_open, 0) + COALESCE(n_returned, 0) + ABS(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END - 1) AS all_flags, "
    "COALESCE(max_tax, min_discount) AS tax_or_discount, ABS(o_totalprice - 250000) AS dist_mid "
    "FROM (" + _ORDER_LINES_SQL + ")",
)
def row_sum_flags(spark, d):
    df = _order_lines(spark, d).withColumn("final", R.equal_flag("o_orderstatus", "F"))
    # the city / region sums are taken before the flag is inverted, the total after
    partial = R.row_sum(["n_open", "n_returned"])
    inverted = R.invert_flag("final")
    return df.select(
        "o_orderkey",
        partial.alias("open_or_returned"),
        inverted.alias("not_final"),
        R.row_sum(["n_open", "n_returned", inverted]).alias("all_flags"),
        R.fill_from("max_tax", "min_discount").alias("tax_or_discount"),
        R.absolute(F.col("o_totalprice") - 250000).alias("dist_mid"),
    )


@register(
    "filter_keep_null",
    "SELECT o_orderkey, top_flag FROM (" + _ORDER_LINES_SQL + ") WHERE top_flag IS DISTINCT FROM 'R'",
)
def filter_keep_null(spark, d):
    return _order_lines(spark, d).where(R.not_value_keep_missing("top_flag", "R")).select("o_orderkey", "top_flag")


@register(
    "filter_missing_split",
    "SELECT o_orderkey, CASE WHEN n_lines IS NULL THEN 'missing' ELSE 'present' END AS part FROM (" + _ORDER_LINES_SQL + ")",
)
def filter_missing_split(spark, d):
    df = _order_lines(spark, d)
    missing = df.where(R.is_missing("n_lines")).select("o_orderkey", F.lit("missing").alias("part"))
    present = df.where(~R.is_missing("n_lines")).select("o_orderkey", F.lit("present").alias("part"))
    return missing.unionByName(present)


# ------------------------------------------------------------ aggregates (A)
RECIPE_MEASURES = ["o_totalprice", "o_orderday"]


@register(
    "agg_recipe",
    "WITH o AS (SELECT *, " + S.day_number("o_orderdate") + " AS o_orderday FROM orders), f AS (SELECT o_custkey, "
    + ", ".join(S.recipe({m: FE.RECIPE_AGGREGATES for m in RECIPE_MEASURES}, lambda c, a: f"o_custkey_{a}_{c}", PREV_SCALES))
    + " FROM o GROUP BY o_custkey) SELECT c.c_custkey, f.* EXCLUDE (o_custkey) FROM customer c LEFT JOIN f ON c.c_custkey = f.o_custkey",
)
def agg_recipe(spark, d):
    feats = FE.recipe_features(_orders(spark, d), "o_custkey", RECIPE_MEASURES, scales=PREV_SCALES)
    return grouped.attach(_t(spark, d, "customer").select("c_custkey"), feats, "c_custkey", "o_custkey")


@register(
    "agg_nunique",
    "SELECT o_custkey, COUNT(DISTINCT o_orderpriority) AS n_priorities, COUNT(DISTINCT o_orderstatus) AS n_statuses, "
    "COUNT(o_orderkey) AS n_orders, COUNT(*) AS n_rows FROM orders GROUP BY o_custkey",
)
def agg_nunique(spark, d):
    return grouped.group_features(
        _t(spark, d, "orders"), "o_custkey", [],
        [F.count("o_orderkey").alias("n_orders"), F.count(F.lit(1)).alias("n_rows")],
        distinct=[
            F.count_distinct("o_orderpriority").alias("n_priorities"),
            F.count_distinct("o_orderstatus").alias("n_statuses"),
        ],
    )


@register(
    "agg_proportion",
    "SELECT o_custkey, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS DOUBLE) / COUNT(*) AS per_active FROM orders GROUP BY o_custkey",
)
def agg_proportion(spark, d):
    return grouped.proportion(_t(spark, d, "orders"), "o_custkey", R.flag_unless_equal("o_orderstatus", "F"), "per_active")


TWO_LEVEL_FIRST = {"l_quantity": ["min", "max", "size"]}
TWO_LEVEL_SECOND = {"l_quantity_MIN": ["min"], "l_quantity_MAX": ["max", "mean"], "l_quantity_SIZE": ["mean", "sum"]}


@register(
    "agg_two_level",
    "WITH per_order AS (SELECT l_orderkey, MIN(l_quantity) AS l_quantity_MIN, MAX(l_quantity) AS l_quantity_MAX, "
    "COUNT(*) AS l_quantity_SIZE FROM lineitem GROUP BY l_orderkey), o AS (SELECT o.o_custkey, p.* EXCLUDE (l_orderkey) "
    "FROM orders o LEFT JOIN per_order p ON o.o_orderkey = p.l_orderkey) SELECT o_custkey, "
    + ", ".join(S.recipe(TWO_LEVEL_SECOND, S.upper(""), {"l_quantity_MIN": 2, "l_quantity_MAX": 2, "l_quantity_SIZE": 0}))
    + " FROM o GROUP BY o_custkey",
)
def agg_two_level(spark, d):
    from ledgerline.functions.aggs import Recipe

    return grouped.two_level(
        _t(spark, d, "lineitem"), "l_orderkey", [Recipe(TWO_LEVEL_FIRST)],
        _t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey",
        [Recipe(TWO_LEVEL_SECOND, scales={"l_quantity_MIN": 2, "l_quantity_MAX": 2, "l_quantity_SIZE": 0})],
    )


FAMILY_SPEC = {"l_extendedprice": ["min", "max", "mean", "sum", "var"], "l_quantity": ["sum", "size"]}
FAMILY_SCALES = {"l_extendedprice": 2, "l_quantity": 2}
LINE_FAMILIES = {"OPEN_": "O", "DONE_": "F"}


def _family_sql() -> str:
    items = S.recipe(FAMILY_SPEC, S.upper("LINE_"), FAMILY_SCALES)
    for p, v in LINE_FAMILIES.items():
        items += S.recipe(FAMILY_SPEC, S.upper(p), FAMILY_SCALES, where=f"l_linestatus = {S.lit(v)}")
    return "SELECT o_custkey, " + ", ".join(items) + " FROM (" + _INST_SQL + ") GROUP BY o_custkey"


@register("agg_family", _family_sql())
def agg_family(spark, d):
    from ledgerline.functions.aggs import Recipe

    fam = {p: F.col("l_linestatus") == v for p, v in LINE_FAMILIES.items()}
    recipe = Recipe(FAMILY_SPEC, prefix="LINE_", scales=FAMILY_SCALES, families=fam)
    return grouped.group_features(_instalments(spark, d), "o_custkey", [recipe])


@register(
    "attach_group_mean",
    "SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, s.cust_mean_price, s.cust_orders FROM orders o LEFT JOIN "
    "(SELECT o_custkey, " + S.agg("o_totalprice", "mean", 2) + " AS cust_mean_price, COUNT(*) AS cust_orders "
    "FROM orders GROUP BY o_custkey) s ON o.o_custkey = s.o_custkey",
)
def attach_group_mean(spark, d):
    from ledgerline.functions.aggs import exact_mean

    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return grouped.attach_group_stat(
        o, "o_custkey",
        {"cust_mean_price": exact_mean(F.col("o_totalprice"), 2), "cust_orders": F.count(F.lit(1))},
    )


LAST_N = (1, 3, 5)
LAST_MEASURES = {"o_totalprice": "price_of_last_{n}_orders_mean", "o_orderday": "day_of_last_{n}_orders_mean"}

_RANKED_ORDERS_SQL = (
    "SELECT *, " + S.day_number("o_orderdate") + " AS o_orderday, row_number() OVER (PARTITION BY o_custkey "
    "ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS rn FROM orders"
)


def _last_n_sql() -> str:
    items = []
    for n in LAST_N:
        for col, tmpl in LAST_MEASURES.items():
            items.append(f"{S.agg(f'(CASE WHEN rn <= {n} THEN {col} END)', 'mean', PREV_SCALES[col])} AS {tmpl.format(n=n)}")
    return "SELECT o_custkey, " + ", ".join(items) + " FROM (" + _RANKED_ORDERS_SQL + ") WHERE rn <= 5 GROUP BY o_custkey"


@register("last_n_mean", _last_n_sql())
def last_n_mean(spark, d):
    from ledgerline.operators import history

    return history.last_n_means(_orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey", LAST_MEASURES, LAST_N, PREV_SCALES)


@register(
    "last_value",
    "SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS last_was_final, "
    "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS last_was_open, o_orderpriority AS last_priority "
    "FROM (" + _RANKED_ORDERS_SQL + ") WHERE rn = 1",
)
def last_value(spark, d):
    from ledgerline.operators import history

    return history.last_value(
        _t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey",
        {
            "last_was_final": R.equal_flag("o_orderstatus", "F"),
            "last_was_open": R.equal_flag("o_orderstatus", "O"),
            "last_priority": F.col("o_orderpriority"),
        },
    )


@register(
    "top_k",
    "SELECT o_custkey, " + S.agg("o_totalprice", "sum", 2) + " AS total_spend FROM orders GROUP BY o_custkey "
    "ORDER BY total_spend DESC, o_custkey LIMIT 20",
)
def top_k(spark, d):
    from ledgerline.functions.aggs import one_aggregate
    from ledgerline.operators import history

    spend = _t(spark, d, "orders").groupBy("o_custkey").agg(one_aggregate(F.col("o_totalprice"), "sum", 2).alias("total_spend"))
    return history.top_k(spend, [F.col("total_spend").desc(), F.col("o_custkey").asc()], 20)


# --------------------------------------------------------------- encodings (E)
@register(
    "onehot",
    "SELECT c_custkey, c_acctbal, " + ", ".join(
        f"CASE WHEN c_mktsegment = {S.lit(v)} THEN 1 ELSE 0 END AS {S.q('c_mktsegment_' + v)}" for v in SEGMENT_VALUES
    ) + " FROM customer",
)
def onehot(spark, d):
    from ledgerline.operators import encode

    cust = _t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    out, _ = encode.one_hot(cust, encode.vocabularies(cust, ["c_mktsegment"]), with_missing=False)
    return out


@register(
    "onehot_nan",
    "SELECT o_orderkey, " + ", ".join(
        f"CASE WHEN top_flag = {S.lit(v)} THEN 1 ELSE 0 END AS {S.q('top_flag_' + v)}" for v in RETURNFLAG_VALUES
    ) + ", CAST(top_flag IS NULL AS INTEGER) AS top_flag_nan FROM (" + _ORDER_LINES_SQL + ")",
)
def onehot_nan(spark, d):
    from ledgerline.operators import encode

    ol = _order_lines(spark, d).select("o_orderkey", "top_flag")
    out, _ = encode.one_hot(ol, encode.vocabularies(ol, ["top_flag"]), with_missing=True)
    return out


@register(
    "factorize",
    "WITH ol AS (" + _ORDER_LINES_SQL + "), firsts AS (SELECT top_flag, MIN(o_orderkey) AS f FROM ol WHERE top_flag IS NOT NULL "
    "GROUP BY top_flag), codes AS (SELECT top_flag, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS code FROM firsts) "
    "SELECT ol.o_orderkey, COALESCE(codes.code, -1) AS top_flag FROM ol LEFT JOIN codes ON ol.top_flag = codes.top_flag",
)
def factorize(spark, d):
    from ledgerline.operators import encode

    ol = _order_lines(spark, d).select("o_orderkey", "top_flag")
    return encode.factorize(ol, ["top_flag"], [F.col("o_orderkey")])


@register(
    "label_encode",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS l_returnflag, "
    "CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS INTEGER) AS l_linestatus FROM lineitem",
)
def label_encode(spark, d):
    from ledgerline.operators import encode

    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    return encode.label_encode(li, ["l_returnflag", "l_linestatus"])


# ------------------------------------------------------- history jobs
@register(
    "label_encode_many",
    "SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY l_partkey) - 1 AS INTEGER) AS l_partkey, "
    "CAST(dense_rank() OVER (ORDER BY CAST(l_suppkey AS VARCHAR)) - 1 AS INTEGER) AS l_suppkey FROM lineitem",
)
def label_encode_many(spark, d):
    """E4 on columns of many values (numbers by value, strings by their text)."""
    from ledgerline.operators import encode

    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").cast("string").alias("l_suppkey"))
    return encode.label_encode(li, ["l_partkey", "l_suppkey"])


@register(
    "factorize_many",
    "WITH f AS (SELECT o_custkey, MIN(o_orderkey) AS f FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1), "
    "c AS (SELECT o_custkey, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS code FROM f) "
    "SELECT o.o_orderkey, COALESCE(c.code, -1) AS o_custkey FROM orders o LEFT JOIN c USING (o_custkey)",
)
def factorize_many(spark, d):
    """E3 on a column of many values."""
    from ledgerline.operators import encode

    return encode.factorize(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], [F.col("o_orderkey")])


@register(
    "category_shares_long",
    "WITH r AS (SELECT l_suppkey, COUNT(*) AS rows FROM lineitem GROUP BY 1), "
    "p AS (SELECT l_suppkey, 'l_partkey' AS column_name, CAST(l_partkey AS VARCHAR) AS value, COUNT(*) AS n FROM lineitem GROUP BY ALL "
    "UNION ALL SELECT l_suppkey, 'l_returnflag', l_returnflag, COUNT(*) FROM lineitem GROUP BY ALL) "
    "SELECT p.l_suppkey, column_name, value, CAST(n AS DOUBLE) / rows AS share FROM p JOIN r ON p.l_suppkey IS NOT DISTINCT FROM r.l_suppkey",
)
def category_shares_long(spark, d):
    """A8 in long form: any number of values per column."""
    from ledgerline.operators import encode

    return encode.long_shares(_t(spark, d, "lineitem"), "l_suppkey", ["l_partkey", "l_returnflag"])


@register(
    "loan_history",
    "WITH f AS (SELECT o_custkey, COUNT(o_orderdate) AS num_loan, COUNT(DISTINCT o_orderpriority) AS num_loantype "
    "FROM orders GROUP BY o_custkey) SELECT c.c_custkey, c.c_mktsegment, f.num_loan, f.num_loantype, "
    "CASE WHEN f.num_loantype = 0 THEN NULL ELSE CAST(f.num_loan AS DOUBLE) / f.num_loantype END AS ave_loantype "
    "FROM customer c LEFT JOIN f ON c.c_custkey = f.o_custkey",
)
def loan_history(spark, d):
    base, _ = _loan_history(spark, d)
    return base


def _loan_history(spark, d):
    from ledgerline.operators import encode

    loans = _t(spark, d, "orders").withColumn("d_end", R.day_number("o_orderdate", END_ORIGIN))
    cust = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    types = encode.vocabularies(loans, ["o_orderpriority"])["o_orderpriority"]
    return FE.loan_history(cust, "c_custkey", loans, "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "F",
                           "d_end", type_vocab=types)


@register(
    "loan_rows_enriched",
    "WITH o AS (SELECT *, CAST(date_diff('day', DATE '" + END_ORIGIN + "', CAST(o_orderdate AS DATE)) AS INTEGER) AS d_end FROM orders), "
    "s AS (SELECT o_custkey, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS DOUBLE) / COUNT(*) AS per_active, "
    "CAST(SUM(CASE WHEN d_end < 0 THEN 0 ELSE 1 END) AS DOUBLE) / COUNT(*) AS CREDIT_ENDDATE_PERCENTAGE FROM o GROUP BY o_custkey) "
    "SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, s.per_active, s.CREDIT_ENDDATE_PERCENTAGE FROM o LEFT JOIN s ON o.o_custkey = s.o_custkey",
)
def loan_rows_enriched(spark, d):
    _, loans = _loan_history(spark, d)
    return loans.select("o_orderkey", "o_custkey", "o_orderstatus", "per_active", "CREDIT_ENDDATE_PERCENTAGE")


def _behaviour_sql() -> str:
    tails = []
    for n in LAST_N:
        for col, tmpl in BEHAVIOUR_MEASURES.items():
            tails.append(f"{S.agg(f'(CASE WHEN rn <= {n} THEN {col} END)', 'mean', PREV_SCALES[col])} AS {tmpl.format(n=n)}")
    return (
        "WITH r AS (" + _RANKED_ORDERS_SQL + ") SELECT o_custkey, COUNT(DISTINCT o_orderkey) AS previous_application_number_of_prev_application, "
        "MAX(CASE WHEN rn = 1 THEN (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) END) AS previous_application_prev_was_approved, "
        "MAX(CASE WHEN rn = 1 THEN (CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) END) AS previous_application_prev_was_refused, "
        + ", ".join(tails) + " FROM r GROUP BY o_custkey"
    )


# The last-n mean name templates of the behaviour features
# (amount role → term template, order day → decision-day template).
BEHAVIOUR_MEASURES = {
    "o_totalprice": "previous_application_term_of_last_{n}_credits_mean",
    "o_orderday": "previous_application_days_decision_about_last_{n}_credits_mean",
}


@register("prev_behaviour", _behaviour_sql())
def prev_behaviour(spark, d):
    return FE.behaviour_features(
        _orders(spark, d), "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "F", "O",
        BEHAVIOUR_MEASURES, LAST_N, PREV_SCALES,
    )


# ------------------------------------------------------ table jobs
BURO_LOAN_SPEC = {"o_totalprice": ["max", "mean", "sum"], "o_orderday": ["min", "max", "mean", "var"]}
BURO_SCALES = {
    "o_totalprice": 2, "o_orderday": 0,
    "l_shipday_MIN": 0, "l_shipday_MAX": 0, "l_shipday_SIZE": 0,
}
MONTH_CATS = {"l_returnflag": RETURNFLAG_VALUES, "l_linestatus": LINESTATUS_VALUES}
SHARE_DIGITS = 12


def _bureau_sql() -> str:
    month_items = ["MIN(l_shipday) AS l_shipday_MIN", "MAX(l_shipday) AS l_shipday_MAX", "COUNT(*) AS l_shipday_SIZE"]
    share_names = []
    for c, vals in MONTH_CATS.items():
        month_items += S.shares(c, vals)
        share_names += [f"{c}_{v}_MEAN" for v in vals] + [f"{c}_nan_MEAN"]
    spec = dict(BURO_LOAN_SPEC)
    spec.update({"l_shipday_MIN": ["min"], "l_shipday_MAX": ["max"], "l_shipday_SIZE": ["mean", "sum"]})
    items = S.recipe(spec, S.upper("BURO_"), BURO_SCALES)
    for p, v in {"ACTIVE_": "O", "CLOSED_": "F"}.items():
        items += S.recipe(spec, S.upper(p), BURO_SCALES, where=f"o_orderstatus = {S.lit(v)}")
    items += S.shares("o_orderpriority", PRIORITY_VALUES, "BURO_") + S.shares("o_orderstatus", STATUS_VALUES, "BURO_")
    items += [f"floor(AVG({S.q(n)}) * 1e{SHARE_DIGITS} + 0.5) / 1e{SHARE_DIGITS} AS {S.q('BURO_' + n + '_MEAN')}" for n in share_names]
    return (
        "WITH m AS (SELECT *, " + S.day_number("l_shipdate") + " AS l_shipday FROM lineitem), "
        "per_loan AS (SELECT l_orderkey, " + ", ".join(month_items) + " FROM m GROUP BY l_orderkey), "
        "loans AS (SELECT o.*, " + S.day_number("o.o_orderdate") + " AS o_orderday, p.* EXCLUDE (l_orderkey) FROM orders o "
        "LEFT JOIN per_loan p ON o.o_orderkey = p.l_orderkey) "
        "SELECT o_custkey, " + ", ".join(items) + " FROM loans GROUP BY o_custkey"
    )


@register("bureau_features", _bureau_sql())
def bureau_features(spark, d):
    from ledgerline.operators.profile import report

    months = _t(spark, d, "lineitem").withColumn("l_shipday", R.day_number("l_shipdate"))
    out = FE.bureau_features(
        _orders(spark, d), "o_orderkey", "o_custkey", months, "l_orderkey", "l_shipday", list(MONTH_CATS),
        BURO_LOAN_SPEC, ["o_orderpriority", "o_orderstatus"], "o_orderstatus", "O", "F", BURO_SCALES,
    )
    # the mean of per-loan shares is a floating sum: reported to 12 decimals
    mom = [c for c in out.columns if c.endswith("_MEAN_MEAN") and c.startswith("BURO_l_")]
    return out.withColumns({c: report(F.col(c), SHARE_DIGITS) for c in mom})


# The output contract of the point-of-sale features
POS_SPEC = {"ev_day": ["max", "mean", "size"], "value": ["max", "mean"], "event_id": ["count"]}
POS_SCALES = {"ev_day": 0, "value": 2}


@register(
    "pos_features",
    "WITH e AS (SELECT *, " + S.day_number("ts") + " AS ev_day FROM events) SELECT user_id, "
    + ", ".join(S.recipe(POS_SPEC, S.upper("POS_"), POS_SCALES) + S.shares("event_type", EVENT_VALUES, "POS_"))
    + ", COUNT(*) AS POS_COUNT FROM e GROUP BY user_id",
)
def pos_features(spark, d):
    ev = _t(spark, d, "events").withColumn("ev_day", R.day_number("ts"))
    return FE.counted_features(ev, "user_id", POS_SPEC, ["event_type"], "POS_", "POS_COUNT", POS_SCALES)


# The output contract of the instalment features
INST_SPEC = {
    "l_linenumber": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "l_extendedprice": ["max", "mean", "sum"],
    "l_payment": ["min", "max", "mean", "sum"],
    "l_shipday": ["max", "mean", "sum"],
}
# discounted prices carry 4 decimals; days are whole
INST_SCALES = {"DPD": 0, "DBD": 0, "PAYMENT_DIFF": 4, "l_extendedprice": 2, "l_payment": 4, "l_shipday": 0}
RATIO_DIGITS = 9


def _instalment_sql() -> str:
    rows = (
        "SELECT *, CASE WHEN l_extendedprice = 0 THEN NULL ELSE l_payment / l_extendedprice END AS PAYMENT_PERC, "
        "l_extendedprice - l_payment AS PAYMENT_DIFF, "
        "CASE WHEN l_shipday - o_orderday > 0 THEN l_shipday - o_orderday ELSE 0 END AS DPD, "
        "CASE WHEN o_orderday - l_shipday > 0 THEN o_orderday - l_shipday ELSE 0 END AS DBD FROM (" + _INST_SQL + ")"
    )
    items = []
    for col, aggs in INST_SPEC.items():
        for a in aggs:
            e = S.agg(S.q(col), a, INST_SCALES.get(col))
            if col == "PAYMENT_PERC" and a != "max":
                e = f"floor(({e}) * 1e{RATIO_DIGITS} + 0.5) / 1e{RATIO_DIGITS}"
            items.append(f"{e} AS {S.q('INSTAL_' + col + '_' + a.upper())}")
    items += S.shares("l_returnflag", RETURNFLAG_VALUES, "INSTAL_")
    return "SELECT o_custkey, " + ", ".join(items) + ", COUNT(*) AS INSTAL_COUNT FROM (" + rows + ") GROUP BY o_custkey"


@register("instalment_features", _instalment_sql())
def instalment_features(spark, d):
    from ledgerline.operators.profile import report

    rows = FE.instalment_rows(_instalments(spark, d), "l_extendedprice", "l_payment", "o_orderday", "l_shipday")
    out = FE.counted_features(rows, "o_custkey", INST_SPEC, ["l_returnflag"], "INSTAL_", "INSTAL_COUNT", INST_SCALES)
    # the paid share is a true ratio (no fixed scale): floating sums are reported to 9 decimals
    perc = [f"INSTAL_PAYMENT_PERC_{a}" for a in ("MEAN", "SUM", "VAR")]
    return out.withColumns({c: report(F.col(c), RATIO_DIGITS) for c in perc})


CARD_DROP = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "o_orderkey", "o_orderday", "l_shipday", "l_payment"]
CARD_SCALES = {"l_quantity": 2, "l_extendedprice": 2, "l_discount": 2, "l_tax": 2, "l_linenumber": 0}
CARD_CATS = {"l_returnflag": RETURNFLAG_VALUES, "l_linestatus": LINESTATUS_VALUES}


def _card_cols() -> list[str]:
    cols = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    for c, vals in CARD_CATS.items():
        cols += [f"{c}_{v}" for v in vals] + [f"{c}_nan"]
    return cols


def _card_sql() -> str:
    onehots = []
    for c, vals in CARD_CATS.items():
        onehots += [f"CASE WHEN {c} = {S.lit(v)} THEN 1 ELSE 0 END AS {S.q(c + '_' + v)}" for v in vals]
        onehots.append(f"CAST({c} IS NULL AS INTEGER) AS {S.q(c + '_nan')}")
    scales = dict(CARD_SCALES)
    scales.update({c: 0 for c in _card_cols() if c not in scales})
    items = S.recipe({c: ["min", "max", "mean", "sum", "var"] for c in _card_cols()}, S.upper("CC_"), scales)
    return (
        "WITH b AS (SELECT o_custkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, " + ", ".join(onehots)
        + " FROM (" + _INST_SQL + ")) SELECT o_custkey, " + ", ".join(items) + ", COUNT(*) AS CC_COUNT FROM b GROUP BY o_custkey"
    )


@register("card_features", _card_sql())
def card_features(spark, d):
    scales = dict(CARD_SCALES)
    scales.update({c: 0 for c in _card_cols() if c not in scales})
    return FE.all_column_features(
        _instalments(spark, d), "o_custkey", CARD_DROP, "CC_", "CC_COUNT", scales=scales, cats=list(CARD_CATS),
    )


@register(
    "application_features",
    "WITH stacked AS (SELECT c.c_custkey AS sk_id, c.c_nationkey, c.c_acctbal, c.c_mktsegment, "
    "CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS TARGET, r.r_name FROM customer c "
    "LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey "
    "UNION ALL BY NAME SELECT s.s_suppkey AS sk_id, s.s_nationkey AS c_nationkey, s.s_acctbal AS c_acctbal, r.r_name FROM supplier s "
    "LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey), "
    "f AS (SELECT * FROM stacked WHERE c_mktsegment IS DISTINCT FROM 'HOUSEHOLD'), "
    "firsts AS (SELECT c_mktsegment, MIN(sk_id) AS m FROM f WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment), "
    "codes AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS code FROM firsts) "
    "SELECT f.sk_id, f.c_nationkey, f.c_acctbal, COALESCE(codes.code, -1) AS c_mktsegment, f.TARGET, "
    + ", ".join(f"CASE WHEN f.r_name = {S.lit(v)} THEN 1 ELSE 0 END AS {S.q('r_name_' + v)}" for v in ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])
    + ", CASE WHEN f.c_nationkey = 0 THEN NULL ELSE f.c_acctbal / f.c_nationkey END AS ACCTBAL_PER_NATION "
    "FROM f LEFT JOIN codes ON f.c_mktsegment = codes.c_mktsegment",
)
def application_features(spark, d):
    region = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    train = (
        _t(spark, d, "customer")
        .select(F.col("c_custkey").alias("sk_id"), "c_nationkey", "c_acctbal", "c_mktsegment",
                R.equal_flag(F.col("c_acctbal") < 0, True).alias("TARGET"))
        .join(region, F.col("c_nationkey") == F.col("n_nationkey"), "left").drop("n_nationkey")
    )
    test = (
        _t(spark, d, "supplier")
        .select(F.col("s_suppkey").alias("sk_id"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
        .join(region, F.col("c_nationkey") == F.col("n_nationkey"), "left").drop("n_nationkey")
    )
    return FE.application_features(
        train, test, "c_mktsegment", ["c_mktsegment"], [F.col("sk_id")], ["r_name"],
        {"ACCTBAL_PER_NATION": ("c_acctbal", "c_nationkey")}, excluded="HOUSEHOLD",
    )


# ---------------------------------------------------------------- profile
CAMPAIGN_SCALES = {"l_quantity": 2, "l_extendedprice": 2, "l_discount": 2, "l_tax": 2, "l_linenumber": 0, "label": 0}
CAMPAIGN_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _campaign(spark, d) -> DataFrame:
    """lineitem as the campaign table: label = returned (R)."""
    return _t(spark, d, "lineitem").withColumn("label", R.equal_flag("l_returnflag", "R"))


_CAMPAIGN_SQL = "SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem"


@register(
    "value_sets",
    "SELECT DISTINCT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders "
    "UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders",
)
def value_sets(spark, d):
    from ledgerline.operators import profile

    return profile.value_sets(_t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@register(
    "token_counts",
    "SELECT 'o_orderstatus' AS column_name, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS n FROM orders "
    "UNION ALL SELECT 'o_orderpriority', COUNT(*) FILTER (WHERE o_orderpriority = 'O') FROM orders",
)
def token_counts(spark, d):
    from ledgerline.operators import profile

    return profile.token_counts(_t(spark, d, "orders"), "O", ["o_orderstatus", "o_orderpriority"])


@register("class_counts", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag")
def class_counts(spark, d):
    from ledgerline.operators import profile

    return profile.class_counts(_t(spark, d, "lineitem"), "l_returnflag")


@register(
    "target_corr",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {S.corr(f, 'label', CAMPAIGN_SCALES[f], 0)} AS corr FROM ({_CAMPAIGN_SQL})" for f in CAMPAIGN_FEATURES
    ),
)
def target_corr(spark, d):
    from ledgerline.operators import profile

    return profile.target_correlation(_campaign(spark, d), "label", CAMPAIGN_FEATURES, scales=CAMPAIGN_SCALES)


DUMMY_THRESHOLD = 0.005


def _dummy_profile_sql() -> str:
    flags = {f"o_orderpriority_{v}": f"CASE WHEN o_orderpriority = {S.lit(v)} THEN 1 ELSE 0 END" for v in PRIORITY_VALUES}
    flags |= {f"o_orderstatus_{v}": f"CASE WHEN o_orderstatus = {S.lit(v)} THEN 1 ELSE 0 END" for v in STATUS_VALUES}
    source = (
        f"(SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_totalprice, {S.day_number('o_orderdate')} AS o_orderday, "
        + ", ".join(f"{e} AS {S.q(c)}" for c, e in flags.items()) + " FROM orders)"
    )
    scales = {"o_totalprice": 2, "o_orderday": 0} | dict.fromkeys(flags, 0)
    rows = " UNION ALL ".join(
        f"SELECT {S.lit(c)} AS feature, ABS({S.corr(S.q(c), 'label', k, 0)}) AS corr, {S.covar(S.q(c), 'label', k, 0)} AS covar FROM {source}" for c, k in scales.items()
    )
    return f"SELECT * FROM ({rows}) WHERE corr > {DUMMY_THRESHOLD}"


@register("dummy_profile", _dummy_profile_sql())
def dummy_profile(spark, d):
    """numbers and one-hot columns against the target, strong ones only."""
    from ledgerline.plans import profiling

    rows = _orders(spark, d).withColumn("label", R.equal_flag("o_orderstatus", "F"))
    return profiling.dummy_profile(rows, "label", ["o_orderpriority", "o_orderstatus"], ["o_totalprice", "o_orderday"], {"o_totalprice": 2, "o_orderday": 0}, DUMMY_THRESHOLD)


def _pairs_sql(kind: str, cols: list[str]) -> str:
    fn = S.corr if kind == "corr" else S.covar
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            e = fn(a, b, CAMPAIGN_SCALES[a], CAMPAIGN_SCALES[b])
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {e} AS value FROM ({_CAMPAIGN_SQL})")
            if a != b:
                parts.append(f"SELECT '{b}' AS a, '{a}' AS b, {e} AS value FROM ({_CAMPAIGN_SQL})")
    return " UNION ALL ".join(parts)


MATRIX_COLS = CAMPAIGN_FEATURES + ["label"]


@register("corr_matrix", _pairs_sql("corr", MATRIX_COLS))
def corr_matrix(spark, d):
    from ledgerline.operators import profile

    return profile.correlation_matrix(_campaign(spark, d), MATRIX_COLS, scales=CAMPAIGN_SCALES)


@register("covariance", _pairs_sql("covar", MATRIX_COLS))
def covariance(spark, d):
    from ledgerline.operators import profile

    return profile.correlation_matrix(_campaign(spark, d), MATRIX_COLS, kind="covar", scales=CAMPAIGN_SCALES)


@register(
    "corr_select",
    "SELECT a, b, abs(value) AS value FROM (" + _pairs_sql("corr", MATRIX_COLS) + ") WHERE abs(value) > 0.05",
)
def corr_select(spark, d):
    from ledgerline.operators import profile

    m = profile.correlation_matrix(_campaign(spark, d), MATRIX_COLS, scales=CAMPAIGN_SCALES)
    return profile.select_strong(m.withColumn("value", F.abs("value")), "value", 0.05)


# ------------------------------------------------------------- imputation (I)
_OL = "(" + _ORDER_LINES_SQL + ")"


@register(
    "impute_median",
    "SELECT o_orderkey, COALESCE(max_qty, (SELECT median(max_qty) FROM " + _OL + ")) AS max_qty, "
    "COALESCE(max_tax, (SELECT median(max_tax) FROM " + _OL + ")) AS max_tax, "
    "COALESCE(CAST(n_lines AS DOUBLE), (SELECT median(n_lines) FROM " + _OL + ")) AS n_lines FROM " + _OL,
)
def impute_median(spark, d):
    from ledgerline.operators import impute

    ol = _order_lines(spark, d).select("o_orderkey", "max_qty", "max_tax", "n_lines")
    # the input is a derived table (line aggregate ⋈ orders): the median's
    # passes read a narrow checkpoint instead of recomputing it
    return impute.impute(ol, ["max_qty", "max_tax", "n_lines"], "median", materialize=True)


@register(
    "impute_mode",
    "SELECT o_orderkey, COALESCE(top_flag, (SELECT top_flag FROM " + _OL + " WHERE top_flag IS NOT NULL GROUP BY top_flag "
    "ORDER BY COUNT(*) DESC, top_flag LIMIT 1)) AS accomp, COALESCE(n_open, (SELECT n_open FROM " + _OL
    + " WHERE n_open IS NOT NULL GROUP BY n_open ORDER BY COUNT(*) DESC, n_open LIMIT 1)) AS n_open FROM " + _OL,
)
def impute_mode(spark, d):
    from ledgerline.operators import impute

    ol = _order_lines(spark, d).select("o_orderkey", "top_flag", "n_open")
    return impute.impute(ol, ["top_flag", "n_open"], "most_frequent", rename={"top_flag": "accomp"})


@register(
    "impute_mean",
    "SELECT o_orderkey, COALESCE(max_tax, (SELECT " + S.agg("max_tax", "mean", 2) + " FROM " + _OL + ")) AS max_tax, "
    "COALESCE(CAST(n_lines AS DOUBLE), (SELECT " + S.agg("n_lines", "mean", 0) + " FROM " + _OL + ")) AS n_lines, "
    "COALESCE(n_returned, 0) AS n_returned FROM " + _OL,
)
def impute_mean(spark, d):
    from ledgerline.operators import impute

    ol = _order_lines(spark, d).select("o_orderkey", "max_tax", "n_lines", "n_returned")
    out = impute.impute(ol, ["max_tax", "n_lines"], "mean", scales={"max_tax": 2, "n_lines": 0})
    return impute.impute(out, ["n_returned"], "constant", fill_value=0)


REG_DIGITS = 6


@register(
    "impute_regression_one",
    "SELECT o_orderkey, COALESCE(max_qty, " + S.report(
        "(SELECT regr_intercept(max_qty, o_totalprice) FROM " + _OL + ") + (SELECT regr_slope(max_qty, o_totalprice) FROM "
        + _OL + ") * o_totalprice", REG_DIGITS) + ") AS max_qty FROM " + _OL,
)
def impute_regression_one(spark, d):
    from ledgerline.operators import impute
    from ledgerline.operators.profile import report

    ol = _order_lines(spark, d).select("o_orderkey", "max_qty", "o_totalprice")
    out = impute.regression_fill_one(ol, "max_qty", "o_totalprice", out_col="_filled")
    # fitted values are floating least-squares results: reported to 6 decimals
    return out.select(
        "o_orderkey",
        F.when(F.col("max_qty").isNull(), report(F.col("_filled"), REG_DIGITS)).otherwise(F.col("max_qty")).alias("max_qty"),
    )


def _regression_sql() -> str:
    """Normal equations of two predictors (centred), one step per filled column."""
    def step(source: str, y: str, a: str, b: str, out: str) -> str:
        coef = (
            f"(SELECT covar_pop({a}, {y}) AS ay, covar_pop({b}, {y}) AS b_y, var_pop({a}) AS aa, var_pop({b}) AS bb, covar_pop({a}, {b}) AS ab, "
            f"AVG({a}) AS ma, AVG({b}) AS mb, AVG({y}) AS my FROM {source} WHERE {y} IS NOT NULL)"
        )
        return (
            f"SELECT {source}.*, COALESCE(CAST({y} AS DOUBLE), my + (ay * bb - b_y * ab) / (aa * bb - ab * ab) * ({a} - ma) + (b_y * aa - ay * ab) / (aa * bb - ab * ab) * ({b} - mb)) AS {out} "
            f"FROM {source}, {coef} c"
        )

    done = lambda c: f"FLOOR({c} * 1e{REG_DIGITS - 2} + 0.5) / 1e{REG_DIGITS - 2} AS {c}"
    return (
        f"WITH s0 AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST({S.day_number('o_orderdate')} AS DOUBLE) AS o_orderday, max_qty, max_tax, min_discount FROM ({_ORDER_LINES_SQL})), "
        f"s1 AS ({step('s0', 'max_qty', 'o_totalprice', 'o_orderday', 'e2')}), s2 AS ({step('s1', 'max_tax', 'o_totalprice', 'e2', 'e1')}), "
        f"s3 AS ({step('s2', 'min_discount', 'o_orderday', 'e1', 'e3')}) SELECT o_orderkey, {done('e2')}, {done('e1')}, {done('e3')} FROM s3"
    )


@register("impute_regression", _regression_sql())
def impute_regression(spark, d):
    """I5 chain: each filled column feeds the next fit."""
    from ledgerline.operators import impute
    from ledgerline.operators.profile import report

    ol = _order_lines(spark, d).withColumn("o_orderday", R.day_number("o_orderdate"))
    out = impute.regression_fill(ol, "max_qty", ["o_totalprice", "o_orderday"], "e2")
    out = impute.regression_fill(out, "max_tax", ["o_totalprice", "e2"], "e1")
    out = impute.regression_fill(out, "min_discount", ["o_orderday", "e1"], "e3")
    # least-squares values are floating results: reported to four decimals
    return out.select("o_orderkey", *[report(F.col(c), REG_DIGITS - 2).alias(c) for c in ("e2", "e1", "e3")])


# ------------------------------------------------------------- sampling (M)
@register(
    "hash_split",
    "SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20 "
    "THEN 'test' ELSE 'train' END AS split FROM orders",
)
def hash_split(spark, d):
    from ledgerline.operators import sampling

    return sampling.hash_split(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 20)


@register(
    "oversample",
    "WITH b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders), "
    "c AS (SELECT SUM(label) AS n1, SUM(1 - label) AS n0 FROM b), "
    "m AS (SELECT o_orderkey, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 13) AS BIGINT), o_orderkey) AS rk "
    "FROM b WHERE label = 1) "
    "SELECT o_orderkey, 0 AS label, 0 AS copy FROM b WHERE label = 0 UNION ALL "
    "SELECT m.o_orderkey, 1 AS label, CAST(unnest(range(0, CAST(c.n0 // c.n1 + CASE WHEN m.rk <= c.n0 % c.n1 THEN 1 ELSE 0 END AS BIGINT))) AS INTEGER) AS copy "
    "FROM m, c",
)
def oversample(spark, d):
    from ledgerline.operators import sampling

    b = _t(spark, d, "orders").select("o_orderkey", R.equal_flag("o_orderstatus", "F").alias("label"))
    return sampling.oversample(b, "label", "o_orderkey", minority=1, majority=0)


# ------------------------------------------------------------ evaluation (V)
def _scored(spark, d) -> DataFrame:
    """A deterministic score from the data: 10 × discount, label = returned."""
    li = _campaign(spark, d)
    return li.select(
        "label", (F.col("l_discount") * F.lit(10.0)).alias("score"),
    ).withColumn("prediction", R.above_threshold("score", 0.5))


_SCORED_SQL = (
    "(SELECT label, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction FROM "
    "(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount * 10.0::DOUBLE AS score FROM lineitem))"
)


@register("confusion", "SELECT label, prediction, COUNT(*) AS n FROM " + _SCORED_SQL + " GROUP BY label, prediction")
def confusion(spark, d):
    from ledgerline.operators import evaluate

    return evaluate.confusion(_scored(spark, d))


@register(
    "accuracy",
    "SELECT CAST(SUM(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS correct, COUNT(*) AS total, "
    "CAST(SUM(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS accuracy FROM " + _SCORED_SQL,
)
def accuracy(spark, d):
    from ledgerline.operators import evaluate

    return evaluate.accuracy(_scored(spark, d))


def _report_sql() -> str:
    def safe(n, den):
        return f"COALESCE(CASE WHEN ({den}) = 0 THEN NULL ELSE CAST({n} AS DOUBLE) / CAST({den} AS DOUBLE) END, 0.0)"

    per = []
    for c in (0, 1):
        tp = f"COUNT(*) FILTER (WHERE label = {c} AND prediction = {c})"
        fp = f"COUNT(*) FILTER (WHERE label <> {c} AND prediction = {c})"
        fn = f"COUNT(*) FILTER (WHERE label = {c} AND prediction <> {c})"
        s = f"COUNT(*) FILTER (WHERE label = {c})"
        per.append(
            f"SELECT '{c}' AS class, {safe(tp, f'{tp} + {fp}')} AS precision, {safe(tp, f'{tp} + {fn}')} AS recall, "
            f"{safe(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1, {s} AS support FROM {_SCORED_SQL}"
        )
    rows = " UNION ALL ".join(per)
    return (
        f"WITH r AS ({rows}) SELECT * FROM r UNION ALL "
        "SELECT 'macro avg', SUM(precision) / 2.0::DOUBLE, SUM(recall) / 2.0::DOUBLE, SUM(f1) / 2.0::DOUBLE, CAST(SUM(support) AS BIGINT) FROM r UNION ALL "
        "SELECT 'weighted avg', SUM(precision * support) / CAST(SUM(support) AS DOUBLE), SUM(recall * support) / CAST(SUM(support) AS DOUBLE), "
        "SUM(f1 * support) / CAST(SUM(support) AS DOUBLE), CAST(SUM(support) AS BIGINT) FROM r"
    )


@register("class_report", _report_sql())
def class_report(spark, d):
    from ledgerline.operators import evaluate

    return evaluate.class_report(_scored(spark, d))


@register(
    "roc_auc",
    "WITH g AS (SELECT score AS s, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label <> 1) AS neg FROM "
    + _SCORED_SQL + " GROUP BY score), w AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) "
    "SELECT CAST(SUM(pos * (2 * below + neg)) AS DOUBLE) / CAST(2 * SUM(pos) * SUM(neg) AS DOUBLE) AS auc FROM w",
)
def roc_auc(spark, d):
    from ledgerline.operators import evaluate

    return evaluate.roc_auc(_scored(spark, d))


@register(
    "threshold_sweep",
    "WITH t AS (SELECT CAST(i AS DOUBLE) / 100.0::DOUBLE AS x FROM range(100) r(i)), "
    "c AS (SELECT t.x, COUNT(*) FILTER (WHERE s.label = 1 AND s.score > t.x) AS tp, COUNT(*) FILTER (WHERE s.label <> 1 AND s.score > t.x) AS fp, "
    "COUNT(*) FILTER (WHERE s.label = 1) AS npos FROM t, " + _SCORED_SQL + " s GROUP BY t.x) "
    "SELECT x, COALESCE(CASE WHEN tp + fp = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END, 0.0) AS precision, "
    "COALESCE(CASE WHEN npos = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / CAST(npos AS DOUBLE) END, 0.0) AS recall, "
    "COALESCE(CASE WHEN 2 * tp + fp + (npos - tp) = 0 THEN NULL ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + (npos - tp) AS DOUBLE) END, 0.0) AS f1 FROM c",
)
def threshold_sweep(spark, d):
    from ledgerline.operators import evaluate

    return evaluate.threshold_sweep(_scored(spark, d))


# --------------------------------------------------- models, rows-only (T, F12)
MODEL_FEATURES = ["o_totalprice", "o_orderday", "n_lines", "max_qty", "min_discount", "max_tax", "n_returned"]


def _modelling_frame(spark, d):
    """Order-level features (line aggregates median-imputed), label = status F.
    The frame is checkpointed once before the imputation statistics, so
    their passes, the split, the learners and scoring all read it."""
    from ledgerline.operators import impute
    from ledgerline.session import cores, cut_lineage

    ol = _order_lines(spark, d).withColumns(
        {"o_orderday": R.day_number("o_orderdate"), "label": R.equal_flag("o_orderstatus", "F")}
    )
    ol = cut_lineage(ol.select("o_orderkey", "label", *MODEL_FEATURES), min_partitions=cores(spark))
    ol = impute.impute(ol, ["n_lines", "max_qty", "min_discount", "max_tax"], "median")
    return impute.impute(ol, ["n_returned"], "constant", fill_value=0)


def _modelling_split(spark, d, rebalance: bool = True):
    """The split and rebalanced rows of :func:`_modelling_frame`."""
    from ledgerline.plans import scoring

    return scoring.prepare(_modelling_frame(spark, d), MODEL_FEATURES, "label", "o_orderkey", test_percent=20, rebalance=rebalance, checkpoint=False)


def _fit_query(make, scale: bool = False, weighted: bool = False, margin: bool = False):
    def run(spark, d):
        from ledgerline.operators import models
        from ledgerline.plans import scoring

        split = _modelling_split(spark, d, rebalance=not weighted)
        if weighted:
            split.train = models.with_class_weights(split.train, split.label)
        _, scored = scoring.fit_score(split, make(split), scale=scale)
        return _checked(scored, margin=margin)

    return run


def _checked(scored, margin: bool = False):
    """Scored test rows with what every learner must satisfy: the score is a probability (or a
    finite margin) and the prediction follows from it. Scores themselves depend on the learner."""
    s = F.col("score")
    ok = (F.abs(s) < F.lit(float("inf"))) if margin else s.between(0.0, 1.0)
    return scored.select(
        "id", "label", (ok & ~F.isnan("score")).alias("score_ok"), (F.col("prediction") == (s > F.lit(0.0 if margin else 0.5)).cast("int")).alias("prediction_ok")
    )


_TEST_ROWS_SQL = (
    "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, TRUE AS score_ok, TRUE AS prediction_ok "
    "FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20"
)


def _n_train(split) -> int:
    return split.train.count()


def _learners() -> dict:
    """Query name → (estimator factory given the split, standardise inputs).
    The deep boosting has the scripts' 100 rounds; ``fit_gbt`` keeps 20 of the 800 trees
    as a headline of the bench, ``fit_gbt_full`` has all of them."""
    from ledgerline.operators import models as M

    return {
        "fit_gbt": (lambda s: M.gradient_boosting(20, subsample=0.8), False),
        "fit_xgb_like": (lambda s: M.extreme_boosting(100), False),
        "fit_lgbm_like": (lambda s: M.leaf_limited_boosting(weightCol="weight"), False),
        "fit_logistic": (lambda s: M.logistic(_n_train(s)), True),
        "fit_svm": (lambda s: M.linear_svm(_n_train(s)), True),
    }


for _name, (_make, _scale) in _learners().items():
    # the leaf-limited booster weighs classes instead of rebalancing rows
    register(_name, _TEST_ROWS_SQL)(_fit_query(_make, _scale, weighted=_name == "fit_lgbm_like", margin=_name == "fit_svm"))


@register("fit_gbt_full", _TEST_ROWS_SQL)
def fit_gbt_full(spark, d):
    """T1 in full: 800 trees, each on 0.8 of the rows."""
    from ledgerline.operators import models

    return _fit_query(lambda s: models.gradient_boosting(800, subsample=0.8))(spark, d)


@register("fit_forest", _TEST_ROWS_SQL)
def fit_forest(spark, d):
    """T5: 100 trees of full depth."""
    from ledgerline.plans import scoring

    _, scored = scoring.fit_score_forest(_modelling_split(spark, d), n_trees=100)
    return _checked(scored)


@register("fit_bagging", _TEST_ROWS_SQL)
def fit_bagging(spark, d):
    """T4: 1000 bagged trees of full depth on exactly 120 draws each."""
    from ledgerline.plans import scoring

    _, scored = scoring.fit_score_bagged(_modelling_split(spark, d), n_estimators=1000, rows_per_tree=120)
    return _checked(scored)


_PLACE = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)"


@register(
    "bagging_bags",
    "WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY " + _PLACE.format("CAST(o_orderkey AS VARCHAR)") + ", o_orderkey) - 1 AS place FROM orders), "
    "d AS (SELECT CAST(i // 120 AS INTEGER) AS tree, " + _PLACE.format("'123|' || (i // 120) || '|' || (i % 120)") + " % (SELECT COUNT(*) FROM orders) AS place FROM range(120000) r(i)) "
    "SELECT tree, o_orderkey, COUNT(*) AS draws FROM d JOIN k USING (place) GROUP BY tree, o_orderkey",
)
def bagging_bags(spark, d):
    """T4: the rows that each of 1000 trees draws, exactly 120 with replacement."""
    from ledgerline.operators import trees

    return trees.exact_bags(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 1000, 120, seed=123).select("tree", "o_orderkey", "draws")


Z_DIGITS = 4


def _scale_sql() -> str:
    """Median-filled rows, the key-hash split, the rebalanced training rows as weights, then
    z-scores of the test rows by the weighted mean and n-denominator deviation."""
    medians = ("n_lines", "max_qty", "min_discount", "max_tax")
    cols = [f"CAST(COALESCE({c}, (SELECT MEDIAN({c}) FROM ol)) AS DOUBLE) AS {c}" for c in medians]
    cols += ["CAST(COALESCE(n_returned, 0) AS DOUBLE) AS n_returned", "CAST(o_totalprice AS DOUBLE) AS o_totalprice", "CAST(o_orderday AS DOUBLE) AS o_orderday"]
    md5 = "md5(CAST(o_orderkey AS VARCHAR))"
    mean = ", ".join(f"SUM(w * {c}) / SUM(w) AS m_{c}" for c in MODEL_FEATURES)
    dev = ", ".join(f"SQRT(SUM(w * ({c} - m_{c}) * ({c} - m_{c})) / SUM(w)) AS s_{c}" for c in MODEL_FEATURES)
    z = ", ".join(f"FLOOR(({c} - m_{c}) / s_{c} * 1e{Z_DIGITS} + 0.5) / 1e{Z_DIGITS} AS {c}" for c in MODEL_FEATURES)
    return (
        f"WITH ol AS (SELECT *, {S.day_number('o_orderdate')} AS o_orderday FROM ({_ORDER_LINES_SQL})), "
        f"b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, CAST('0x' || substr({md5}, 1, 8) AS BIGINT) % 100 < 20 AS test, "
        + ", ".join(cols) + " FROM ol), "
        f"t AS (SELECT b.*, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr({md5}, 1, 13) AS BIGINT), o_orderkey) - 1 AS place FROM b WHERE NOT test), "
        "n AS (SELECT SUM(label) AS n1, SUM(1 - label) AS n0 FROM t), "
        f"d AS (SELECT {_PLACE.format("'0|' || i")} % (SELECT CAST(n1 AS BIGINT) FROM n) AS place, COUNT(*) AS m FROM range((SELECT CAST(n0 AS BIGINT) FROM n)) r(i) GROUP BY 1), "
        "w AS (SELECT t.*, CASE WHEN label = 1 THEN COALESCE(m, 0) ELSE 1 END AS w FROM t LEFT JOIN d ON d.place = t.place), "
        f"m AS (SELECT {mean} FROM w), s AS (SELECT {dev} FROM w, m) "
        f"SELECT o_orderkey, label, {z} FROM b, m, s WHERE test"
    )


@register("standard_scale", _scale_sql())
def standard_scale(spark, d):
    """Z-scores with the training statistics applied to the test rows."""
    from ledgerline.operators import models
    from ledgerline.operators.profile import report

    split = _modelling_split(spark, d)
    _, test = models.standardise(split.train, [split.test], MODEL_FEATURES)
    return test.withColumns({c: report(F.col(c), Z_DIGITS) for c in MODEL_FEATURES})


@register("feature_importance", None)
def feature_importance(spark, d):
    """Forest importances as a (feature, importance) frame."""
    from ledgerline.operators import trees

    split = _modelling_split(spark, d)
    key = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("copy").cast("string"))
    return trees.random_forest(split.train, MODEL_FEATURES, "label", key, n_trees=100).importances()


@register("topk_refit", _TEST_ROWS_SQL)
def topk_refit(spark, d):
    """Keep the 4 most important forest features, refit a logistic model."""
    from ledgerline.operators import models
    from ledgerline.plans import scoring

    split = _modelling_split(spark, d)
    model, _ = scoring.fit_score_forest(split)
    top = scoring.top_features(model, MODEL_FEATURES, 4)
    narrowed = scoring.Split(split.train, split.test, top, split.label, split.id_col)
    _, scored = scoring.fit_score(narrowed, models.logistic(_n_train(split)), scale=True)
    return _checked(scored)


@register("scoring_job", None)
def scoring_job(spark, d):
    """forest importances, new split and rebalancing on the top 30 features (all seven here),
    bagged refit of 1000 trees and logistic refit, with report, AUC and sweep of their own scores."""
    from ledgerline.plans import scoring

    return scoring.scoring_job(_modelling_frame(spark, d), MODEL_FEATURES, "label", "o_orderkey")


@register("logistic_compare", None)
def logistic_compare(spark, d):
    """V6: raw versus standardised logistic regression on the same split."""
    from ledgerline.operators import evaluate, models
    from ledgerline.plans import scoring

    split = _modelling_split(spark, d)
    n = _n_train(split)
    _, raw = scoring.fit_score(split, models.logistic(n), scale=False)
    _, std = scoring.fit_score(split, models.logistic(n), scale=True)
    both = raw.withColumn("model", F.lit("logistic_raw")).unionByName(std.withColumn("model", F.lit("logistic_scaled")))
    return evaluate.compare(both, sweep=False)


# ------------------------------------------- a signal that a learner must find
PLANTED_FLOOR = 0.8


def _planted_split(spark, d, rebalance: bool = True):
    """The modelling rows with a label of their own: two or more returned lines, turned around
    for about a tenth of the orders by a hash of the key."""
    from ledgerline.operators import sampling
    from ledgerline.plans import scoring

    turned = sampling.key_bucket(F.concat_ws("|", F.lit("planted"), F.col("o_orderkey").cast("string"))) < 10
    frame = _modelling_frame(spark, d).withColumn("label", ((F.col("n_returned") >= 2) != turned).cast("int"))
    return scoring.prepare(frame, MODEL_FEATURES, "label", "o_orderkey", test_percent=20, rebalance=rebalance)


def _planted_sql(learner: str, ranked: bool) -> str:
    md5 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) % 100"
    turned = md5.format("'planted|' || o_orderkey") + " < 10"
    return (
        f"SELECT '{learner}' AS learner, COUNT(*) AS n_test, CAST(SUM(CASE WHEN (COALESCE(n_returned, 0) >= 2) <> ({turned}) THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, "
        f"TRUE AS auc_above_floor, {chr(39) + 'n_returned' + chr(39) if ranked else 'CAST(NULL AS VARCHAR)'} AS first_feature "
        f"FROM ({_ORDER_LINES_SQL}) WHERE {md5.format('CAST(o_orderkey AS VARCHAR)')} < 20"
    )


def _planted_result(spark, learner, scored, first):
    """One row: the test rows, and whether the learner's AUC on them is above the floor, which
    a learner that always answers the same (AUC one half) is not."""
    from ledgerline.operators import evaluate
    from ledgerline.session import cut_lineage

    scored = cut_lineage(scored)
    auc = evaluate.roc_auc(scored).select((F.col("auc") > F.lit(PLANTED_FLOOR)).alias("auc_above_floor"))
    counts = scored.agg(F.count(F.lit(1)).alias("n_test"), F.sum("label").cast("bigint").alias("n_positive"))
    # two aggregates of one row each
    return counts.join(auc, F.lit(True)).select(F.lit(learner).alias("learner"), "n_test", "n_positive", "auc_above_floor", F.lit(first).cast("string").alias("first_feature"))


def _planted_query(name: str):
    def run(spark, d):
        from ledgerline.operators import models
        from ledgerline.plans import scoring

        split = _planted_split(spark, d, rebalance=name != "fit_lgbm_like")
        if name in ("fit_forest", "fit_bagging"):
            model, scored = (scoring.fit_score_forest if name == "fit_forest" else scoring.fit_score_bagged)(split)
            first = scoring.top_features(model, MODEL_FEATURES, 1)[0]
        else:
            make, scale = _learners()[name]
            if name == "fit_lgbm_like":
                split.train = models.with_class_weights(split.train, split.label)
            model, scored = scoring.fit_score(split, make(split), scale=scale)
            first = None if scale else scoring.top_features(model, MODEL_FEATURES, 1)[0]
        return _planted_result(spark, name, scored, first)

    return run


for _name in ("fit_gbt", "fit_xgb_like", "fit_lgbm_like", "fit_forest", "fit_bagging", "fit_logistic", "fit_svm"):
    register(_name.replace("fit_", "planted_"), _planted_sql(_name, _name not in ("fit_logistic", "fit_svm")))(_planted_query(_name))


# ------------------------------------------------- V1-V6 of several models
_TWO_SCORES_SQL = (
    "SELECT model, label, s, CASE WHEN s > 0.5 THEN 1 ELSE 0 END AS p FROM ("
    "SELECT 'discount' AS model, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount * 10.0::DOUBLE AS s FROM lineitem UNION ALL "
    "SELECT 'tax', CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_tax * 12.5::DOUBLE FROM lineitem)"
)


def _compare_sql() -> str:
    def safe(n, den):
        return f"COALESCE(CASE WHEN ({den}) = 0 THEN NULL ELSE CAST({n} AS DOUBLE) / CAST({den} AS DOUBLE) END, 0.0)"

    measures = ("precision", "recall", "f1")
    long = lambda table, extra=(): " UNION ALL ".join(
        f"SELECT model, class || ' {m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {table}" for m in (*measures, *extra)
    )
    swept = " UNION ALL ".join(f"SELECT model, '{m} above ' || printf('%.2f', x) AS metric, {m} AS value FROM w" for m in measures)
    return (
        f"WITH t AS MATERIALIZED ({_TWO_SCORES_SQL}), cls AS (SELECT unnest([0, 1]) AS c), "
        "n AS (SELECT model, c, COUNT(*) FILTER (WHERE label = c AND p = c) AS tp, COUNT(*) FILTER (WHERE p = c) AS m, COUNT(*) FILTER (WHERE label = c) AS s FROM t, cls GROUP BY model, c), "
        f"r AS (SELECT model, CAST(c AS VARCHAR) AS class, {safe('tp', 'm')} AS precision, {safe('tp', 's')} AS recall, {safe('2 * tp', 's + m')} AS f1, s AS support FROM n), "
        "a AS (SELECT model, 'macro avg' AS class, SUM(precision) / 2.0::DOUBLE AS precision, SUM(recall) / 2.0::DOUBLE AS recall, SUM(f1) / 2.0::DOUBLE AS f1, CAST(SUM(support) AS BIGINT) AS support FROM r GROUP BY model UNION ALL "
        "SELECT model, 'weighted avg', " + ", ".join(f"SUM({m} * support) / CAST(SUM(support) AS DOUBLE)" for m in measures) + ", CAST(SUM(support) AS BIGINT) FROM r GROUP BY model), "
        "g AS (SELECT model, s, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label <> 1) AS neg FROM t GROUP BY model, s), "
        "b AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g), "
        "c AS (SELECT model, CAST(i AS DOUBLE) / 100.0::DOUBLE AS x, SUM(CASE WHEN s > CAST(i AS DOUBLE) / 100.0::DOUBLE THEN pos ELSE 0 END) AS tp, "
        "SUM(CASE WHEN s > CAST(i AS DOUBLE) / 100.0::DOUBLE THEN neg ELSE 0 END) AS fp, SUM(pos) AS npos FROM g, range(100) r(i) GROUP BY 1, 2), "
        f"w AS (SELECT model, x, {safe('tp', 'tp + fp')} AS precision, {safe('tp', 'npos')} AS recall, {safe('2 * tp', 'tp + fp + npos')} AS f1 FROM c), "
        "acc AS (SELECT model, CAST(SUM(CASE WHEN label = p THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS v FROM t GROUP BY model) "
        f"{long('r', ('support',))} UNION ALL {long('a', ('support',))} UNION ALL {swept} UNION ALL "
        "SELECT model, 'accuracy', v FROM acc UNION ALL SELECT model, 'accuracy percent', round_even(v, 2) * 100.0::DOUBLE FROM acc UNION ALL "
        "SELECT model, label || ' predicted ' || p, CAST(COUNT(*) AS DOUBLE) FROM t GROUP BY model, label, p UNION ALL "
        "SELECT model, 'roc_auc', CAST(SUM(pos * (2 * below + neg)) AS DOUBLE) / CAST(2 * SUM(pos) * SUM(neg) AS DOUBLE) FROM b GROUP BY model"
    )


@register("compare_models", _compare_sql())
def compare_models(spark, d):
    """V1-V6 of two scores over the lines in one keyed evaluation."""
    from ledgerline.operators import evaluate

    li = _campaign(spark, d).select("label", F.explode(F.array(
        F.struct(F.lit("discount").alias("model"), (F.col("l_discount") * F.lit(10.0)).alias("score")),
        F.struct(F.lit("tax").alias("model"), (F.col("l_tax") * F.lit(12.5)).alias("score")),
    )).alias("x")).select("label", "x.*")
    return evaluate.compare(li.withColumn("prediction", R.above_threshold("score", 0.5)))


@register(
    "bootstrap_sample",
    "WITH b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders), "
    "m AS (SELECT o_orderkey, row_number() OVER (ORDER BY " + _PLACE.format("CAST(o_orderkey AS VARCHAR)") + ", o_orderkey) - 1 AS place FROM b WHERE label = 1), "
    "d AS (SELECT " + _PLACE.format("'0|' || i") + " % (SELECT COUNT(*) FROM m) AS place, COUNT(*) AS n FROM range((SELECT COUNT(*) FROM b WHERE label = 0)) r(i) GROUP BY 1) "
    "SELECT o_orderkey, label, 0 AS copy FROM b WHERE label = 0 UNION ALL "
    "SELECT o_orderkey, 1, CAST(unnest(range(n)) AS INTEGER) FROM m JOIN d USING (place)",
)
def bootstrap_sample(spark, d):
    """M2: as many draws with replacement from the minority as the majority has rows."""
    from ledgerline.operators import sampling

    b = _t(spark, d, "orders").select("o_orderkey", R.equal_flag("o_orderstatus", "F").alias("label"))
    return sampling.bootstrap(b, "label", "o_orderkey")


# ------------------------------------------------------------ cleaning
def _cleaning_input(spark, d) -> DataFrame:
    """Order rows with line aggregates and 0/1 flags named by group."""
    return _order_lines(spark, d).withColumns(
        {
            "LINE_OPEN_NOT_DONE": R.positive("n_open").cast("int"),
            "LINE_RETURN_NOT_KEPT": R.positive("n_returned").cast("int"),
            "STATUS_NOT_FINAL": R.flag_unless_equal("o_orderstatus", "F"),
            "FLAG_URGENT": R.equal_flag("o_orderpriority", "1-URGENT"),
            "FLAG_HIGH": R.equal_flag("o_orderpriority", "2-HIGH"),
            "FLAG_LOW": R.equal_flag("o_orderpriority", "5-LOW"),
        }
    )


def _cleaning_plan():
    from ledgerline.plans.cleaning import CleaningPlan, FlagGroup, ImputeStep

    return CleaningPlan(
        drop=["o_orderdate", "o_custkey"],
        drop_patterns=["^min_"],
        groups=[
            FlagGroup("NOT", {"notmatch_lines": "LINE", "notmatch_status": "STATUS"}, ["STATUS_NOT_FINAL"], "notmatch_all"),
            FlagGroup("^FLAG_", {}, ["FLAG_LOW"], "doc_number"),
        ],
        excess=("o_totalprice", "max_qty"),
        indicators={"missing_tax": "max_tax", "missing_flag": "top_flag"},
        imputations=[
            ImputeStep(["max_tax", "n_lines"], "median", {"max_tax": "tax", "n_lines": "lines"}),
            ImputeStep(["top_flag"], "most_frequent", {"top_flag": "accomp"}),
            ImputeStep(["n_open", "n_returned"], "most_frequent"),
            ImputeStep(["excess_amt"], "median"),
        ],
        label_encode=["o_orderstatus", "o_orderpriority", "accomp"],
    )


def _clean_sql() -> str:
    src = (
        "SELECT *, CAST(COALESCE(n_open > 0, false) AS INTEGER) AS l_open, CAST(COALESCE(n_returned > 0, false) AS INTEGER) AS l_ret, "
        "CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS s_nf, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS f_u, "
        "CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS f_h, CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS f_l, "
        "o_totalprice - max_qty AS excess_amt0 FROM " + _OL
    )
    mode = lambda c: f"(SELECT {c} FROM s WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"
    step1 = (
        "SELECT o_orderkey, o_orderstatus, o_orderpriority, "
        f"COALESCE(n_open, {mode('n_open')}) AS n_open, COALESCE(n_returned, {mode('n_returned')}) AS n_returned, "
        "l_open + l_ret AS notmatch_lines, s_nf AS notmatch_status, l_open + l_ret + ABS(s_nf - 1) AS notmatch_all, "
        "f_u + f_h + ABS(f_l - 1) AS doc_number, COALESCE(excess_amt0 > 0, false) AS excess, "
        "CAST(max_tax IS NULL AS INTEGER) AS missing_tax, CAST(top_flag IS NULL AS INTEGER) AS missing_flag, "
        "COALESCE(max_tax, (SELECT median(max_tax) FROM s)) AS tax, COALESCE(CAST(n_lines AS DOUBLE), (SELECT median(n_lines) FROM s)) AS lines, "
        f"COALESCE(top_flag, {mode('top_flag')}) AS accomp, COALESCE(excess_amt0, (SELECT median(excess_amt0) FROM s)) AS excess_amt FROM s"
    )
    return (
        f"WITH s AS ({src}), c AS ({step1}) SELECT o_orderkey, "
        "CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus, "
        "CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority, "
        "n_open, n_returned, notmatch_lines, notmatch_status, notmatch_all, doc_number, excess, missing_tax, missing_flag, "
        "tax, lines, CAST(dense_rank() OVER (ORDER BY accomp) - 1 AS INTEGER) AS accomp, excess_amt FROM c"
    )


@register("clean_features", _clean_sql())
def clean_features(spark, d):
    from ledgerline.plans.cleaning import clean

    return clean(_cleaning_input(spark, d), _cleaning_plan())


# ------------------------------------------------------- F1 correlation, misc
CORR_DIGITS = 10


def _recipe_corr_sql() -> str:
    cols = [f"o_custkey_{a}_{m}" for m in RECIPE_MEASURES for a in FE.RECIPE_AGGREGATES]
    base = (
        "WITH o AS (SELECT *, " + S.day_number("o_orderdate") + " AS o_orderday FROM orders), f AS (SELECT o_custkey, "
        + ", ".join(S.recipe({m: FE.RECIPE_AGGREGATES for m in RECIPE_MEASURES}, lambda c, a: f"o_custkey_{a}_{c}", PREV_SCALES))
        + " FROM o GROUP BY o_custkey), t AS (SELECT f.*, CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS TARGET "
        "FROM customer c LEFT JOIN f ON c.c_custkey = f.o_custkey) "
    )
    return base + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {S.report(f'abs(corr({S.q(c)}, TARGET))', CORR_DIGITS)} AS corr FROM t" for c in cols
    )


@register("recipe_target_corr", _recipe_corr_sql())
def recipe_target_corr(spark, d):
    """|correlation| of the 45-style recipe columns with the target."""
    from ledgerline.operators import profile

    feats = FE.recipe_features(_orders(spark, d), "o_custkey", RECIPE_MEASURES, scales=PREV_SCALES)
    cust = _t(spark, d, "customer").select("c_custkey", R.equal_flag(F.col("c_acctbal") < 0, True).alias("TARGET"))
    table = grouped.attach(cust, feats, "c_custkey", "o_custkey")
    cols = [c for c in feats.columns if c != "o_custkey"]
    # recipe means / variances are not fixed-point: reported to 10 decimals
    return profile.target_correlation(table, "TARGET", cols, absolute=True, digits=CORR_DIGITS)


@register("shape", "SELECT COUNT(*) AS rows, 11 AS columns FROM lineitem")
def shape(spark, d):
    li = _t(spark, d, "lineitem")
    return li.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(li.columns)).alias("columns"))


@register("distinct_keys", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL")
def distinct_keys(spark, d):
    return grouped.distinct_keys(_t(spark, d, "orders"), "o_custkey")


@register("prediction_counts", "SELECT prediction, COUNT(*) AS n FROM " + _SCORED_SQL + " GROUP BY prediction")
def prediction_counts(spark, d):
    from ledgerline.operators import profile

    return profile.class_counts(_scored(spark, d), "prediction")


@register(
    "preview",
    "SELECT * FROM orders ORDER BY o_orderkey LIMIT 3",
)
def preview(spark, d):
    """The first rows of the campaign-style profile."""
    from ledgerline.plans.profiling import campaign_profile

    orders = _t(spark, d, "orders")
    return campaign_profile(orders.withColumn("label", R.equal_flag("o_orderstatus", "F")), "label", "o_orderkey")["preview"].drop("label")


# --------------------------------------------- the joined customer feature row
def _customer_features_sql() -> str:
    prev = _prev_sql().split("SELECT c.c_custkey")[0]  # WITH o ..., f AS (...)
    parts = [
        ("p", "(" + prev + "SELECT * FROM f)", "o_custkey"),
        ("b", "(" + _bureau_sql() + ")", "o_custkey"),
        ("i", "(" + _instalment_sql() + ")", "o_custkey"),
        ("k", "(" + _card_sql() + ")", "o_custkey"),
        ("h", "(SELECT o_custkey, COUNT(o_orderdate) AS num_loan, COUNT(DISTINCT o_orderpriority) AS num_loantype, "
              "CASE WHEN COUNT(DISTINCT o_orderpriority) = 0 THEN NULL ELSE CAST(COUNT(o_orderdate) AS DOUBLE) / COUNT(DISTINCT o_orderpriority) END AS ave_loantype "
              "FROM orders GROUP BY o_custkey)", "o_custkey"),
    ]
    select = ["c.c_custkey", "c.c_mktsegment", "c.c_acctbal"] + [f"{a}.* EXCLUDE ({k})" for a, _, k in parts]
    joins = " ".join(f"LEFT JOIN {q} {a} ON c.c_custkey = {a}.{k}" for a, q, k in parts)
    return "SELECT " + ", ".join(select) + " FROM customer c " + joins


def customer_loans(loans, vocab, share_names):
    """Customer grain over the loans (orders with their month features): previous-order, bureau
    and history features in one aggregate."""
    from ledgerline.functions.aggs import Recipe, presence_count, share_columns
    from ledgerline.operators.profile import report

    prev_fam = {p: F.col("o_orderstatus") == v for p, v in PREV_FAMILIES.items()}
    buro_spec = dict(BURO_LOAN_SPEC)
    buro_spec.update({"l_shipday_MIN": ["min"], "l_shipday_MAX": ["max"], "l_shipday_SIZE": ["mean", "sum"]})
    buro_fam = {"ACTIVE_": F.col("o_orderstatus") == "O", "CLOSED_": F.col("o_orderstatus") == "F"}
    loan_cols = []
    for c in ("o_orderpriority", "o_orderstatus"):
        loan_cols += share_columns(c, vocab[c], "PREV_", True) + share_columns(c, vocab[c], "BURO_", True)
    loan_cols += [report(F.avg(F.col(nm)), SHARE_DIGITS).alias(f"BURO_{nm}_MEAN") for nm in share_names]
    loan_cols += [
        F.count("o_orderdate").alias("num_loan"),
        presence_count(F.col("o_orderpriority"), vocab["o_orderpriority"]).alias("num_loantype"),
    ]
    return grouped.group_features(
        loans, "o_custkey",
        [Recipe(PREV_SPEC, prefix="PREV_", scales=PREV_SCALES, families=prev_fam),
         Recipe(buro_spec, prefix="BURO_", scales=BURO_SCALES, families=buro_fam)],
        loan_cols,
    ).withColumn("ave_loantype", R.ratio("num_loan", "num_loantype"))


def customer_lines(lines, vocab):
    """Customer grain over the lines with their order's customer and day: instalment and card
    features in one aggregate."""
    from ledgerline.functions.aggs import Recipe, share_columns
    from ledgerline.operators import encode
    from ledgerline.operators.profile import report

    inst = FE.instalment_rows(lines, "l_extendedprice", "l_payment", "o_orderday", "l_shipday")
    card_onehot = {}
    for c in CARD_CATS:
        card_onehot.update(encode.one_hot_columns(c, vocab[c], True))
    inst = inst.withColumns(card_onehot)
    card_scales = dict(CARD_SCALES)
    card_scales.update({c: 0 for c in _card_cols() if c not in card_scales})
    out = grouped.group_features(
        inst, "o_custkey",
        [Recipe(INST_SPEC, prefix="INSTAL_", scales=INST_SCALES, vocab={"l_linenumber": vocab["l_linenumber"]}),
         Recipe({c: ["min", "max", "mean", "sum", "var"] for c in _card_cols()}, prefix="CC_", scales=card_scales,
                flags=list(card_onehot))],
        share_columns("l_returnflag", vocab["l_returnflag"], "INSTAL_", True)
        + [F.count(F.lit(1)).alias("INSTAL_COUNT"), F.count(F.lit(1)).alias("CC_COUNT")],
    )
    perc = [f"INSTAL_PAYMENT_PERC_{a}" for a in ("MEAN", "SUM", "VAR")]
    return out.withColumns({c: report(F.col(c), RATIO_DIGITS) for c in perc})


@register("customer_features", _customer_features_sql())
def customer_features(spark, d):
    """The per-customer feature row: previous-order, loan-history, bureau,
    instalment and card features left-joined onto the customers.

    Jobs that share a grain and an input share one aggregate: the loans
    (orders ⟕ per-loan month features) feed a single per-customer aggregate
    holding the previous-order, bureau and history recipes, and the line
    rows (lines ⋈ orders) a single one holding the instalment and card
    recipes. Seven exchanges (PLANS.md) instead of fourteen for the separate jobs; both
    per-customer tables come out hash-partitioned on the customer key, so
    the final left joins only shuffle the customer table.
    """
    from ledgerline.functions.aggs import Recipe, share_columns
    from ledgerline.operators import encode

    orders = _orders(spark, d)
    lines = _t(spark, d, "lineitem").withColumns(
        {"l_shipday": R.day_number("l_shipdate"), "l_payment": F.col("l_extendedprice") * (1 - F.col("l_discount"))}
    )
    vocab = encode.vocabularies(orders, ["o_orderpriority", "o_orderstatus"])
    vocab.update(encode.vocabularies(lines, [*MONTH_CATS, "l_linenumber"]))

    # loan grain: month features of each order
    month_shares = []
    share_names = []
    for c in MONTH_CATS:
        month_shares += share_columns(c, vocab[c], "", True)
        share_names += [f"{c}_{v}_MEAN" for v in vocab[c]] + [f"{c}_nan_MEAN"]
    per_loan = lines.groupBy("l_orderkey").agg(
        *Recipe({"l_shipday": ["min", "max", "size"]}).columns(), *month_shares
    )
    loans = orders.join(per_loan, orders.o_orderkey == per_loan.l_orderkey, "left").drop("l_orderkey")
    owned = lines.join(orders.select("o_orderkey", "o_custkey", "o_orderday"), F.col("l_orderkey") == F.col("o_orderkey"))

    out = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = grouped.attach(out, customer_loans(loans, vocab, share_names), "c_custkey", "o_custkey")
    return grouped.attach(out, customer_lines(owned, vocab), "c_custkey", "o_custkey")


# the registered whole jobs join this registry
from ledgerline.plans import jobs as _jobs  # noqa: E402, F401
