"""Registered queries of whole jobs: full cleaning with the regression chain (F4, I5, P10), the
campaign profile as one result (F11), inferred CSV types (S1), column selection (P1, P6, P12),
one-hot vectors for models (E1), and the joined customer row over bucketed tables (J1, J2).
Imported by :mod:`ledgerline.plans.catalog`, whose registry they join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import columns as C
from ledgerline.functions import rows as R
from ledgerline.functions.aggs import Recipe, share_columns
from ledgerline.operators import encode, grouped, impute, profile
from ledgerline.plans import catalog as Q
from ledgerline.plans import features as FE
from ledgerline.plans import sqlforms as S
from ledgerline.plans.cleaning import CleaningPlan, FlagGroup, ImputeStep, clean

register = Q.register

# ----------------------------------------------------- wide order rows
_LINE_STATS = {
    "n_lines": ("count", "*"), "max_qty": ("max", "l_quantity"), "min_qty": ("min", "l_quantity"), "sum_qty": ("sum", "l_quantity"),
    "max_price": ("max", "l_extendedprice"), "min_discount": ("min", "l_discount"), "max_discount": ("max", "l_discount"),
    "min_tax": ("min", "l_tax"), "max_tax": ("max", "l_tax"), "max_supp": ("max", "l_suppkey"), "top_flag": ("max", "l_returnflag"),
}
#: the three targets of the chain and the orders in which each is missing (besides orders without lines)
_TARGETS = {"src_2": ("max_price", 5, 0), "src_1": ("sum_qty", 3, 0), "src_3": ("max_tax", 4, 1)}
_E2 = ["o_totalprice", "o_orderday", "n_lines", "max_qty", "min_qty", "min_discount", "max_discount", "n_returned", "n_open"]
_E1 = [
    "o_totalprice", "o_orderday", "n_lines", "max_qty", "min_qty", "min_discount", "max_discount", "min_tax", "n_returned", "n_open", "c_acctbal",
    "c_nationkey", "max_supp", "e2",
]
_E3 = ["o_orderday", "n_lines", "min_tax", "n_returned", "n_open", "c_acctbal", "min_discount", "max_qty", "e1"]
LINKS = [("src_2", _E2, "e2"), ("src_1", _E1, "e1"), ("src_3", _E3, "e3")]
_FILLED = ["n_lines", "max_qty", "min_qty", "min_discount", "max_discount", "min_tax", "max_supp", "n_returned", "n_open"]
LINK_DIGITS = {"e2": 1, "e1": 4, "e3": 6}


def _wide_orders(spark, d) -> DataFrame:
    """Orders with line statistics (missing without lines), their customer's columns, and three
    targets that are missing in different orders."""
    stats = [getattr(F, a)(F.lit(1) if c == "*" else F.col(c)).alias(n) for n, (a, c) in _LINE_STATS.items()]
    stats += [F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.count_if(F.col("l_linestatus") == "O").alias("n_open")]
    lines = Q._t(spark, d, "lineitem").groupBy("l_orderkey").agg(*stats)
    customers = Q._t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = Q._orders(spark, d).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    out = out.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").drop("c_custkey")
    return out.withColumns({t: F.when(F.col("o_orderkey") % m != r, F.col(c)) for t, (c, m, r) in _TARGETS.items()})


_WIDE_SQL = (
    "SELECT o.*, " + S.day_number("o_orderdate") + " AS o_orderday, p.* EXCLUDE (l_orderkey), c_acctbal, c_nationkey, "
    + ", ".join(f"CASE WHEN o_orderkey % {m} <> {r} THEN {c} END AS {t}" for t, (c, m, r) in _TARGETS.items())
    + " FROM orders o LEFT JOIN (SELECT l_orderkey, " + ", ".join(f"{a}({c}) AS {n}" for n, (a, c) in _LINE_STATS.items())
    + ", COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS n_open FROM lineitem GROUP BY 1) p "
    "ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey"
)


def _link_sql(source: str, target: str, predictors: Sequence[str], out: str) -> str:
    """CTEs that fit one link by its centred normal equations (one elimination step per predictor)
    and end in ``{out}_done``: ``source`` with the filled column ``out``."""
    k = len(predictors)
    x = [f"({p} - m{i})" for i, p in enumerate(predictors)] + [f"({target} - my)"]
    rows = ", ".join("[" + ", ".join(f"SUM({x[i]} * {x[j]})" for j in range(k + 1)) + "]" for i in range(k))
    ctes = [
        f"{out}_m AS (SELECT " + ", ".join(f"AVG({p}) AS m{i}" for i, p in enumerate(predictors)) + f", AVG({target}) AS my FROM {source} WHERE {target} IS NOT NULL)",
        f"{out}_g0 AS (SELECT [{rows}] AS m FROM {source}, {out}_m WHERE {target} IS NOT NULL)",
    ]
    for p in range(1, k + 1):
        ctes.append(
            f"{out}_g{p} AS MATERIALIZED (SELECT list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = {p} THEN list_transform(range(1, {k + 2}), lambda j: m[{p}][j] / m[{p}][{p}]) "
            f"ELSE list_transform(range(1, {k + 2}), lambda j: m[i][j] - m[i][{p}] * m[{p}][j] / m[{p}][{p}]) END) AS m FROM {out}_g{p - 1})"
        )
    fitted = "my + " + " + ".join(f"m[{i + 1}][{k + 1}] * ({p} - m{i})" for i, p in enumerate(predictors))
    ctes.append(f"{out}_done AS MATERIALIZED (SELECT {source}.*, COALESCE(CAST({target} AS DOUBLE), {fitted}) AS {out} FROM {source}, {out}_m, {out}_g{k})")
    return ", ".join(ctes)


def _chain_sql(source: str) -> str:
    parts = []
    for target, predictors, out in LINKS:
        parts.append(_link_sql(source, target, predictors, out))
        source = f"{out}_done"
    return ", ".join(parts)


def _median_sql(c: str) -> str:
    return f"COALESCE(CAST({c} AS DOUBLE), (SELECT MEDIAN({c}) FROM s))"


_DONE = ", ".join(f"{S.report(c, n)} AS {c}" for c, n in LINK_DIGITS.items())


@register(
    "impute_chain",
    f"WITH s AS MATERIALIZED ({_WIDE_SQL}), f AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'{_median_sql(c)} AS {c}' for c in _FILLED)}) FROM s), "
    f"{_chain_sql('f')} SELECT o_orderkey, {_DONE} FROM e3_done",
)
def impute_chain(spark, d):
    """I5 in full: e2 from 9 predictors, e1 from 14 with e2, e3 from 9 with e1; one scan for all fits."""
    from ledgerline.session import cut_lineage

    rows = cut_lineage(_wide_orders(spark, d))
    out = impute.regression_chain(impute.impute(rows, _FILLED, "median"), LINKS)
    return out.select("o_orderkey", *[profile.report(F.col(c), n).alias(c) for c, n in LINK_DIGITS.items()])


# ------------------------------------------------------- the whole cleaning
_EVENTS = {"num_events": "num_events_done", "num_types": "num_types_done", "ave_type": "ave_type_done"}
_MEAN_DIGITS = 9


def _cleaning_rows(spark, d) -> DataFrame:
    """The wide orders with 0/1 flags by group, the customer's events (missing for most customers)
    and the recipe columns of the customer's orders."""
    events = Q._t(spark, d, "events").groupBy("user_id").agg(F.count("event_id").alias("num_events"), F.countDistinct("event_type").alias("num_types"))
    events = events.withColumn("ave_type", R.ratio("num_events", "num_types"))
    recipe = FE.recipe_features(Q._orders(spark, d), "o_custkey", Q.RECIPE_MEASURES, scales=Q.PREV_SCALES)
    out = grouped.attach(_wide_orders(spark, d), events, "o_custkey", "user_id")
    out = grouped.attach(out, recipe.withColumnRenamed("o_custkey", "_key"), "o_custkey", "_key")
    return out.withColumns({
        "LINE_OPEN_NOT_DONE": R.positive("n_open").cast("int"), "LINE_RETURN_NOT_KEPT": R.positive("n_returned").cast("int"),
        "STATUS_NOT_FINAL": R.flag_unless_equal("o_orderstatus", "F"), "FLAG_URGENT": R.equal_flag("o_orderpriority", "1-URGENT"),
        "FLAG_HIGH": R.equal_flag("o_orderpriority", "2-HIGH"), "FLAG_LOW": R.equal_flag("o_orderpriority", "5-LOW"),
    })


def cleaning_plan(recipe_columns: Sequence[str]) -> CleaningPlan:
    """Every step of the scripts' cleaning, in their order; the recipe columns are named by their
    generated names (P10)."""
    return CleaningPlan(
        drop=["o_orderdate", "o_custkey"],
        drop_patterns=["^max_tax$", "^sum_"],
        groups=[
            FlagGroup("NOT", {"notmatch_lines": "LINE", "notmatch_status": "STATUS"}, ["STATUS_NOT_FINAL"], "notmatch_all"),
            FlagGroup("^FLAG_", {}, ["FLAG_LOW"], "doc_number"),
        ],
        excess=("excess_of", "excess_need"),
        indicators={"missing_tax": "min_tax", "missing_flag": "top_flag", "missing_supp": "max_supp"},
        imputations=[
            ImputeStep(["n_lines", "max_qty", "min_qty", "min_discount", "max_discount", "min_tax", "max_supp"], "median"),
            ImputeStep(["top_flag"], "most_frequent", {"top_flag": "accomp"}),
            ImputeStep(["n_open", "n_returned"], "most_frequent"),
            ImputeStep(["excess_amt"], "median"),
            ImputeStep(list(_EVENTS), "mean", _EVENTS, {"num_events": 0, "num_types": 0}),
            ImputeStep(list(recipe_columns), "median"),
        ],
        label_encode=["o_orderstatus", "o_orderpriority", "accomp"],
        regressions=[(t, [p if p != "c_nationkey" else "o_orderpriority" for p in ps], o) for t, ps, o in LINKS],
    )


_RECIPE_COLUMNS = [f"o_custkey_{a}_{m}" for m in Q.RECIPE_MEASURES for a in FE.RECIPE_AGGREGATES]


def _clean_full_sql() -> str:
    recipe = ", ".join(S.recipe({m: FE.RECIPE_AGGREGATES for m in Q.RECIPE_MEASURES}, lambda c, a: f"o_custkey_{a}_{c}", Q.PREV_SCALES))
    source = (
        f"SELECT w.*, v.* EXCLUDE (user_id), r.* EXCLUDE (rk), o_totalprice - max_price AS excess_amt0 FROM ({_WIDE_SQL}) w "
        "LEFT JOIN (SELECT user_id, COUNT(event_id) AS num_events, COUNT(DISTINCT event_type) AS num_types, "
        "CAST(COUNT(event_id) AS DOUBLE) / NULLIF(COUNT(DISTINCT event_type), 0) AS ave_type FROM events GROUP BY 1) v ON o_custkey = user_id "
        f"LEFT JOIN (SELECT o_custkey AS rk, {recipe} FROM (SELECT *, {S.day_number('o_orderdate')} AS o_orderday FROM orders) GROUP BY 1) r ON o_custkey = rk"
    )
    mode = lambda c: f"(SELECT {c} FROM s WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"
    open_, ret = "CAST(COALESCE(n_open > 0, false) AS INTEGER)", "CAST(COALESCE(n_returned > 0, false) AS INTEGER)"
    not_final = "CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END"
    flag = lambda v: f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END"
    medians = ["n_lines", "max_qty", "min_qty", "min_discount", "max_discount", "min_tax", "max_supp", *_RECIPE_COLUMNS]
    rank = lambda c: f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER)"
    filled = (
        "SELECT o_orderkey, o_totalprice, o_orderday, c_acctbal, src_1, src_2, src_3, o_orderstatus, o_orderpriority, "
        f"{open_} + {ret} AS notmatch_lines, {not_final} AS notmatch_status, {open_} + {ret} + ABS(({not_final}) - 1) AS notmatch_all, "
        f"{flag('1-URGENT')} + {flag('2-HIGH')} + ABS({flag('5-LOW')} - 1) AS doc_number, COALESCE(excess_amt0 > 0, false) AS excess, "
        "CAST(min_tax IS NULL AS INTEGER) AS missing_tax, CAST(top_flag IS NULL AS INTEGER) AS missing_flag, CAST(max_supp IS NULL AS INTEGER) AS missing_supp, "
        + ", ".join(f"COALESCE(CAST({S.q(c)} AS DOUBLE), (SELECT MEDIAN({S.q(c)}) FROM s)) AS {S.q(c)}" for c in medians)
        + f", COALESCE(top_flag, {mode('top_flag')}) AS accomp, COALESCE(n_open, {mode('n_open')}) AS n_open, COALESCE(n_returned, {mode('n_returned')}) AS n_returned, "
        "COALESCE(excess_amt0, (SELECT MEDIAN(excess_amt0) FROM s)) AS excess_amt, "
        + ", ".join(f"COALESCE(CAST({c} AS DOUBLE), (SELECT CAST(SUM({c}) AS DOUBLE) / COUNT({c}) FROM s)) AS {n}" for c, n in _EVENTS.items())
        + " FROM s"
    )
    chain, source_ = [], "f"
    for t, ps, o in LINKS:
        chain.append(_link_sql(source_, t, [p if p != "c_nationkey" else "o_orderpriority" for p in ps], o))
        source_ = f"{o}_done"
    keep = [
        "o_orderkey", "o_totalprice", "o_orderday", "c_acctbal", "o_orderstatus", "o_orderpriority", "notmatch_lines", "notmatch_status", "notmatch_all", "doc_number",
        "excess", "missing_tax", "missing_flag", "missing_supp", *medians, "accomp", "n_open", "n_returned", "excess_amt", "num_events_done", "num_types_done",
    ]
    return (
        f"WITH s AS MATERIALIZED ({source}), f0 AS MATERIALIZED ({filled}), "
        f"f AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'{rank(c)} AS {c}' for c in ('o_orderstatus', 'o_orderpriority', 'accomp'))}) FROM f0), "
        + ", ".join(chain) + " SELECT " + ", ".join(S.q(c) for c in keep) + f", {S.report('ave_type_done', _MEAN_DIGITS)} AS ave_type_done, {_DONE} FROM e3_done"
    )


@register("clean_full", _clean_full_sql())
def clean_full(spark, d):
    """F4 with every step: pattern drops, flag groups, excess, indicators, median / mode / mean
    fills, recipe columns by generated name (P10), codes, and the chain of 9, 14 and 9 predictors."""
    rows = _cleaning_rows(spark, d).withColumns({"excess_of": F.col("o_totalprice"), "excess_need": F.col("max_price")}).drop("max_price", "c_nationkey")
    out = clean(rows, cleaning_plan(C.matching(rows, "^o_custkey_")))
    out = out.withColumn("ave_type_done", profile.report(F.col("ave_type_done"), _MEAN_DIGITS))
    return out.withColumns({c: profile.report(F.col(c), n) for c, n in LINK_DIGITS.items()})


# ------------------------------------------------- campaign profile, one result
_PROFILE_SCALES = {"o_custkey": 0, "o_totalprice": 2, "label": 0}


def _profile_sql() -> str:
    source = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders)"
    none = "CAST(NULL AS DOUBLE)"
    parts = [
        f"SELECT 'shape' AS section, 'rows' AS item, NULL AS other, CAST(COUNT(*) AS DOUBLE) AS value FROM {source}",
        "SELECT 'shape', 'columns', NULL, 6.0::DOUBLE",
        f"SELECT 'class_balance', CAST(label AS VARCHAR), NULL, CAST(COUNT(*) AS DOUBLE) FROM {source} GROUP BY label",
    ]
    for c in ("o_orderstatus", "o_orderpriority"):
        parts.append(f"SELECT 'token_counts', '{c}', 'unknown', CAST(COUNT(*) FILTER (WHERE {c} = 'unknown') AS DOUBLE) FROM {source}")
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "label"):
        parts.append(f"SELECT DISTINCT 'value_sets', '{c}', CAST({c} AS VARCHAR), {none} FROM {source}")
        first = f"(SELECT * , row_number() OVER (ORDER BY o_orderkey) AS n FROM {source} QUALIFY n <= 3)"
        parts.append(f"SELECT 'preview', '{c}', CAST({c} AS VARCHAR), CAST(n AS DOUBLE) FROM {first}")
    cols = list(_PROFILE_SCALES)
    for kind, fn in (("correlation", S.corr), ("covariance", S.covar)):
        for i, a in enumerate(cols):
            for b in cols[i:]:
                e = fn(a, b, _PROFILE_SCALES[a], _PROFILE_SCALES[b])
                parts += [f"SELECT '{kind}', '{x}', '{y}', {e} FROM {source}" for x, y in {(a, b), (b, a)}]
    for a in cols:
        e = f"ABS({S.corr(a, 'label', _PROFILE_SCALES[a], 0)})"
        parts.append(f"SELECT 'strong', '{a}', 'label', {e} AS v FROM {source} HAVING {e} > 0.05")
    flags = {f"o_orderpriority_{v}": f"CASE WHEN o_orderpriority = {S.lit(v)} THEN 1 ELSE 0 END" for v in Q.PRIORITY_VALUES}
    flags |= {f"o_orderstatus_{v}": f"CASE WHEN o_orderstatus = {S.lit(v)} THEN 1 ELSE 0 END" for v in Q.STATUS_VALUES}
    wide = "(SELECT *, " + ", ".join(f"{e} AS {S.q(c)}" for c, e in flags.items()) + f" FROM {source})"
    for c, k in {"o_custkey": 0, "o_totalprice": 2, **dict.fromkeys(flags, 0)}.items():
        r = f"ABS({S.corr(S.q(c), 'label', k, 0)})"
        parts.append(f"SELECT 'strong_dummies', {S.lit(c)}, 'corr', {r} FROM {wide} HAVING {r} > 0.05")
        parts.append(f"SELECT 'strong_dummies', {S.lit(c)}, 'covar', {S.covar(S.q(c), 'label', k, 0)} FROM {wide} HAVING {r} > 0.05")
    return " UNION ALL ".join(parts)


@register("profile_report", _profile_sql())
def profile_report(spark, d):
    """the whole campaign profile as (section, item, other, value) rows."""
    from ledgerline.plans.profiling import campaign_report

    orders = Q._t(spark, d, "orders").withColumn("label", R.equal_flag("o_orderstatus", "F"))
    return campaign_report(orders, "label", "o_orderkey", scales=_PROFILE_SCALES, drop=["o_orderdate"])


# ------------------------------------------------------ inferred CSV types
_CSV_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, o_totalprice > 200000 AS is_large, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS some_price FROM orders"


@register("csv_inferred", _CSV_SQL)
def csv_inferred(spark, d):
    """The orders as CSV text with a header, read back with inferred types."""
    import uuid

    from ledgerline.session import checkpoint_dir
    from ledgerline.sources import read_csv_inferred

    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgerline-csv-{uuid.uuid4().hex}"
    orders = Q._t(spark, d, "orders").withColumns({
        "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"), "is_large": F.col("o_totalprice") > 200000,
        "some_price": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")),
    })
    orders.write.option("header", True).csv(path)
    return read_csv_inferred(spark, path, keep_rejected=False)


@register(
    "select_columns",
    "SELECT c_custkey AS customer, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, "
    "c_name || '|' || c_mktsegment AS texts, CAST(c_custkey + c_nationkey AS DOUBLE) + c_acctbal AS numbers, c_custkey + c_nationkey AS keys FROM customer",
)
def select_columns(spark, d):
    """P1 rename by position, P12 columns by type, P6 columns whose name contains a text."""
    customers = Q._t(spark, d, "customer")
    keys = C.containing(customers, "key")
    texts = F.concat_ws("|", *[C.named(c) for c in C.string_columns(customers)])
    numbers = R.row_sum([C.named(c).cast("double") for c in C.numeric_columns(customers)])
    wide = customers.withColumns({"texts": texts, "numbers": numbers, "keys": C.named(keys[0]) + C.named(keys[1])})
    return C.rename_all(wide, ["customer", "name", "nation", "balance", "segment", "texts", "numbers", "keys"])


# ----------------------------------------------------- one-hot vectors
def _pairs(spark, d) -> DataFrame:
    """Lines with a category of very many values (part and supplier) and one of few, and a label
    that depends on the part alone, turned around for a tenth of the lines."""
    from ledgerline.operators.sampling import key_bucket

    turned = key_bucket(_line(F.col("l_shipdate").cast("date"))) < 10
    return Q._t(spark, d, "lineitem").select(
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_partkey").cast("string").alias("part"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("pair"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_returnflag")).alias("flag"), (((F.col("l_partkey") % 7) < 3) != turned).cast("int").alias("label"),
    )


def _line(day: Column) -> Column:
    """The text of a line's key."""
    return F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), day.cast("string"))


@register(
    "sparse_onehot",
    "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey || '-' || l_suppkey AS pair, CASE WHEN l_linenumber % 4 <> 0 THEN l_returnflag END AS flag FROM lineitem), "
    "p AS (SELECT pair, row_number() OVER (ORDER BY pair) - 1 AS c FROM (SELECT DISTINCT pair FROM l)), "
    "f AS (SELECT flag, row_number() OVER (ORDER BY flag) - 1 AS c FROM (SELECT DISTINCT flag FROM l WHERE flag IS NOT NULL)) "
    "SELECT l_orderkey, l_linenumber, CAST(p.c AS INTEGER) AS pair_at, CAST((SELECT COUNT(*) FROM p) + 1 + COALESCE(f.c, (SELECT COUNT(*) FROM f)) AS INTEGER) AS flag_at "
    "FROM l JOIN p USING (pair) LEFT JOIN f USING (flag)",
)
def sparse_onehot(spark, d):
    """E1 for models: the places of each line's values in a one-hot vector of all part-supplier
    pairs (tens of thousands) and return flags, read from the sparse vectors themselves."""
    out, _ = encode.sparse_one_hot(_pairs(spark, d), ["pair", "flag"])
    return out.select("l_orderkey", "l_linenumber", encode.places("onehot").alias("at")).select("l_orderkey", "l_linenumber", F.col("at")[0].alias("pair_at"), F.col("at")[1].alias("flag_at"))


@register(
    "sparse_logistic",
    "SELECT COUNT(*) AS n_test, (SELECT COUNT(DISTINCT l_partkey || '-' || l_suppkey) + COUNT(DISTINCT l_partkey) + 2 FROM lineitem) AS n_coefficients, TRUE AS auc_above_floor FROM lineitem "
    "WHERE CAST('0x' || substr(md5('test|' || l_orderkey || '|' || l_linenumber || '|' || strftime(l_shipdate, '%Y-%m-%d')), 1, 8) AS BIGINT) % 100 < 20",
)
def sparse_logistic(spark, d):
    """E1 in the model path: a logistic fit over one-hot vectors of every part and every
    part-supplier pair finds the parts' label."""
    from ledgerline.operators import evaluate, sparse
    from ledgerline.operators.sampling import key_bucket

    pairs = _pairs(spark, d).withColumn("test", key_bucket(F.concat_ws("|", F.lit("test"), _line(F.col("day")))) < 20)
    # the key's text is made of its parts again where it is needed
    rows, sizes = encode.sparse_one_hot(pairs, ["part", "pair"], written=["l_orderkey", "l_linenumber", "day", "label", "test", "part"])
    rows = rows.withColumn("line", _line(F.col("day")))
    model = sparse.sparse_logistic(rows.where("not test"), "label", "onehot", "part", sum(sizes), reg=1e-4)
    scored = model.score(rows.where("test"), "line", "label", "onehot")
    auc = evaluate.roc_auc(scored).select((F.col("auc") > F.lit(Q.PLANTED_FLOOR)).alias("auc_above_floor"))
    n = scored.agg(F.count(F.lit(1)).alias("n_test"), F.lit(model.size).cast("bigint").alias("n_coefficients"))
    # two aggregates of one row each
    return n.join(auc, F.lit(True))


# ------------------------------- the joined customer row over bucketed tables
def bucketed_inputs(spark, d, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The customers, and the orders with their lines (an order without lines is one row), each
    bucketed and sorted by the customer key."""
    from ledgerline.sources.layout import bucketed

    orders, lines = Q._t(spark, d, "orders"), Q._t(spark, d, "lineitem")
    loans = orders.where("o_custkey is not null").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    customers = Q._t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return bucketed(customers, "c_custkey", buckets, "customers"), bucketed(loans, "o_custkey", buckets, "loan_lines")


def customer_row(customers: DataFrame, loan_lines: DataFrame) -> DataFrame:
    """The joined per-customer row from :func:`bucketed_inputs`. Orders are grouped by (customer,
    order) and customers by customer, both within the buckets, and the joins meet bucket by
    bucket: after the vocabularies no row moves."""
    rows = loan_lines.withColumns({
        "o_orderday": R.day_number("o_orderdate"), "l_shipday": R.day_number("l_shipdate"), "l_payment": F.col("l_extendedprice") * (1 - F.col("l_discount")),
    })
    lines = rows.where("l_orderkey is not null")
    vocab = encode.vocabularies(rows, ["o_orderpriority", "o_orderstatus"])
    vocab.update(encode.vocabularies(lines, [*Q.MONTH_CATS, "l_linenumber"]))
    shares, names = [], []
    for c in Q.MONTH_CATS:
        shares += share_columns(c, vocab[c], "", True)
        names += [f"{c}_{v}_MEAN" for v in vocab[c]] + [f"{c}_nan_MEAN"]
    months = ["l_shipday_MIN", "l_shipday_MAX", "l_shipday_SIZE", *names]
    loans = rows.groupBy("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderday").agg(
        F.count("l_orderkey").alias("_lines"), *Recipe({"l_shipday": ["min", "max", "size"]}).columns(), *shares
    )
    # an order without lines has no month features
    loans = loans.withColumns({c: F.when(F.col("_lines") > 0, C.named(c)) for c in months})
    per_loans = Q.customer_loans(loans, vocab, names)
    per_lines = Q.customer_lines(lines, vocab)
    out = grouped.attach(customers, per_loans, "c_custkey", "o_custkey")
    return grouped.attach(out, per_lines, "c_custkey", "o_custkey")


@register("customer_features_bucketed", Q._customer_features_sql())
def customer_features_bucketed(spark, d):
    """J1 / J2 over tables laid out by customer: the flagship's rows without an exchange."""
    return customer_row(*bucketed_inputs(spark, d, int(spark.conf.get("spark.sql.shuffle.partitions"))))
