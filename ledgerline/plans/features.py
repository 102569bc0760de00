"""Composite per-customer feature jobs.

Each job is DataFrame → DataFrame and takes column *roles* (key, order,
categories, measures) as arguments, so the same job runs on loan tables and
on any other table with that shape. Every job is planned as one grouped
aggregate per grain (plus the joins the grain change needs).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import rows as R
from ledgerline.functions.columns import named
from ledgerline.functions.aggs import Recipe, presence_count, share_columns, upper_name
from ledgerline.operators import encode, grouped, history

# The aggregates of the previous-application recipe (F1) and
# its naming template "{keys}_{agg}_{column}".
RECIPE_AGGREGATES = ["mean", "min", "max", "sum", "var"]

# Output column names of the history and instalment features
# (F2, F3, F9), as the feature tables spell them.
PREV_COUNT = "previous_application_number_of_prev_application"
PREV_APPROVED = "previous_application_prev_was_approved"
PREV_REFUSED = "previous_application_prev_was_refused"
NUM_LOAN = "num_loan"
NUM_LOANTYPE = "num_loantype"
AVE_LOANTYPE = "ave_loantype"
PER_ACTIVE = "per_active"
ENDDATE_SHARE = "CREDIT_ENDDATE_PERCENTAGE"
PAYMENT_PERC = "PAYMENT_PERC"
PAYMENT_DIFF = "PAYMENT_DIFF"
DAYS_PAST_DUE = "DPD"
DAYS_BEFORE_DUE = "DBD"


def recipe_features(
    detail: DataFrame,
    key: str,
    measures: Sequence[str],
    aggregates: Sequence[str] = RECIPE_AGGREGATES,
    scales: Mapping[str, int] | None = None,
) -> DataFrame:
    """F1 (A4): every measure × every aggregate, named ``{key}_{agg}_{col}``,
    in one aggregate instead of one group-by and join per column."""
    spec = {m: list(aggregates) for m in measures}
    recipe = Recipe(spec, scales=scales or {}, name=lambda col, agg: f"{key}_{agg}_{col}")
    return grouped.group_features(detail, key, [recipe])


def category_shares(
    df: DataFrame,
    cats: Sequence[str],
    prefix: str,
    with_missing: bool,
    vocab: Mapping[str, Sequence] | None = None,
) -> list[Column]:
    vocab = vocab if vocab is not None else encode.vocabularies(df, cats)
    out: list[Column] = []
    for c in cats:
        out += share_columns(c, vocab[c], prefix, with_missing)
    return out


def previous_features(
    prev: DataFrame,
    key: str,
    num_spec: Mapping[str, Sequence[str]],
    cats: Sequence[str],
    status_col: str,
    families: Mapping[str, str],
    scales: Mapping[str, int] | None = None,
    prefix: str = "PREV_",
    with_missing: bool = True,
    vocab: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """numeric recipe + category shares for all rows, and the numeric
    recipe again per status family (``{"APPROVED_": "Approved", ...}``) —
    one grouped aggregate, one shuffle."""
    fam = {p: R.is_value(status_col, v) for p, v in families.items()}
    recipe = Recipe(num_spec, prefix=prefix, scales=scales or {}, families=fam)
    shares = category_shares(prev, cats, prefix, with_missing, vocab)
    return grouped.group_features(prev, key, [recipe], shares)


def counted_features(
    df: DataFrame,
    key: str,
    num_spec: Mapping[str, Sequence[str]],
    cats: Sequence[str],
    prefix: str,
    count_name: str,
    scales: Mapping[str, int] | None = None,
    with_missing: bool = True,
    vocab: Mapping[str, Sequence] | None = None,
    nunique_vocab: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """F8/F9 shape: recipe + category shares + row count ``{PREFIX}COUNT``.
    ``nunique_vocab`` gives bounded vocabularies for distinct counts, which
    then stay in the single aggregate (presence counts)."""
    recipe = Recipe(num_spec, prefix=prefix, scales=scales or {}, vocab=nunique_vocab or {})
    extra = category_shares(df, cats, prefix, with_missing, vocab) + [F.count(F.lit(1)).alias(count_name)]
    return grouped.group_features(df, key, [recipe], extra)


def instalment_rows(
    df: DataFrame,
    instalment: str,
    payment: str,
    due_day: str,
    paid_day: str,
) -> DataFrame:
    """F9 row features: paid share and gap, days past / before due clamped at 0."""
    return df.withColumns(
        {
            PAYMENT_PERC: R.ratio(payment, instalment),
            PAYMENT_DIFF: R.diff(instalment, payment),
            DAYS_PAST_DUE: R.clamp_zero(R.diff(paid_day, due_day)),
            DAYS_BEFORE_DUE: R.clamp_zero(R.diff(due_day, paid_day)),
        }
    )


def all_column_features(
    df: DataFrame,
    key: str,
    drop: Sequence[str],
    prefix: str,
    count_name: str,
    aggregates: Sequence[str] = ("min", "max", "mean", "sum", "var"),
    scales: Mapping[str, int] | None = None,
    cats: Sequence[str] = (),
    with_missing: bool = True,
    vocab: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """F10 (A6): every remaining column (one-hot columns included) × the
    five aggregates, plus the row count."""
    onehot_vocab = vocab if vocab is not None else encode.vocabularies(df, cats)
    body, onehot_cols = encode.one_hot(df.drop(*drop), {c: onehot_vocab[c] for c in cats}, with_missing)
    cols = [c for c in body.columns if c != key]
    recipe = Recipe({c: list(aggregates) for c in cols}, prefix=prefix, scales=scales or {}, flags=onehot_cols)
    return grouped.group_features(body, key, [recipe], [F.count(F.lit(1)).alias(count_name)])


def bureau_features(
    loans: DataFrame,
    loan_key: str,
    key: str,
    months: DataFrame,
    month_loan_key: str,
    month_col: str,
    month_cats: Sequence[str],
    loan_num_spec: Mapping[str, Sequence[str]],
    loan_cats: Sequence[str],
    active_col: str,
    active_value: str,
    closed_value: str,
    scales: Mapping[str, int] | None = None,
    with_missing: bool = True,
    vocab: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """F6 (A10 + A11): months → loan (min, max, size of the month offset and
    month-status shares), joined to the loans; loans → customer with the
    numeric recipe (``BURO_``), the loan-category shares, the mean of the
    month-status shares, and the numeric recipe again for active and closed
    loans — two shuffles in all (by loan, then by customer)."""
    vocab = dict(vocab) if vocab is not None else {}
    missing = [c for c in list(month_cats) if c not in vocab]
    vocab.update(encode.vocabularies(months, missing))
    missing = [c for c in list(loan_cats) if c not in vocab]
    vocab.update(encode.vocabularies(loans, missing))

    month_recipe = Recipe({month_col: ["min", "max", "size"]})
    month_shares: list[Column] = []
    share_names: list[str] = []
    for c in month_cats:
        cols = share_columns(c, vocab[c], "", with_missing)
        month_shares += cols
        share_names += [f"{c}_{v}_MEAN" for v in vocab[c]] + ([f"{c}_nan_MEAN"] if with_missing else [])

    per_loan_spec = dict(loan_num_spec)
    per_loan_spec.update(
        {f"{month_col}_MIN": ["min"], f"{month_col}_MAX": ["max"], f"{month_col}_SIZE": ["mean", "sum"]}
    )
    fam = {
        "ACTIVE_": R.is_value(active_col, active_value),
        "CLOSED_": R.is_value(active_col, closed_value),
    }
    loan_recipe = Recipe(per_loan_spec, prefix="BURO_", scales=scales or {}, families=fam)
    second_extra = category_shares(loans, loan_cats, "BURO_", with_missing, vocab)
    second_extra += [F.avg(named(n)).alias(f"BURO_{n}_MEAN") for n in share_names]
    return grouped.two_level(
        months, month_loan_key, [month_recipe], loans, loan_key, key, [loan_recipe],
        first_extra=month_shares, second_extra=second_extra,
    )


def application_features(
    train: DataFrame,
    test: DataFrame,
    gender_col: str,
    binary_cols: Sequence[str],
    order: Sequence[Column],
    cats: Sequence[str],
    ratios: Mapping[str, tuple[str, str]],
    sentinel_cols: Sequence[str] = (),
    with_missing: bool = False,
    vocab: Mapping[str, Sequence] | None = None,
    excluded: str = "XNA",
) -> DataFrame:
    """stack labelled and unlabelled rows, drop the ``XNA`` gender rows
    (keeping missing ones), factorise the binary columns, one-hot the
    categories, clear the day sentinel, add the ratio columns. Narrow
    transformations only — no shuffle besides the small vocabulary jobs."""
    from ledgerline.sources import stack_rows

    df = stack_rows(train, test).where(R.not_value_keep_missing(gender_col, excluded))
    df = encode.factorize(df, binary_cols, order)
    vocab = vocab if vocab is not None else encode.vocabularies(df, cats)
    df, _ = encode.one_hot(df, {c: vocab[c] for c in cats}, with_missing)
    df = df.withColumns({c: R.sentinel_to_null(c) for c in sentinel_cols})
    return df.withColumns({name: R.ratio(a, b) for name, (a, b) in ratios.items()})


def behaviour_features(
    prev: DataFrame,
    key: str,
    id_col: str,
    time_col: str,
    status_col: str,
    approved: str,
    refused: str,
    last_n_measures: Mapping[str, str],
    ns: Sequence[int] = (1, 3, 5),
    scales: Mapping[str, int] | None = None,
    salt_buckets: int | None = None,
) -> DataFrame:
    """number of previous ids, was the latest one approved / refused,
    means of the measures over the last 1/3/5 rows per customer."""
    # id count and the latest row's flags: one aggregate over all rows
    order = F.struct(
        F.col(time_col).isNull().alias("t_missing"), F.col(time_col).alias("t"), F.col(id_col).alias("id")
    )
    counts = grouped.group_features(
        prev, key, [],
        [
            F.max_by(R.equal_flag(status_col, approved), order).alias(PREV_APPROVED),
            F.max_by(R.equal_flag(status_col, refused), order).alias(PREV_REFUSED),
        ],
        distinct=[F.count_distinct(id_col).alias(PREV_COUNT)],
    )
    tails = history.last_n_means(prev, key, time_col, id_col, last_n_measures, ns, scales, salt_buckets)
    return counts.join(tails, key, "left")


def loan_history(
    base: DataFrame,
    base_key: str,
    loans: DataFrame,
    key: str,
    count_col: str,
    type_col: str,
    active_col: str,
    closed_value: str,
    end_day_col: str,
    type_vocab: Sequence | None = None,
) -> tuple[DataFrame, DataFrame]:
    """per customer ``num_loan``, ``num_loantype``, ``ave_loantype``
    attached to the base rows; and the loan rows enriched with the
    customer's share of not-closed loans (``per_active``) and of loans
    whose end day is not in the past (``CREDIT_ENDDATE_PERCENTAGE``)."""
    shares = [
        F.count(count_col).alias(NUM_LOAN),
        F.try_divide(F.sum(R.flag_unless_equal(active_col, closed_value)).cast("double"), F.count(F.lit(1))).alias(PER_ACTIVE),
        F.try_divide(F.sum(R.flag_unless_negative(end_day_col)).cast("double"), F.count(F.lit(1))).alias(ENDDATE_SHARE),
    ]
    if type_vocab is None:
        distinct_types = F.count_distinct(type_col).alias(NUM_LOANTYPE)
        per_customer = grouped.group_features(loans, key, [], shares, distinct=[distinct_types])
    else:
        # a bounded type vocabulary: a presence count inside the one aggregate
        present_types = presence_count(F.col(type_col), type_vocab).alias(NUM_LOANTYPE)
        per_customer = grouped.group_features(loans, key, [], [present_types, *shares])
    counts = per_customer.select(
        key, NUM_LOAN, NUM_LOANTYPE, R.ratio(NUM_LOAN, NUM_LOANTYPE).alias(AVE_LOANTYPE)
    )
    enriched_base = grouped.attach(base, counts, base_key, key)
    enriched_loans = loans.join(per_customer.select(key, PER_ACTIVE, ENDDATE_SHARE), key, "left")
    return enriched_base, enriched_loans


__all__ = [
    "recipe_features", "previous_features", "counted_features", "instalment_rows",
    "all_column_features", "bureau_features", "application_features", "behaviour_features",
    "loan_history", "upper_name",
]
