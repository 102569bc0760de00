"""Cleaning job (F4) as a declarative plan over column-name patterns.

Steps, in the order the scripts apply them: drop named columns and name
patterns; replace a flag group by its sums (sub-group sums taken *before*
the listed flags are inverted, the group total *after*); same for a second
group (document flags); the "borrowed more than needed" difference and
flag; missing-value indicators; imputation steps (median / most frequent /
mean / constant, each with renames); label encoding; optional regression
imputation chain. Each step is a narrow projection, except the imputation
statistics and label vocabularies (small aggregates).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ledgerline.functions import rows as R
from ledgerline.functions.columns import matching
from ledgerline.operators import encode, impute
from ledgerline.session import cut_lineage


@dataclass
class FlagGroup:
    pattern: str                                   # columns forming the group (regex on names)
    sums: Mapping[str, str] = field(default_factory=dict)  # output → sub-pattern, before inversion
    invert: Sequence[str] = ()                     # flags turned around before the total
    total: str | None = None                       # output name of the group total


@dataclass
class ImputeStep:
    cols: Sequence[str]
    strategy: str
    rename: Mapping[str, str] = field(default_factory=dict)
    scales: Mapping[str, int] = field(default_factory=dict)
    fill_value: object = 0


@dataclass
class CleaningPlan:
    drop: Sequence[str] = ()
    drop_patterns: Sequence[str] = ()
    groups: Sequence[FlagGroup] = ()
    excess: tuple[str, str] | None = None          # (amount, need) → excess_amt, excess; both dropped
    indicators: Mapping[str, str] = field(default_factory=dict)  # output → column
    indicator_drop_pattern: str | None = None
    imputations: Sequence[ImputeStep] = ()
    label_encode: Sequence[str] = ()
    regressions: Sequence[tuple[str, Sequence[str], str]] = ()  # (target, predictors, output)


def clean(df: DataFrame, plan: CleaningPlan, materialize: bool = True) -> DataFrame:
    """Apply the plan. With ``materialize`` the narrow part is written once
    to the shared checkpoint folder before the statistics passes (medians,
    modes, vocabularies), so they re-read it instead of recomputing the
    input's upstream joins and aggregates each time."""
    out = df.drop(*plan.drop)
    for p in plan.drop_patterns:
        out = out.drop(*matching(out, p))
    for g in plan.groups:
        members = matching(out, g.pattern)
        new = {name: R.row_sum([c for c in members if re.search(sub, c)]) for name, sub in g.sums.items()}
        if g.total:
            new[g.total] = R.row_sum([R.invert_flag(c) if c in g.invert else c for c in members])
        out = out.withColumns(new).drop(*members)
    if plan.excess:
        amount, need = plan.excess
        diff = R.diff(amount, need)
        out = out.withColumns({"excess_amt": diff, "excess": R.positive(diff)}).drop(amount, need)
    if plan.indicators:
        out = out.withColumns({name: R.missing_indicator(c) for name, c in plan.indicators.items()})
    if plan.indicator_drop_pattern:
        out = out.drop(*matching(out, plan.indicator_drop_pattern))
    if materialize and (plan.imputations or plan.label_encode or plan.regressions):
        out = cut_lineage(out)
    steps = list(plan.imputations)
    touched = [c for st in steps for c in st.cols]
    if len(touched) == len(set(touched)):
        # disjoint steps: one statistics job per strategy, then the fills
        by_strategy: dict[str, list[str]] = {}
        scales: dict[str, int] = {}
        for st in steps:
            by_strategy.setdefault(st.strategy, []).extend(st.cols)
            scales.update(st.scales)
        stats: dict[str, object] = {}
        for strategy, cols in by_strategy.items():
            if strategy != "constant":
                stats.update(impute.statistics(out, cols, strategy, scales))
        for st in steps:
            values = {c: st.fill_value if st.strategy == "constant" else stats[c] for c in st.cols}
            out = impute.apply_fill(out, values, st.strategy, st.rename)
    else:
        for st in steps:
            out = impute.impute(out, st.cols, st.strategy, st.rename, st.scales, st.fill_value)
    if plan.label_encode:
        out = encode.label_encode(out, plan.label_encode)
    if plan.regressions:
        # the chain's fits read the filled and coded rows once
        out = impute.regression_chain(out, plan.regressions)
        out = out.drop(*[target for target, _, name in plan.regressions if name != target])
    return out
