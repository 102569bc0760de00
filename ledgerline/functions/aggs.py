"""Aggregate recipes → Spark aggregate ``Column`` lists.

A recipe is ``{column: [aggregate, ...]}``. It expands into aggregate
expressions for a *single* ``groupBy(key).agg(...)``: the per-column
group-by/join chains and the filter + group + join per family of the
feature scripts all collapse into one hash aggregate with map-side partial
aggregation, i.e. one shuffle on the key.

Semantics follow the feature scripts (pandas):

* ``sum`` of a group whose values are all missing is 0; a *family* that has
  no row for the key is missing (that is what the left join gave);
* ``var`` is the sample variance (n-1); one value gives NULL;
* missing values are skipped by every aggregate; ``size`` counts rows.

``scales`` marks fixed-point columns (money with 2 decimals, whole days with
0). Their ``sum``/``mean``/``var`` accumulate exactly — decimal sums and an
integer-unit variance — so the result does not depend on how the rows were
partitioned, which plain floating sums do.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.columns import named

AGGREGATES = ("mean", "min", "max", "sum", "var", "size", "count", "nunique", "nunique_approx")

NameFn = Callable[[str, str], str]


def upper_name(prefix: str) -> NameFn:
    """P3 naming: ``PREFIX + column + '_' + AGG``."""
    return lambda col, agg: f"{prefix}{col}_{agg.upper()}"


def _col(c: str | Column) -> Column:
    return named(c) if isinstance(c, str) else c


def units(x: Column, scale: int) -> Column:
    """A fixed-point value as whole units of 10^-scale (``bigint``): the
    double nearest a decimal with ``scale`` places times 10^scale is within
    far less than ½ of that integer, so ``rint`` recovers it exactly. Cheap
    (no decimal objects) and order-independent to sum."""
    return F.rint(x * F.lit(float(10 ** scale))).cast("bigint")


def _from_units(total: Column, scale: int) -> Column:
    return total.cast("double") / F.lit(float(10 ** scale))


def exact_sum(x: Column, scale: int) -> Column:
    """Exact sum of a fixed-point column, returned as double (overflow of
    the 64-bit unit sum raises under ANSI mode; it never wraps)."""
    return _from_units(F.sum(units(x, scale)), scale)


def exact_mean(x: Column, scale: int) -> Column:
    return F.try_divide(exact_sum(x, scale), F.count(x))


def _wide(u: Column) -> Column:
    return u.cast("decimal(38,0)")


def _power(digits: int) -> Column:
    return F.lit(10 ** digits).cast("decimal(20,0)")


def _product(u: Column, v: Column) -> Column:
    """Exact u·v as a 38-digit decimal: the 64-bit product when it fits
    (``try_multiply``), the decimal product only on overflow."""
    return F.coalesce(F.try_multiply(u, v).cast("decimal(38,0)"), _wide(u) * _wide(v))


def exact_var(x: Column, scale: int, flag: bool = False) -> Column:
    """Sample variance from integer units: (n·Σu² − (Σu)²) / (n(n−1)) / 10^(2s).

    Σu² and the numerator are exact 38-digit decimals; the numerator is
    rounded once to double and divided once (within 2 ulp of the exact
    value, and the same double in any engine that follows these steps).
    """
    u = units(x, scale)
    n = F.count(x)
    s1 = _wide(F.sum(u))
    # a 0/1 flag has u² = u: its square sum is the plain 64-bit sum
    s2 = s1 if flag else F.sum(_product(u, u))
    num = (_wide(n) * s2 - s1 * s1).cast("double")
    # 38 digits: n(n-1) with the scale leaves 64 bits at a few hundred thousand rows
    den = (_wide(n) * _wide(n - 1) * _power(2 * scale)).cast("double")
    return F.when(n > 1, num / den)


def exact_comoments(x: Column, y: Column, sx: int, sy: int) -> tuple[Column, Column, Column, Column]:
    """Exact co-moment numerators over pairwise-complete rows, in integer
    units: (n, n·Σxy − ΣxΣy, n·Σx² − (Σx)², n·Σy² − (Σy)²). Exact until
    cast; requires n·Σ|xy| < 10^38 (ANSI mode raises instead of wrapping)."""
    both = x.isNotNull() & y.isNotNull()
    u = F.when(both, units(x, sx))
    v = F.when(both, units(y, sy))
    n = F.count(u)
    su, sv = _wide(F.sum(u)), _wide(F.sum(v))
    cxy = _wide(n) * F.sum(_product(u, v)) - su * sv
    cxx = _wide(n) * F.sum(_product(u, u)) - su * su
    cyy = _wide(n) * F.sum(_product(v, v)) - sv * sv
    return n, cxy, cxx, cyy


def exact_covar(x: Column, y: Column, sx: int, sy: int) -> Column:
    """Sample covariance of two fixed-point columns: exact numerator, one
    conversion and one division."""
    n, cxy, _, _ = exact_comoments(x, y, sx, sy)
    den = (_wide(n) * _wide(n - 1) * _power(sx + sy)).cast("double")
    return F.when(n > 1, cxy.cast("double") / den)


def exact_corr(x: Column, y: Column, sx: int, sy: int) -> Column:
    """Pearson correlation of two fixed-point columns from exact co-moments;
    NULL for a constant column."""
    _, cxy, cxx, cyy = exact_comoments(x, y, sx, sy)
    return F.try_divide(cxy.cast("double"), F.sqrt(cxx.cast("double") * cyy.cast("double")))


def presence_count(x: Column, values: Sequence) -> Column:
    """Distinct count of a column with a known, bounded vocabulary, as plain
    aggregates: the number of vocabulary values present in the group
    (Σ_v max(x = v)). Stays in the one wide aggregate, unlike
    ``count(DISTINCT x)``, which sends every other buffer through an extra
    shuffle keyed by (key, x). Missing values are not counted."""
    xs = x.cast("string")
    terms = [F.max(F.when(xs == F.lit(str(v)), 1).otherwise(0)) for v in values]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total.cast("bigint") if terms else F.lit(0).cast("bigint")


def one_aggregate(x: Column, agg: str, scale: int | None = None, flag: bool = False) -> Column:
    """One aggregate over the rows of a group (no family filter). ``flag``
    marks a 0/1 indicator column (exact variance without a square sum)."""
    if agg == "mean":
        return exact_mean(x, scale) if scale is not None else F.avg(x)
    if agg == "min":
        return F.min(x)
    if agg == "max":
        return F.max(x)
    if agg == "sum":
        if scale == 0:
            s = F.sum(units(x, 0))
        elif scale is not None:
            s = exact_sum(x, scale)
        else:
            s = F.sum(x)
        return F.coalesce(s, F.lit(0))
    if agg == "var":
        if flag:
            return exact_var(x, 0, flag=True)
        return exact_var(x, scale) if scale is not None else F.var_samp(x)
    if agg == "size":
        return F.count(F.lit(1))
    if agg == "count":
        return F.count(x)
    if agg == "nunique":
        return F.count_distinct(x)
    if agg == "nunique_approx":
        # HyperLogLog++ sketch (fixed-size buffer, no distinct shuffle), ~5 % error
        return F.approx_count_distinct(x)
    raise ValueError(f"unknown aggregate {agg!r}; known: {AGGREGATES}")


@dataclass
class Recipe:
    """A named set of aggregates over one grouping key.

    ``families`` adds the *numeric* recipe again for each row family
    (``{"ACTIVE_": predicate}``), computed in the same aggregate with
    ``when(predicate, x)`` instead of a filtered group-by plus a join.
    """

    spec: Mapping[str, Sequence[str]]
    prefix: str = ""
    scales: Mapping[str, int] = field(default_factory=dict)
    families: Mapping[str, Column] = field(default_factory=dict)
    name: NameFn | None = None
    flags: Collection[str] = ()  # 0/1 indicator columns (e.g. one-hot)
    vocab: Mapping[str, Sequence] = field(default_factory=dict)  # bounded vocabularies: nunique as presence counts

    def columns(self, select: str = "all") -> list[Column]:
        """Aggregate columns; ``select`` = ``"plain"`` / ``"distinct"`` keeps
        only the non-distinct / distinct-count ones (``"all"``: both, in order)."""
        out = aggregate_columns(self.spec, self.name or upper_name(self.prefix), self.scales, flags=self.flags,
                                select=select, vocab=self.vocab)
        for fam_prefix, pred in self.families.items():
            out += aggregate_columns(self.spec, upper_name(fam_prefix), self.scales, where=pred, flags=self.flags,
                                     select=select, vocab=self.vocab)
        return out


def aggregate_columns(
    spec: Mapping[str, Sequence[str]],
    name: NameFn,
    scales: Mapping[str, int] | None = None,
    where: Column | None = None,
    flags: Collection[str] = (),
    select: str = "all",
    vocab: Mapping[str, Sequence] | None = None,
) -> list[Column]:
    """Expand a recipe; with ``where`` every aggregate sees only the rows of
    that family, and keys without such rows get NULL (left-join semantics)."""
    scales = scales or {}
    out: list[Column] = []
    for col, aggs in spec.items():
        x = _col(col)
        scale = scales.get(col)
        flag = col in flags
        known = vocab is not None and col in vocab
        for agg in aggs:
            is_distinct = agg == "nunique" and not known
            if (select == "plain" and is_distinct) or (select == "distinct" and not is_distinct):
                continue
            if agg == "nunique" and known:
                fx = x if where is None else F.when(where, x)
                expr = presence_count(fx, vocab[col])
                if where is not None:
                    expr = F.when(F.count_if(F.coalesce(where, F.lit(False))) > 0, expr)
            elif where is None:
                expr = one_aggregate(x, agg, scale, flag)
            else:
                fx = F.when(where, x)
                present = F.count_if(F.coalesce(where, F.lit(False))) > 0
                if agg == "size":
                    inner = F.count_if(F.coalesce(where, F.lit(False)))
                else:
                    inner = one_aggregate(fx, agg, scale, flag)
                expr = F.when(present, inner)
            out.append(expr.alias(name(col, agg)))
    return out


def share_columns(
    col: str,
    values: Sequence,
    prefix: str = "",
    with_missing: bool = True,
    suffix: str = "_MEAN",
    name_col: str | None = None,
) -> list[Column]:
    """Per-key share of every category value — the mean of its one-hot
    column, fused into the aggregate (no wide one-hot intermediate).

    Computed as count / rows so the ratio is an exact double division.
    """
    base = name_col or col
    x = named(col)
    rows = F.count(F.lit(1))
    out = [
        (F.sum(F.when(x == F.lit(v), 1).otherwise(0)).cast("double") / rows).alias(f"{prefix}{base}_{v}{suffix}")
        for v in values
    ]
    if with_missing:
        out.append((F.sum(x.isNull().cast("int")).cast("double") / rows).alias(f"{prefix}{base}_nan{suffix}"))
    return out
