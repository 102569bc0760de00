"""Scalar row expressions (X1-X17) with the missing-value rules of the
feature scripts: a comparison with a missing value is false and falls to
the ``else`` branch, zero denominators give a missing value, NaN never
appears. Every helper returns a built-in ``Column`` (whole-stage codegen,
no Python on the executors)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# The "not a date" marker in the DAYS_* columns.
DAYS_SENTINEL = 365243

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den``; a zero or missing denominator gives NULL (no ANSI error)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def diff(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``a - b`` (NULL when either side is missing)."""
    return _c(a) - _c(b)


def clamp_zero(x: ColumnOrName) -> Column:
    """``x if x > 0 else 0``; a missing value compares false and becomes 0."""
    return F.when(_c(x) > 0, _c(x)).otherwise(F.lit(0))


def flag_unless_equal(x: ColumnOrName, value) -> Column:
    """0 when ``x == value`` else 1 (missing → 1)."""
    return F.when(_c(x) == F.lit(value), F.lit(0)).otherwise(F.lit(1))


def flag_unless_negative(x: ColumnOrName) -> Column:
    """0 when ``x < 0`` else 1 (missing → 1)."""
    return F.when(_c(x) < 0, F.lit(0)).otherwise(F.lit(1))


def equal_flag(x: ColumnOrName, value) -> Column:
    """1 when ``x == value`` else 0 (missing → 0)."""
    return F.when(_c(x) == F.lit(value), F.lit(1)).otherwise(F.lit(0))


def positive(x: ColumnOrName) -> Column:
    """``x > 0`` as boolean, missing → false."""
    return F.coalesce(_c(x) > 0, F.lit(False))


def sentinel_to_null(x: ColumnOrName, sentinel=DAYS_SENTINEL) -> Column:
    """The sentinel value becomes NULL."""
    return F.nullif(_c(x), F.lit(sentinel))


def missing_indicator(x: ColumnOrName) -> Column:
    """1 when missing, else 0."""
    return _c(x).isNull().cast("int")


def row_sum(cols: Sequence[ColumnOrName]) -> Column:
    """Sum across columns skipping missing values (all missing → 0)."""
    return reduce(add, [F.coalesce(_c(c), F.lit(0)) for c in cols])


def invert_flag(x: ColumnOrName) -> Column:
    """X11: ``abs(x - 1)`` turns a 0/1 flag around."""
    return F.abs(_c(x) - 1)


def absolute(x: ColumnOrName) -> Column:
    """X12."""
    return F.abs(_c(x))


def fill_from(x: ColumnOrName, fallback: ColumnOrName) -> Column:
    """Keep ``x``; where it is missing take ``fallback``."""
    return F.coalesce(_c(x), _c(fallback))


def is_value(x: ColumnOrName, value) -> Column:
    """Equality filter predicate."""
    return _c(x) == F.lit(value)


def not_value_keep_missing(x: ColumnOrName, value) -> Column:
    """``x != value`` that keeps missing rows (pandas semantics)."""
    return ~_c(x).eqNullSafe(F.lit(value))


def is_missing(x: ColumnOrName) -> Column:
    """X16."""
    return _c(x).isNull()


def above_threshold(score: ColumnOrName, threshold) -> Column:
    """Strict ``score > t`` as 0/1."""
    return (_c(score) > F.lit(threshold)).cast("int")


def day_number(ts: ColumnOrName, origin: str = "1970-01-01") -> Column:
    """Signed whole days from ``origin`` (the integer day axis the feature
    recipes use for dates)."""
    return F.datediff(_c(ts).cast("date"), F.lit(origin).cast("date"))
