"""DuckDB text for the oracle side of the catalog.

Written independently of the Spark expressions (plain SQL aggregates, CASE
for families), using the same *numeric contract*: fixed-point columns are
summed as decimals and their variance is taken from exact integer units, so
both engines produce the same doubles bit for bit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def agg(x: str, a: str, scale: int | None = None) -> str:
    if a == "mean":
        if scale is None:
            return f"AVG({x})"
        return f"CAST(SUM(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE) / NULLIF(COUNT({x}), 0)"
    if a in ("min", "max"):
        return f"{a.upper()}({x})"
    if a == "sum":
        if scale is None:
            return f"COALESCE(SUM({x}), 0)"
        s = f"CAST(SUM(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE)"
        if scale == 0:
            s = f"CAST(SUM(CAST({x} AS DECIMAL(18,0))) AS BIGINT)"
        return f"COALESCE({s}, 0)"
    if a == "var":
        if scale is None:
            return f"VAR_SAMP({x})"
        u = f"CAST(CAST({x} AS DECIMAL(18,{scale})) * {10 ** scale} AS HUGEINT)"
        n = f"COUNT({x})"
        return (
            f"CASE WHEN {n} > 1 THEN CAST({n} * SUM({u} * {u}) - SUM({u}) * SUM({u}) AS DOUBLE)"
            f" / CAST(CAST({n} AS HUGEINT) * ({n} - 1) * {10 ** (2 * scale)} AS DOUBLE) END"
        )
    if a == "size":
        return "COUNT(*)"
    if a == "count":
        return f"COUNT({x})"
    if a == "nunique":
        return f"COUNT(DISTINCT {x})"
    raise ValueError(a)


def recipe(
    spec: Mapping[str, Sequence[str]],
    name,
    scales: Mapping[str, int] | None = None,
    where: str | None = None,
    exprs: Mapping[str, str] | None = None,
) -> list[str]:
    """``agg(...) AS name`` items; ``where`` makes a family (NULL when the
    key has no row of the family); ``exprs`` gives SQL for derived columns."""
    scales = scales or {}
    exprs = exprs or {}
    out = []
    for col, aggs in spec.items():
        x = exprs.get(col, q(col))
        for a in aggs:
            if where is None:
                e = agg(x, a, scales.get(col))
            else:
                if a == "size":
                    inner = f"COUNT(*) FILTER (WHERE {where})"
                else:
                    inner = agg(f"(CASE WHEN {where} THEN {x} END)", a, scales.get(col))
                e = f"CASE WHEN COUNT(*) FILTER (WHERE {where}) > 0 THEN {inner} END"
            out.append(f"{e} AS {q(name(col, a))}")
    return out


def upper(prefix: str):
    return lambda col, a: f"{prefix}{col}_{a.upper()}"


def shares(col: str, values: Sequence, prefix: str = "", with_missing: bool = True, suffix: str = "_MEAN", x: str | None = None) -> list[str]:
    x = x or q(col)
    out = [
        f"CAST(SUM(CASE WHEN {x} = {lit(v)} THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS {q(f'{prefix}{col}_{v}{suffix}')}"
        for v in values
    ]
    if with_missing:
        out.append(f"CAST(SUM(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS {q(f'{prefix}{col}_nan{suffix}')}")
    return out


def day_number(ts: str) -> str:
    return f"CAST(date_diff('day', DATE '1970-01-01', CAST({ts} AS DATE)) AS INTEGER)"


def _dbl(x: str) -> str:
    # DuckDB's HUGEINT → DOUBLE cast is not correctly rounded above 2^63;
    # the decimal text parse is.
    return f"CAST(CAST({x} AS VARCHAR) AS DOUBLE)"


def comoments(x: str, y: str, sx: int, sy: int) -> tuple[str, str, str, str]:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    u = f"(CASE WHEN {both} THEN CAST(CAST({x} AS DECIMAL(18,{sx})) * {10 ** sx} AS HUGEINT) END)"
    v = f"(CASE WHEN {both} THEN CAST(CAST({y} AS DECIMAL(18,{sy})) * {10 ** sy} AS HUGEINT) END)"
    n = f"COUNT({u})"
    cxy = f"({n} * SUM({u} * {v}) - SUM({u}) * SUM({v}))"
    cxx = f"({n} * SUM({u} * {u}) - SUM({u}) * SUM({u}))"
    cyy = f"({n} * SUM({v} * {v}) - SUM({v}) * SUM({v}))"
    return n, cxy, cxx, cyy


def covar(x: str, y: str, sx: int, sy: int) -> str:
    n, cxy, _, _ = comoments(x, y, sx, sy)
    return f"CASE WHEN {n} > 1 THEN {_dbl(cxy)} / CAST({n} * ({n} - 1) * {10 ** (sx + sy)} AS DOUBLE) END"


def corr(x: str, y: str, sx: int, sy: int) -> str:
    _, cxy, cxx, cyy = comoments(x, y, sx, sy)
    den = f"sqrt({_dbl(cxx)} * {_dbl(cyy)})"
    return f"CASE WHEN {den} = 0 THEN NULL ELSE {_dbl(cxy)} / {den} END"


def report(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"
