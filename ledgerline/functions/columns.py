"""Name- and type-driven column selection (P4-P12). These work on the schema
only (driver-side metadata, no data is read)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has (generated names carry
    category values, and these may hold dots)."""
    return F.col("`" + name.replace("`", "``") + "`")


def matching(df: DataFrame, pattern: str) -> list[str]:
    """P5: columns whose name contains a regex match (pandas ``filter(regex=)``)."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c)]


def containing(df: DataFrame, text: str) -> list[str]:
    """Columns whose name contains ``text``."""
    return [c for c in df.columns if text in c]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """The categorical (string) columns."""
    return [c for c, t in df.dtypes if t == "string" and c not in exclude]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        c for c, t in df.dtypes
        if (t in NUMERIC_TYPES or t.startswith("decimal") or t == "boolean") and c not in exclude
    ]


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """P5 drop form."""
    return df.drop(*matching(df, pattern))


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename every column by position."""
    return df.toDF(*names)
