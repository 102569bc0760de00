"""Scans and sources.

Readers return lazy DataFrames: column pruning and filter pushdown reach the
parquet scan because nothing here materialises data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ledgerline.functions.columns import named

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder (``{base_dir}/{name}.parquet``), NaN read as missing."""
    return nan_to_null(spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """CSV scan with a declared schema (S1), in one pass; :func:`read_csv_inferred`
    finds the types in a pass of its own."""
    df = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)
    return nan_to_null(df)


# The texts that the scripts' reader takes for a missing value
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)
# Its texts of the two booleans
TRUE_TEXTS, FALSE_TEXTS = ("True", "TRUE", "true"), ("False", "FALSE", "false")
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
REJECTED = "_rejected"


def _as_type(text: Column, kind: str) -> Column:
    """The value of a present text under a type, or NULL where it is not of that type."""
    if kind == "boolean":
        return F.when(text.isin(*TRUE_TEXTS), F.lit(True)).when(text.isin(*FALSE_TEXTS), F.lit(False))
    if kind == "bigint":
        return F.when(text.rlike(_WHOLE), F.trim(text).try_cast("bigint"))
    if kind == "double":
        return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return text


def infer_types(texts: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """The narrowest type (boolean, bigint, double, string) that holds every present text of
    each column: one aggregate over the rows with three counters per column. A column without
    any present text is a string."""
    counts = []
    for i, c in enumerate(cols):
        x = named(c)
        counts.append(F.count(x).alias(f"n{i}"))
        counts += [F.count(_as_type(x, k)).alias(f"{k}{i}") for k in ("boolean", "bigint", "double")]
    row = texts.agg(*counts).first()
    return {
        c: next((k for k in ("boolean", "bigint", "double") if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]), "string")
        for i, c in enumerate(cols)
    }


def read_csv_inferred(spark: SparkSession, path: str | Sequence[str], header: bool = True, keep_rejected: bool = True) -> DataFrame:
    """CSV scan without declared types (S1): column names from the header, types from all rows.

    Rows are split once as texts; missing texts (:data:`MISSING_TEXTS`) become NULL; one
    distributed aggregate finds each column's type (:func:`infer_types`), and the result is a lazy
    scan that casts. A row with more or fewer fields than the header keeps its text in
    ``_rejected`` and takes no part in the types; its columns are NULL. ``keep_rejected=False``
    leaves such rows and the column out. Whole numbers stay whole next to missing ones, and a
    number beyond 64 bits makes its column double."""
    paths = [path] if isinstance(path, str) else list(path)
    names = spark.read.option("header", header).csv(paths).columns
    fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    raw = (
        spark.read.schema(f"{fields}, `{REJECTED}` string").option("header", header).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", REJECTED)
        # rows are split whole: with pruning a row's number of fields would not be looked at
        .option("columnPruning", False).option("enforceSchema", True).csv(paths)
    )
    # always true for the first column; the scan wants one beside the rejected text
    good = F.col(REJECTED).isNull() & F.coalesce(F.length(named(names[0])) >= 0, F.lit(True))
    texts = raw.select(*[F.when(good & ~named(c).isin(*MISSING_TEXTS), named(c)).alias(c) for c in names], REJECTED)
    types = infer_types(texts, names)
    typed = texts.select(*[_as_type(named(c), types[c]).alias(c) for c in names], REJECTED)
    return typed if keep_rejected else typed.where(good).drop(REJECTED)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Map floating NaN to NULL so one missing marker remains (pandas treats
    both alike; Spark orders NaN above every number and averages it)."""
    fixes = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (DoubleType, FloatType))
    }
    return df.withColumns(fixes) if fixes else df


def first_rows(df: DataFrame, n: int | None, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows (S2, S5). ``n=None`` keeps everything.

    With ``order_by`` the result is repeatable (TakeOrderedAndProject, a
    bounded top-n per partition); without it Spark returns any ``n`` rows.
    """
    if n is None:
        return df
    if order_by:
        return df.orderBy(*order_by).limit(n)
    return df.limit(n)


def stack_rows(labelled: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """Append rows whose columns differ (S3, U2): missing columns become NULL."""
    return labelled.unionByName(unlabelled, allowMissingColumns=True)


def stack_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Vertical concatenation by name."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns) (S4): one distributed count."""
    return df.count(), len(df.columns)
