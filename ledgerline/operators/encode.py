"""Category encodings.

Codes (E3, E4) are a table: distinct values are ranked on the executors and
left-joined to the rows, so a column may have any number of values; Spark
broadcasts the table when it is below the session's threshold.

One-hot columns (E1, E2) and wide shares have one output column per value, so
their vocabulary is part of the plan: the caller passes it, or it is taken from
the data by one distributed ``distinct``. For columns with many values,
:func:`long_shares` gives (key, column, value, share) rows instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import named
from ledgerline.operators.ranking import global_rank
from ledgerline.session import cores, cut_lineage, release


class VocabularyTooLarge(ValueError):
    pass


#: output columns that one categorical column may become, unless the caller states another bound
MAX_VALUES = 10_000


def vocabularies(df: DataFrame, cols: Sequence[str], max_values: int = MAX_VALUES) -> dict[str, list]:
    """Vocabularies of several columns in one job: a long-form (column, value) distinct.

    The values become columns of the plan, so their number is bounded: a column of more than
    ``max_values`` is an error before any value reaches the driver. Such columns have other
    forms without a bound: :func:`long_shares`, :func:`sparse_one_hot` and the codes."""
    if not cols:
        return {}
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), named(c).cast("string").alias("v")) for c in cols])).alias("p")
    ).select("p.c", "p.v").where(F.col("v").isNotNull()).distinct()
    # the distinct pairs are read twice (sizes, then values): write them once
    # instead of scanning the source twice
    from ledgerline.session import cut_lineage

    pairs = cut_lineage(pairs)
    # sizes first (one row per column), values only once every size is checked
    sizes = {r["c"]: r["n"] for r in pairs.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    too_big = [c for c, n in sizes.items() if n > max_values]
    if too_big:
        raise VocabularyTooLarge(f"{too_big} have more than {max_values} distinct values: use long_shares or sparse_one_hot")
    got: dict[str, list] = {c: [] for c in cols}
    for r in pairs.collect():
        got[r["c"]].append(r["v"])
    for c in cols:
        got[c].sort()
    return got


def one_hot_columns(col: str, values: Sequence, with_missing: bool) -> dict[str, Column]:
    x = named(col)
    out = {f"{col}_{v}": F.when(x == F.lit(v), 1).otherwise(0) for v in values}
    if with_missing:
        out[f"{col}_nan"] = x.isNull().cast("int")
    return out


def one_hot(
    df: DataFrame,
    vocab: Mapping[str, Sequence],
    with_missing: bool = True,
) -> tuple[DataFrame, list[str]]:
    """Replace each categorical column by 0/1 columns ``col_value``
    (plus ``col_nan`` when ``with_missing``); returns the new names too.
    A missing value gives a row of zeros when ``with_missing`` is off."""
    new: dict[str, Column] = {}
    for col, values in vocab.items():
        new.update(one_hot_columns(col, values, with_missing))
    return df.withColumns(new).drop(*vocab.keys()), list(new)


def _coded(df: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    """``df`` with ``col`` replaced by its code (table ``_value``, ``_code``), missing where it has none."""
    joined = df.join(codes, named(col) == F.col("_value"), "left")
    return joined.select(*[F.col("_code").cast("int").alias(c) if c == col else named(c) for c in df.columns])


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Integer codes by sorted value (0..k-1); missing stays missing."""
    out = df
    for c in cols:
        values = df.select(named(c).alias("_value")).where(F.col("_value").isNotNull()).distinct()
        out = _coded(out, c, global_rank(values, ["_value"], "_code"))
    return out


def factorize(df: DataFrame, cols: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Integer codes in order of first appearance under ``order``
    (a total row order must be given: Spark rows have none); missing → -1."""
    first = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])
    out = df
    for c in cols:
        firsts = df.where(named(c).isNotNull()).groupBy(named(c).alias("_value")).agg(F.min(first).alias("_first"))
        codes = global_rank(firsts, [F.col(f"_first.k{i}") for i in range(len(order))], "_code").drop("_first")
        out = _coded(out, c, codes)
    return out.withColumns({c: F.coalesce(named(c), F.lit(-1)) for c in cols})


def long_shares(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """A8 in long form: (key, column_name, value, share), the share of the key's rows that have
    the value in the column; a missing value is a value of its own."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), named(c).cast("string").alias("value")) for c in cols]))
    counts = df.select(named(key).alias(key), pairs.alias("p")).groupBy(key, "p.column_name", "p.value").agg(F.count(F.lit(1)).alias("n"))
    # every row has one value per column: a column's counts add up to the key's rows
    rows = counts.where(F.col("column_name") == F.lit(cols[0])).groupBy(named(key).alias("_key")).agg(F.sum("n").alias("rows"))
    return counts.join(rows, named(key).eqNullSafe(F.col("_key"))).select(
        key, "column_name", "value", (F.col("n").cast("double") / F.col("rows")).alias("share")
    )


def positions(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """``df`` with ``{col}_position``: the place of each row's value among the sorted values of the
    column, a missing one behind them; and the number of places of every column. The dictionaries
    are ranked on the executors and joined; only their sizes reach the driver."""
    out, sizes = df, []
    for c in cols:
        values = df.select(named(c).cast("string").alias("_value")).where(F.col("_value").isNotNull()).distinct()
        codes = global_rank(values, ["_value"], "_code")
        n = codes.count()
        release(df.sparkSession)  # the shuffles behind the dictionary
        joined = out.join(codes, named(c).cast("string") == F.col("_value"), "left")
        out = joined.withColumn(f"{c}_position", F.coalesce("_code", F.lit(n)).cast("int")).drop("_value", "_code")
        sizes.append(n + 1)
    return out, sizes


def sparse_one_hot(df: DataFrame, cols: Sequence[str], vector: str = "onehot", written: Sequence[str] | None = None) -> tuple[DataFrame, list[int]]:
    """E1 for models, with any number of values: ``df`` with one sparse 0/1 ``vector`` of all
    columns (each has a place per value in sorted order, and one for missing), and the number of
    places of every column. No vocabulary is collected and no column per value is made.

    ``written``: the columns of ``df`` that are kept; they are written once with the places, and
    whoever reads them makes the vectors, which are several times as large."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    coded, sizes = positions(df, cols)
    names = [f"{c}_position" for c in cols]
    if written is not None:
        coded = cut_lineage(coded.select(*map(named, written), *map(named, names)), min_partitions=cores(df.sparkSession))
        release(df.sparkSession)
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    at = F.array(*[F.col(f"`{n}`") + F.lit(s) for n, s in zip(names, starts, strict=True)])
    ones = F.array(*[F.lit(1.0)] * len(cols))
    # a vector by its parts: the ML encoder would name every place in the column's metadata
    parts = F.struct(F.lit(0).alias("type"), F.lit(sum(sizes)).alias("size"), at.alias("indices"), ones.alias("values"))
    made = F.from_json(F.to_json(F.struct(parts.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]
    return coded.withColumn(vector, made).drop(*names), sizes


def places(vector: str) -> Column:
    """The places of a sparse vector's entries, in order."""
    return F.from_json(F.to_json(F.struct(named(vector).alias("v"))), "v struct<indices: array<int>>")["v"]["indices"]


def one_hot_vector_stages(cols: Sequence[str], with_missing: bool = True) -> list:
    """E1 in vector form for Spark ML pipelines: ``StringIndexer`` (value
    order: alphabetical) + ``OneHotEncoder(dropLast=False)`` per column,
    output ``{col}_vec``. Missing values get their own slot when
    ``with_missing`` (``handleInvalid='keep'``). The indexer keeps its values in the model, so
    this form is for few values; :func:`sparse_one_hot` has no such bound."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    idx = [
        StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetAsc",
                      handleInvalid="keep" if with_missing else "skip")
        for c in cols
    ]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_vec" for c in cols],
                        dropLast=False, handleInvalid="error")
    return [*idx, ohe]
