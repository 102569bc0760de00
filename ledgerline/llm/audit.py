"""Filter interaction audit: what every order of five filters would remove, and where.

A document is described by the mask of the filters that it fails. In an order of the
filters it is removed at the first filter of its mask. The orders are numbered by their
lexicographic (Lehmer) rank; all orders that begin with the same filters have adjacent
ranks. So the orders in which a mask is removed at step s by filter f are intervals of
ranks, one for each way to put s - 1 passed filters in front of f.

Documents are counted once per (part, mask). The counts are added at the first rank of
each interval and subtracted after its last one, and a prefix sum over the 120 ranks
gives the removals of all orders and steps. No order is ever applied to a document.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Workspace

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))
#: white space of the word pattern [^\x20\x09-\x0D]+
_SPACES = r"[\x20\x09-\x0D]+"

#: thresholds of the filters
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SYMBOLS = "[#$%&*|]"


# ------------------------------------------------------------------ orders
def lehmer_rank(order: str, names: str = FILTERS) -> int:
    """Lexicographic rank of a permutation of ``names``, or of the first one that begins with ``order``."""
    rank, left = 0, list(names)
    for name in order:
        rank += left.index(name) * factorial(len(left) - 1)
        left.remove(name)
    return rank


def intervals(names: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of every interval of orders in which a
    document that fails exactly the filters of ``mask`` is removed at ``step``."""
    out = []
    for mask in range(1, 1 << len(names)):
        failing = [c for i, c in enumerate(names) if mask >> i & 1]
        passing = [c for c in names if c not in failing]
        for step in range(1, len(passing) + 2):
            width = factorial(len(names) - step)
            for before in permutations(passing, step - 1):
                for f in failing:
                    first = lehmer_rank("".join(before) + f, names)
                    out.append((mask, step, first, first + width))
    return out


def _orders(spark: SparkSession) -> DataFrame:
    """(cell, rank, filter_order, step, filter) of the 120 orders, five rows each."""
    n = len(FILTERS)
    rows = [(r * n + s, r, "".join(p), s + 1, p[s]) for r, p in enumerate(permutations(FILTERS)) for s in range(n)]
    return spark.createDataFrame(rows, "cell int, rank int, filter_order string, step int, filter string")


def _edges(spark: SparkSession) -> DataFrame:
    """(mask, step, rank, sign): both ends of every interval; 1,680 rows, whatever the data."""
    rows = [e for m, s, a, b in intervals() for e in ((m, s, a, 1), (m, s, b, -1))]
    return spark.createDataFrame(rows, "mask int, step int, rank int, sign int")


# ------------------------------------------------------------------- masks
def _bit(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0))


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask without E, digest) of every document; texts go no further."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    words = F.array_remove(F.split("text", _SPACES, -1), "")
    rows = rows.select("doc_id", "part", "text", words.alias("words"))
    rows = rows.select(
        "doc_id",
        "part",
        F.size("words").cast("long").alias("n"),
        F.size(F.array_distinct("words")).cast("long").alias("d"),
        # runs of other characters go in one step each
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("u"),
        F.length("text").cast("long").alias("c"),
        F.col("text").rlike(SYMBOLS).alias("s"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    mask = (
        _bit(F.col("n") < MIN_WORDS, "A")
        + _bit(F.col("d") * 100 < F.col("n") * MIN_DISTINCT_PERCENT, "B")
        + _bit(F.col("u") * 100 > F.col("c") * MAX_CAPITALS_PERCENT, "C")
        + _bit(F.col("s"), "D")
    )
    return rows.select("doc_id", "part", mask.alias("mask"), "digest")


def _marks(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row per labelled document."""
    one = lambda c: F.max((F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1).cast("int"))
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
        .filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(one("quality").alias("good"), one("toxic").alias("toxic"))
        .withColumn("away", F.lit(0))
    )


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail.

    A text held by many documents is one row per (part, flags) before any join on it: rows of
    the same id and text are counted together first, then rows of the same text; the least
    id of a text comes from these counts, so a third of all rows with one text is a few rows."""
    same_id = _described(docs).groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("k"))
    # documents without an id have no label; a value of their own spreads them over the tasks
    away = F.when(F.col("doc_id").isNull(), F.hash("digest")).otherwise(F.lit(0))
    marked = same_id.withColumn("away", away).join(_marks(labels), ["doc_id", "away"], "left")
    same_text = (
        marked.select(
            "digest", "part", "mask", "k", "doc_id",
            F.coalesce("good", F.lit(0)).alias("good"),
            F.coalesce("toxic", F.lit(0)).alias("toxic"),
        )
        .groupBy("digest", "part", "mask", "good", "toxic")
        .agg(
            F.sum("k").alias("n"),
            F.sum(F.when(F.col("doc_id").isNotNull(), F.col("k")).otherwise(0)).alias("with_id"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "k"))).alias("least"),
        )
    )
    # at most one row per part and flags of a text
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    later = same_text.withColumn("first", first).select(
        "part", "mask", "good", "toxic", "n",
        F.when(F.col("least.doc_id") == F.col("first"), F.col("with_id") - F.col("least.k"))
        .otherwise(F.col("with_id")).alias("repeats"),
    )
    e = 1 << FILTERS.index("E")
    split = F.explode(F.array(
        F.struct((F.col("mask") + e).alias("mask"), F.col("repeats").alias("n")),
        F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("repeats")).alias("n")),
    ))
    return (
        later.select("part", "good", "toxic", split.alias("x"))
        .filter("x.n > 0")
        .groupBy("part", F.col("x.mask").alias("mask"))
        .agg(
            F.sum("x.n").alias("n"),
            F.sum(F.col("x.n") * F.col("good")).alias("good"),
            F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"),
        )
    )


# ------------------------------------------------------------------- audit
def _per_part(counts: DataFrame) -> DataFrame:
    """(part, total, by_filter): of every filter, the documents that fail it and those that fail it alone."""
    fails = lambda i: F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0))
    alone = lambda i: F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0))
    each = F.map_from_arrays(
        F.array(*(F.lit(c) for c in FILTERS)),
        F.array(*(F.struct(fails(i).alias("fails"), alone(i).alias("alone")) for i in range(len(FILTERS)))),
    )
    return counts.groupBy("part").agg(F.sum("n").alias("total"), each.alias("by_filter"))


def interactions(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """The audit of every part of ``counts`` (part, mask, n, good, toxic): 120 orders of 5 steps each."""
    # both small tables are fixed by the five filters, not by the data
    ends = (
        counts.join(F.broadcast(_edges(spark)), "mask")
        .groupBy("part", "step", "rank")
        .agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("n", "good", "toxic")))
        .filter(F.col("rank") < ORDERS)
    )
    cells = F.explode(F.sequence(F.lit(0), F.lit(ORDERS * len(FILTERS) - 1)))
    grid = _per_part(counts).withColumn("cell", cells).join(F.broadcast(_orders(spark)), "cell")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    here = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(along)
    steps = grid.join(ends, ["part", "step", "rank"], "left").select(
        "part", "rank", "filter_order", "step", "filter", "total",
        F.element_at("by_filter", F.col("filter")).alias("own"),
        here("n").alias("removed"), here("good").alias("good_lost"), here("toxic").alias("toxic_lost"),
    )
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    of_filter = Window.partitionBy("part", "filter")
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("removed").over(so_far)).alias("kept"),
        "removed",
        (F.col("own.fails") - F.col("removed")).alias("redundant"),
        F.col("own.alone").alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(of_filter).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per (part, filter_order, step): part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    The filters fail a document A: of under 50 words; B: whose distinct words are under 65 % of
    its words; C: with over 5 % capitals A-Z among its code points; D: with any of ``#$%&*|``;
    E: whose text a document of smaller id has, in any part. A part is a value of ``source``; a
    null source is the empty string.

    A null text counts as empty (it fails A, and E after a smaller id's empty text). A document
    without an id is counted, has no label, never fails E and makes no other fail it. Rows that
    repeat an id are documents of their own; with one text they do not fail E through each
    other. Several label rows of one id mark it good (toxic) if any does. An empty table of
    documents gives no rows, an empty table of labels zero losses. Other columns, whatever
    their names, are not read."""
    spark = docs.sparkSession
    # at most 32 rows per part, read by the steps that follow
    counts = Workspace(spark, "audit").save(mask_counts(docs, labels), "counts")
    return interactions(spark, counts)


_LETTERS = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(FILTERS))
#: the same rows by applying every order to the masks
SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda w: w <> '') AS w
  FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < {MIN_WORDS} THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS_PERCENT} * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '{SYMBOLS}') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM words LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
f(c, bit) AS (VALUES {_LETTERS}),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
applied AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM applied
"""
