"""Benchmark decontamination by template windows, in DataFrame functions only.

Numbers, units and names of a text become typed placeholders, so a question with
other parameters has the same template. Windows of template tokens of the
benchmark are hash-joined with those of every document; on the hits, the
original values are compared slot by slot: within a window, equal values must map
to equal values, both ways. A capitalised word that begins a sentence may be a name or
not, so templates are read both ways: once it is a word, once a name. A window of few
words says little as a template. So all windows are also joined literally, by their lower-cased words and numbers: copies in
another casing and questions made of numbers are found word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Workspace

#: tokens per window, and the share of them that must be words in a template window
WINDOW, LITERAL_EIGHTHS = 8, 5
#: benchmark windows that are broadcast at most, and bytes of their tokens; beyond, the joins shuffle
MAX_BROADCAST_WINDOWS, MAX_BROADCAST_BYTES = 200_000, 32 << 20

# Units of measure that make a slot after a number
UNITS = (
    "km", "m", "cm", "mm", "mi", "miles", "mile", "ft", "feet", "inches", "inch", "yards", "kg", "g", "mg", "lb", "lbs", "oz", "pounds",
    "l", "ml", "liters", "litres", "gallons", "s", "sec", "seconds", "min", "minutes", "h", "hours", "hour", "days", "day", "weeks", "week",
    "months", "years", "year", "usd", "eur", "dollars", "cents", "euros", "percent", "mph", "kmh", "hz", "w", "kw", "v", "c", "f", "k",
)
MARK = "\x01"
NUMBER = r"[0-9]+(?:[.,][0-9]+){0,3}"
NAME = r"([\p{L}\p{N},;] )(\p{Lu}\p{L}*)"
#: all that two passes of ``NAME`` find, in one: what stands before the space is only looked at, so a
#: name may follow a name. Java looks back by whole characters only if the class names one beyond
#: U+FFFF; this one is a letter, so it is in the class anyway.
NAMES = " (?<=[\\p{L}\\p{N},;\U0001d400] )(\\p{Lu}\\p{L}*)"
UNIT = "(" + "|".join(UNITS) + r")([^\p{L}\p{N}]|\z)"
VALUE_TOKEN = r"\x01n" + NUMBER + r"|\x01[pu]\p{L}+|\p{L}+"


def _marked(text: Column, keep: bool) -> Column:
    """``text`` with its slots marked by type; with their values after the mark if ``keep``.

    A name is a capitalised word after a word, number, comma or semicolon and a space."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK, " ")
    t = F.regexp_replace(t, NAMES, f" {MARK}p" + ("$1" if keep else ""))
    t = F.regexp_replace(t, NUMBER, f"{MARK}n" + ("$0" if keep else ""))
    return F.regexp_replace(t, rf"(\x01n{NUMBER if keep else ''} ?){UNIT}", f"$1{MARK}u" + ("$2" if keep else "") + "$3")


def values(text: Column) -> Column:
    """The tokens of a text: words, and slots as their type and value."""
    return F.regexp_extract_all(_marked(text, True), F.lit(VALUE_TOKEN), F.lit(0))


def template(text: Column) -> Column:
    """Template tokens: lower-cased words, and typed placeholders."""
    return _canonical(values(text))


def literal(text: Column) -> Column:
    """Lower-cased words and values, whatever their casing."""
    return _lowered(values(text))


def _is_slot(token: Column) -> Column:
    return F.startswith(token, F.lit(MARK))


def _canonical(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(_is_slot(t), F.substring(t, 1, 2)).otherwise(F.lower(t)))


def _opened(tokens: Column) -> Column:
    """Tokens with every capitalised word as a name, also at the start of a sentence."""
    first = lambda t: F.substring(t, 1, 1)
    return F.transform(tokens, lambda t: F.when(first(t) != F.lower(first(t)), F.concat(F.lit(f"{MARK}p"), t)).otherwise(t))


def _lowered(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(F.when(_is_slot(t), F.substring(t, 3, 1 << 30)).otherwise(t)))


#: kinds of windows: templates, literal windows, and templates with every capitalised word as a name
TEMPLATE, LITERAL, OPEN = 0, 1, 2
#: the column of a document's tokens by kind
READING = {TEMPLATE: "t", LITERAL: "l", OPEN: "o"}


def _with_windows(rows: DataFrame, column: str, kind: int, lengths: list[int]) -> DataFrame:
    """``rows`` with ``{column}_{n}``: the hashes of all windows of n tokens of ``column``, for every
    wanted length (empty where there are fewer tokens).

    Hashes of windows of 2, 4, ... tokens come from pairs of neighbouring shorter ones, in one
    column each, so a token is hashed once and a window in about log2(n) steps."""
    join = lambda a, b: F.xxhash64(a, b)
    behind = lambda c, places: F.slice(c, places + 1, F.size(column))
    rows = rows.withColumn(f"{column}_p1", F.transform(column, lambda t: F.xxhash64(t, F.lit(kind))))
    p = 1
    while 2 * p <= max(lengths):
        rows = rows.withColumn(f"{column}_p{2 * p}", F.zip_with(f"{column}_p{p}", behind(f"{column}_p{p}", p), join))
        p *= 2
    for n in lengths:
        q = 1 << (n.bit_length() - 1)
        hashes, done = F.col(f"{column}_p{q}"), q
        while done < n:
            q = 1 << ((n - done).bit_length() - 1)
            hashes, done = F.zip_with(hashes, behind(f"{column}_p{q}", done), join), done + q
        # entries that reach beyond the last token are no windows
        rows = rows.withColumn(f"{column}_{n}", F.slice(hashes, 1, F.greatest(F.size(column) - n + 1, F.lit(0))))
    return rows


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, at, length, kind, hash, own of every window: template windows that have words
    enough (``own``: the tokens with slot values; the open ones only where they hold a name, as
    the others are equal), and all literal ones. An item of fewer than ``window`` tokens is one
    window of all of them."""
    out = None
    opened = lambda text: _opened(values(text))
    for kind, read, kept in ((TEMPLATE, template, values), (LITERAL, literal, literal), (OPEN, lambda text: _canonical(opened(text)), opened)):
        items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), read(F.col("text")).alias("t"), kept(F.col("text")).alias("v"))
        items = items.filter(F.size("t") > 0).withColumn("length", F.least(F.size("t"), F.lit(window)))
        items = _with_windows(items, "t", kind, list(range(1, window + 1)))
        hashes = F.coalesce(*[F.when(F.col("length") == n, F.col(f"t_{n}")) for n in range(1, window + 1)])
        rows = items.withColumn("hashes", hashes).select("item_id", "t", "v", "length", F.posexplode_outer("hashes").alias("at", "hash"))
        own = F.slice("t", F.col("at") + 1, F.col("length"))
        words = F.size(F.filter(own, lambda t: ~_is_slot(t)))
        enough = F.lit(True) if kind == LITERAL else words * 8 >= F.col("length") * LITERAL_EIGHTHS
        enough = enough & F.array_contains(own, f"{MARK}p") if kind == OPEN else enough
        part = rows.filter(enough).select("item_id", "at", "length", F.lit(kind).alias("kind"), "hash", F.slice("v", F.col("at") + 1, F.col("length")).alias("own")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, item_id, item_at, at: verified windows of documents (by id and text) and items."""
    work = Workspace(docs.sparkSession, "decontaminate")
    bench = work.save(benchmark_windows(benchmark, window), "benchmark")
    # at most ``window`` lengths of each kind; both tables are measured before either is broadcast
    sizes = bench.groupBy("length", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.array_join("own", ""))).alias("bytes")).collect()
    kinds = sorted((r["length"], r["kind"]) for r in sizes)
    keys = bench.select("hash", "length", "kind").distinct()
    if sum(r["rows"] for r in sizes) <= MAX_BROADCAST_WINDOWS and sum(r["bytes"] or 0 for r in sizes) <= MAX_BROADCAST_BYTES:
        keys, bench = F.broadcast(keys), F.broadcast(bench)
    tokens = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("v", values(F.col("text")))
    # one array of all hashes: for each length the windows of each kind in turn (the kind is part
    # of the hash); the outer form, as an inner explode would infer a filter that tokenises once more
    arrays = [(n, kind, READING[kind]) for n, kind in kinds or [(window, TEMPLATE)]]
    # tokens are found once, then read in all ways
    v = F.col("v")
    read = tokens.select("doc_id", "text", "v", _canonical(v).alias("t"), _lowered(v).alias("l"), _canonical(_opened(v)).alias("o"))
    for kind, column in READING.items():
        wanted = [n for n, k, _ in arrays if k == kind]
        read = _with_windows(read, column, kind, wanted) if wanted else read
    own = read.select("doc_id", "text", F.posexplode_outer(F.concat(*[F.col(f"{column}_{n}") for n, _, column in arrays])).alias("place", "hash"))
    # one row per document with hits, so its tokens are extracted once
    found = work.save(
        own.join(keys, "hash").groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(
            F.first("text").alias("text"), F.collect_set(F.struct("place", "length", "kind", "hash")).alias("hits")
        ), "hits",
    )
    rows = found.select("doc_id", "text_hash", values(F.col("text")).alias("v"), "hits").withColumn("l", _lowered(v)).withColumn("o", _opened(v))
    rows = rows.select("doc_id", "text_hash", "v", "l", "o", F.explode_outer("hits").alias("hit"))
    before, starts = F.lit(0), []
    for n, kind, _ in arrays:
        starts.append(F.when((F.col("hit.length") == n) & (F.col("hit.kind") == kind), before))
        before = before + F.greatest(F.size("v") - n + 1, F.lit(0))
    rows = rows.withColumn("at", F.col("hit.place") - F.coalesce(*starts)).filter("at >= 0")
    theirs = F.slice(F.when(F.col("hit.kind") == LITERAL, F.col("l")).when(F.col("hit.kind") == OPEN, F.col("o")).otherwise(v), F.col("at") + 1, F.col("hit.length"))
    rows = rows.select("doc_id", "text_hash", "at", "hit.length", "hit.kind", "hit.hash", theirs.alias("theirs"))
    own = bench.withColumnRenamed("at", "item_at")
    same = F.when(F.col("kind") == LITERAL, F.col("own") == F.col("theirs")).otherwise(_canonical(F.col("own")) == _canonical(F.col("theirs")))
    paired = rows.join(own, ["hash", "length", "kind"]).filter(same)
    slots = F.filter(F.arrays_zip("own", "theirs"), lambda p: _is_slot(p["own"]))
    paired = paired.withColumn("slots", F.array_distinct(slots))
    n = F.size("slots")
    consistent = (F.size(F.array_distinct(F.transform("slots", lambda p: p["own"]))) == n) & (F.size(F.array_distinct(F.transform("slots", lambda p: p["theirs"]))) == n)
    return paired.filter(consistent).select("doc_id", "text_hash", "item_id", "item_at", "at")


def verdicts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_windows, n_items, first_item of the contaminated documents."""
    return matches(docs, benchmark, window).groupBy("doc_id", "text_hash").agg(
        F.countDistinct("at").alias("n_windows"), F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item")
    )


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    return F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_windows, n_items, first_item, contaminated of every document.

    Null and empty texts have no window, items without tokens none either; an item
    without an id counts as item -1. Repeated rows get the same answer."""
    doc_id, text_hash = _keyed(docs)
    found = verdicts(docs, benchmark, window)
    rows = docs.select(doc_id.alias("d"), text_hash.alias("h"))
    return rows.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left").select(
        F.col("d").alias("doc_id"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "first_item", F.col("n_windows").isNotNull().alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a verified window, with all their columns as they are,
    whatever their names. Null and empty texts stay; repeated rows, and rows without an id, are
    judged by their text like any other; empty tables of either kind remove nothing."""
    found = verdicts(docs, benchmark, window).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    doc_id, text_hash = _keyed(docs)
    # the rows travel as one struct, so no name of theirs meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_id.alias("id"), text_hash.alias("t"))
    kept = rows.join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("h")), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _sql_marked(column: str, keep: bool) -> str:
    t = f"translate(coalesce({column}, ''), chr(1), ' ')"
    for _ in range(2):
        t = f"regexp_replace({t}, '{NAME}', '\\1' || chr(1) || 'p{chr(92) + '2' if keep else ''}', 'g')"
    t = f"regexp_replace({t}, '{NUMBER}', chr(1) || 'n{chr(92) + '0' if keep else ''}', 'g')"
    return f"regexp_replace({t}, '(\\x01n{NUMBER if keep else ''} ?){UNIT}', '\\1' || chr(1) || 'u{chr(92) + '2' if keep else ''}\\3', 'g')"


def sql(window: int = WINDOW) -> str:
    """DuckDB SQL for :func:`report` over ``documents`` and ``benchmark``."""
    values_ = lambda c: f"regexp_extract_all({_sql_marked(c, True)}, '{VALUE_TOKEN}')"
    literal_ = lambda c: f"list_transform({values_(c)}, lambda x: lower(CASE WHEN x[1] = chr(1) THEN x[3:] ELSE x END))"
    opened_ = lambda c: f"list_transform({values_(c)}, lambda x: CASE WHEN x[1] <> lower(x[1]) THEN chr(1) || 'p' || x ELSE x END)"
    slots_ = lambda c: f"list_transform({c}, lambda x: CASE WHEN x[1] = chr(1) THEN x[1:2] ELSE lower(x) END)"
    # every text in both readings: names inside sentences, and every capitalised word as a name
    ways = lambda columns, source: f"(SELECT {columns}, 0 AS way, {values_('text')} AS v FROM {source} UNION ALL SELECT {columns}, 1, {opened_('text')} FROM {source})"
    return f"""
WITH items AS (SELECT item_id, way, {slots_('v')} AS t, v FROM {ways('coalesce(item_id, -1) AS item_id', 'benchmark')}),
     sized AS (SELECT *, least(len(t), {window}) AS n FROM items WHERE len(t) > 0),
     spots AS (SELECT *, unnest(range(1, len(t) - n + 2)) AS pos FROM sized),
     bench AS (SELECT DISTINCT item_id, way, pos, n, t[pos:pos + n - 1] AS w, v[pos:pos + n - 1] AS own FROM spots
               WHERE 8 * len(list_filter(t[pos:pos + n - 1], lambda x: x[1] <> chr(1))) >= {LITERAL_EIGHTHS} * n),
     docs AS (SELECT DISTINCT doc_id, text, way, {slots_('v')} AS t, v FROM {ways('doc_id, text', 'documents')}),
     cut AS (SELECT doc_id, text, way, t, v, n, unnest(range(1, len(t) - n + 2)) AS pos FROM docs, (SELECT DISTINCT n FROM bench)),
     pairs AS (SELECT c.doc_id, c.text, b.item_id, c.pos, list_distinct(list_filter(list_zip(b.own, c.v[c.pos:c.pos + c.n - 1]), lambda p: p[1][1] = chr(1))) AS slots
               FROM cut c JOIN bench b ON b.n = c.n AND b.way = c.way AND b.w = c.t[c.pos:c.pos + c.n - 1]),
     good AS (SELECT doc_id, text, item_id, pos FROM pairs
              WHERE len(list_distinct(list_transform(slots, lambda p: p[1]))) = len(slots) AND len(list_distinct(list_transform(slots, lambda p: p[2]))) = len(slots)),
     litems AS (SELECT item_id, l, n, unnest(range(1, len(l) - n + 2)) AS pos FROM (SELECT *, least(len(l), {window}) AS n FROM
                (SELECT coalesce(item_id, -1) AS item_id, {literal_('text')} AS l FROM benchmark) WHERE len(l) > 0)),
     lbench AS (SELECT DISTINCT item_id, pos, n, l[pos:pos + n - 1] AS w FROM litems),
     lcut AS (SELECT doc_id, text, l, n, unnest(range(1, len(l) - n + 2)) AS pos FROM (SELECT DISTINCT doc_id, text, {literal_('text')} AS l FROM documents), (SELECT DISTINCT n FROM lbench)),
     lgood AS (SELECT c.doc_id, c.text, b.item_id, c.pos FROM lcut c JOIN lbench b ON b.n = c.n AND b.w = c.l[c.pos:c.pos + c.n - 1]),
     found AS (SELECT doc_id, text, count(DISTINCT pos) AS n_windows, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item
               FROM (SELECT * FROM good UNION ALL SELECT * FROM lgood) GROUP BY ALL)
SELECT d.doc_id, coalesce(f.n_windows, 0) AS n_windows, coalesce(f.n_items, 0) AS n_items, f.first_item, f.n_windows IS NOT NULL AS contaminated
FROM documents d LEFT JOIN found f ON d.doc_id IS NOT DISTINCT FROM f.doc_id AND d.text IS NOT DISTINCT FROM f.text
"""
