import pandas as pd
from oracle import duck, same

from ledgerline.llm import decontaminate as D
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.01"
ITEMS = [
    (1, "A train leaves Paris at 9 and travels 120 km in 2 hours while Anna Maria waits at the station for 120 minutes"),
    (2, "short item of five words"), (3, None), (4, ""), (5, "12 13 14 15 16 17 18 19"), (None, "the quick brown fox jumps over the lazy dog again"), (2, "short item of five words"),
    (6, "What is 12 * 7 + 5 - 3?"), (7, "Tom has 3 apples. Ann has 5 apples. Bob has 2 more apples than Ann."),
]
DOCS = [
    (10, "Intro text. A train leaves London at 7 and travels 300 km in 5 hours while Eva Lena waits at the station for 300 minutes. The end."),
    (11, "A train leaves London at 7 and travels 300 km in 5 hours while Eva Lena waits at the station for 12 minutes."),
    (12, "a train leaves PARIS at nine"), (13, None), (14, ""), (15, "nothing to see here at all in this clean text of many words"),
    (16, "We saw a Short item of five words there"), (17, "1 2 3 4 5 6 7 8 9 10 11 12"), (18, "see the QUICK brown fox jumps over the lazy dog again"),
    (19, "x\x01p y 1,2,3,4,5,6,7km 5 kg, by IBM Corp A B C D"), (20, "1," * 5_000 + " word " * 300), (10, "Other text with the same id"), (None, "short item of five words"),
    (15, "nothing to see here at all in this clean text of many words"),
    (21, "leaves Rome at 2 and travels 2 km in 1 hours"), (22, "so WHAT IS 12 * 7 + 5 - 3? twelve"), (23, "what is 12 * 7 + 5 - 4?"),
    (24, "A TRAIN LEAVES PARIS AT 9 AND TRAVELS 120 KM IN 2 HOURS"), (25, "list 12 13 14 15 16 17 18 19 end"),
    (26, "Eva has 4 apples. Max has 6 apples. Leo has 9 more apples than Max."), (27, "We know that Eva has 4 apples. Max has 6 apples. Leo has 9 more apples than Max."),
    (28, "Eva has 4 apples. Eva has 6 apples. Eva has 6 more apples than Eva."), (29, "Eva had 4 pears. Max had 6 pears. Leo had 9 fewer pears than Max."),
]


def frames(spark):
    docs = pd.DataFrame(DOCS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    items = pd.DataFrame(ITEMS, columns=["item_id", "text"]).astype({"item_id": "Int64"})
    sd = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "7 as item_id", "1 as length", "'x' as hash")
    si = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "3 as doc_id", "'clash' as at")
    return docs, items, sd, si


def test_templates_and_slots(spark):
    docs, items, sd, si = frames(spark)
    rows = same(D.report(sd, si), duck(D.sql(), documents=docs, benchmark=items))
    hit = {(r[1], r[2]) for r in rows if r[0]}
    # other parameters, other case, an item of few words, items of numbers, and other names at the start of
    # sentences; a document with equal values for two of a window's slots is none
    assert {d for d, _ in hit} == {10, 11, 16, 18, 22, 24, 25, 26, 27, None}
    left = D.remove(sd, si)
    assert left.columns == sd.columns
    assert left.count() == len(DOCS) - len([r for r in rows if r[0]])


def test_alignment_of_tokens(spark):
    _, _, sd, si = frames(spark)
    from pyspark.sql import functions as F

    for df in (sd, si):
        assert df.filter(D._canonical(D.values(F.col("text"))) != D.template(F.col("text"))).count() == 0


def test_documents(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    same(D.report(docs, bench), duck(D.sql(), documents=f"{SF}/documents.parquet", benchmark=f"{SF}/benchmark.parquet"))


def test_long_text(spark):
    text = "1," * 50_000 + " Word name " * 30_000 + "a train leaves London at 7 and travels 300 km in 5 hours while"
    sd = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert D.report(sd, frames(spark)[3]).first()["contaminated"]


def test_empty(spark):
    _, _, sd, si = frames(spark)
    assert D.report(sd.limit(0), si).count() == 0
    assert D.report(sd, si.limit(0)).filter("contaminated").count() == 0


def test_names_in_one_pass(spark):
    """One look at a text marks what two passes of the SQL's rule mark, names next to names included."""
    from pyspark.sql import functions as F

    from ledgerline.llm import decontaminate as D

    texts = ["a B C D E", "Bob Carl Dan Eve", "", " Bob", "x Bob, Carl; Dan 5 Eve", "a Ábra Čap", "a 𝐀b 𝐁c D", "𝐛 Bob", "𐐨 𐐀𐐁 X",
             "é Bob E\u0301 Carl", "a  Bob", "a\nBob C", "5 A B. C D", "a \x01pB C", "z B1 C2 D", "𝟗 B", "😀 B"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    for keep in (True, False):
        twice = F.translate(F.coalesce("text", F.lit("")), D.MARK, " ")
        for _ in range(2):
            twice = F.regexp_replace(twice, D.NAME, f"$1{D.MARK}p" + ("$2" if keep else ""))
        once = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), D.MARK, " "), D.NAMES, f" {D.MARK}p" + ("$1" if keep else ""))
        assert rows.filter(once != twice).count() == 0
    # names, numbers and units: a pass each
    assert rows.select(D._marked(F.col("text"), True))._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 6
