"""Verbatim copies of items that template windows alone cannot find."""

from pyspark.sql import functions as F

from codeloom.llm import contamination

QUESTION = "What is the tallest mountain on the continent of Africa?"
TITLE = "The Old Man And The Sea Of Northern Lights By Anna Berg"
ROW = "12 15 18 21 24 27 30 33 36 39"
SHORT = "Define entropy briefly"
HAN = "非洲大陆上最高的山是哪一座"


def test_exact_copies_of_all_items_are_found(spark):
    items = [(1, QUESTION), (2, TITLE), (3, ROW), (4, SHORT), (5, HAN), (6, "Yes"), (1, QUESTION)]
    texts = [
        f"Question: {QUESTION} Answer it.", f"we read {TITLE} at school", f"the row {ROW} ends", f"Please {SHORT.lower()} and stop.", f"请问{HAN}呢",
        "yes", "Question: What is the tallest mountain on the continent of Asia?", "yes to all, define entropy at length", "the row 12 15 18 21 24 27 30 33 36 40 ends", "非洲大陆上最高的楼",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = contamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).filter("contaminated")
    got = {r["doc_id"]: r["items"] for r in out.select("doc_id", F.col("items")).collect()}
    assert got == {0: "1", 1: "2", 2: "3", 3: "4", 4: "5", 5: "6", 6: "1"}
