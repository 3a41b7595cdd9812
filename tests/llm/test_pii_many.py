"""Texts with very many matches: linear work, places and masks as for few."""

import time

from codeloom.llm import pii


def test_a_text_with_a_hundred_thousand_proposals(spark):
    pii.report(spark.createDataFrame([(0, "a@b.de")], "doc_id long, text string")).collect()
    card = "4465758382889437"
    texts = [f"é {card}x " * n for n in (1, 31, 32, 33, 1023, 1025, 50_000)] + ["a@b.de 1.2.3.4 " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert time.time() - began < 30
    for i, n in enumerate((1, 31, 32, 33, 1023, 1025, 50_000)):
        assert got[i]["n_card"] == n
        assert got[i]["spans"] == ",".join(f"card:{20 * k + 2}:{20 * k + 18}" for k in range(n))
    masked = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert masked == {i: t.replace(card, "<card>").replace("a@b.de", "<email>").replace("1.2.3.4", "<ip>") for i, t in enumerate(texts)}


def test_context_reaches_back_to_the_last_proposal(spark):
    texts = ["ssn 078-05-1120 and then 078-05-1121", "078-05-1120, his ssn: 078-05-1121", "ssn" + " " * 40 + "078-05-1120"]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "national_id:4:15", 1: "national_id:22:33", 2: ""}
