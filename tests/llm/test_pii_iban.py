"""IBANs next to capitals and digits."""

from codeloom.llm import pii


def test_ibans_before_and_after_capitals(spark):
    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    texts = [f"to {gb} BIC MIDLGB22", f"{de} EUR 20", f"{de} {gb} {de}", f"é REF AB12 {gb}.", "GB83 WEST 1234 5698 7654 32 BIC MIDLGB22", f"XX{de} EUR 20"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("iban")] for r in pii.report(docs).collect()}
    at = lambda i, x, start=0: f"iban:{texts[i].index(x, start)}:{texts[i].index(x, start) + len(x)}"
    assert got == {0: [at(0, gb)], 1: [at(1, de)], 2: [at(2, de), at(2, gb), at(2, de, 30)], 3: [at(3, gb)], 4: [], 5: []}
