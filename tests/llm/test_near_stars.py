"""Candidates by bucket: chains of look-alikes do not run together, and stars leave no link out."""

import random

from pyspark.sql import functions as F

from codeloom.llm import minhash


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """Smallest id that each document reaches over links of 0.85 or more."""
    sets, up = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            shared = len(sets[x] & sets[y])
            if sets[x] and 100 * shared >= 85 * (len(sets[x]) + len(sets[y]) - shared):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    return {i: root(i) for i in ids}


def found(spark, docs):
    out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    return {r["doc_id"]: r["component_id"] for r in out.collect()}


def chain(n, step, size=200, first=0):
    return [(first + i, " ".join(f"w{first}x{j}" for j in range(i * step, i * step + size))) for i in range(n)]


def test_a_long_chain_of_unlinked_documents_costs_little(spark):
    n = 400
    docs = chain(n, 20)  # neighbours have 0.81 in common, so they share buckets and are not linked
    rows = spark.createDataFrame(docs, "id long, text string").select("id", F.col("text").cast("binary").alias("text"))
    signed = rows.mapInArrow(minhash._sign(5), minhash._SIGNED)
    star = minhash.stars(signed.select("id", "bands"))
    pairs = star.groupBy("cluster").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert star.select("id").distinct().count() > 0.9 * n
    assert pairs < 40 * n  # all of them in one component would be n * n
    assert found(spark, docs) == {i: i for i in range(n)}


def test_links_that_no_star_has(spark, monkeypatch):
    """Chains in which only neighbours are linked, and groups of which the star is a stranger."""
    r = random.Random(6)
    docs = chain(30, 10) + chain(25, 14, first=1000)
    base = [f"b{i}" for i in range(300)]
    for i in range(60):
        words = list(base)
        for _ in range(r.choice([2, 9])):
            words[r.randrange(300)] = f"y{r.randrange(10**6)}"
        docs.append((2000 + i, " ".join(words)))
    want = brute(docs)
    assert found(spark, docs) == want
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert found(spark, docs) == want
