"""Planted items of 5 to 40 words, verbatim and re-parameterised, wherever they stand; also against the SQL."""

import random

import pandas as pd
from pyspark.sql import functions as F

from codeloom.llm import contamination

NAMES = "Tom Ann Natalia Weng Bob Sue Greta Igor Paul Mary Berlin Lagos Quito Osaka Nairobi Lima Oslo".split()
UNITS = "km kg hours minutes dollars days".split()
WORDS = "has buys gives sells apples boats clips tickets boxes every week before lunch then again half as many more than left over after walking running to the from a with green small old quickly shop river train".split()


def question(r, n):
    """A question of n words as a list of words and slots (kind, number)."""
    out = [("name", 0)]
    while len(out) < n:
        x = r.random()
        out.append(("name", r.randrange(2)) if x < 0.1 else ("num", r.randrange(3)) if x < 0.22 else ("unit", 0) if x < 0.27 and out[-1][0] == "num" else r.choice(WORDS))
    return out


def filled(q, names, numbers, unit, end):
    return " ".join(w if isinstance(w, str) else names[w[1]] if w[0] == "name" else numbers[w[1]] if w[0] == "num" else unit for w in q) + end


def planted(seed):
    r = random.Random(seed)
    noise = lambda k: " ".join(r.choices("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor".split(), k=k))
    items, docs, want = [], [], {}
    for i in range(40):
        q = question(r, 5 + i * 35 // 39)
        names, numbers = r.sample(NAMES, 4), [str(r.randint(2, 90)), f"{r.randint(1, 9)},{r.randint(100, 999)}", f"{r.randint(1, 9)}.{r.randint(1, 9)}"]
        items.append((i, filled(q, names[:2], numbers, "km", r.choice(["?", "."]))))
        other = filled(q, names[2:], [str(r.randint(100, 999)) for _ in range(3)], r.choice(UNITS), ".")
        for text in (items[-1][1], other):
            for before in ("", f"{noise(9)} with ", f"{noise(9)}. ", "Here we go again with ", "Question 3: "):
                docs.append((len(docs), f"{before}{text} {noise(12)}"))
                want[len(docs) - 1] = (i, text == other)
        for text in (items[-1][1].lower(), items[-1][1].upper()):
            docs.append((len(docs), f"{noise(5)} {text} {noise(5)}"))
            want[len(docs) - 1] = (i, False)
    clean = [(10_000 + i, f"{noise(60)} {filled(question(r, 30), r.sample(NAMES, 2), ['7', '8', '9'], 'kg', '.')}") for i in range(60)]
    return items, docs, want, clean


def test_planted_items_are_found(spark):
    items, docs, want, clean = planted(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), bench)
    got = {r["doc_id"]: set(r["items"].split(",")) for r in found.select("doc_id", F.col("items")).collect()}
    verbatim = [str(i) in got[d] for d, (i, changed) in want.items() if not changed]
    changed = [str(i) in got[d] for d, (i, changed) in want.items() if changed]
    assert sum(verbatim) == len(verbatim)
    assert sum(changed) >= 0.9 * len(changed), sum(changed) / len(changed)
    assert all(got[d] == {""} for d, _ in clean)


def test_every_rule_equals_the_sql(spark):
    """The SQL over planted items, torn slots, short, dense and unspaced items and odd rows."""
    import duckdb

    items, docs, _, clean = planted(4)
    tom = "Tom has 5 apples and gives Ann 5 km of rope while Tom walks 3 miles to see the old river boat near Osaka."
    items += [(100, tom), (101, "12 15 18 21 24 27 30 33 36 39"), (102, "The Old Man And The Sea Of Northern Lights"), (103, "Define entropy"), (104, "非洲大陆上最高的山是哪一座"), (105, "Yes"), (106, None), (107, ""), (100, tom)]
    more = [tom.replace("Tom walks", "Bob walks"), tom.replace("5 km", "6 km"), tom.replace("5", "9").replace("Tom", "Eve").replace("Eve walks", "Sam walks"), "so 12 15 18 21 24 27 30 33 36 39 end", "a 12 15 18 21 24 27 30 33 36 40",
            "we read The Old Man And The Sea Of Northern Lights now", "now define ENTROPY", "请问非洲大陆上最高的山是哪一座呢", "yes", "yes no", None, "", "Tom", tom + " " + tom, "Yesterday " + tom + " Next"]
    rows = docs[::3] + clean[:20] + [(20_000 + i, t) for i, t in enumerate(more)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, contaminated, n_windows, items FROM ({contamination.ORACLE_SQL})").fetchall()}
    out = contamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["contaminated"], r["n_windows"], ",".join(sorted(r["items"].split(","), key=str))) for r in out.collect()}
    assert got == {k: (c, n, ",".join(sorted(i.split(","), key=str))) for k, (c, n, i) in want.items()}
    assert sum(c for c, _, _ in got.values()) > 100
