"""The compacted graph: degrees, paths, circles, spans, and frequent keys that are broadcast."""

import random
from collections import Counter

import pytest

from codeloom.llm import substring

WINDOW = 4


def brute_windows(texts, window):
    """Words that a window covers which starts elsewhere as well."""
    runs = {i: [tuple(t.split()[j : j + window]) for j in range(len(t.split()) - window + 1)] for i, t in enumerate(texts)}
    count = Counter(w for ws in runs.values() for w in ws)
    return {i: {j + d for j, w in enumerate(ws) if count[w] > 1 for d in range(window)} for i, ws in runs.items()}


def spans(spark, texts):
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "key long, text binary")
    return [(r["key"], (r["u1"], r["u2"]), r["first"], r["edges"]) for r in substring.repeated_spans(rows, WINDOW).collect()]


def test_a_copied_passage_is_one_path(spark):
    passage = " ".join(f"w{i}" for i in range(200))
    got = spans(spark, [passage, f"x y {passage} z", "nothing here at all today"])
    assert sorted((k, f, n) for k, _, f, n in got) == [(0, 0, 197), (1, 2, 197)]
    assert len({u for _, u, _, _ in got}) == 1


def test_paths_end_where_the_graph_branches(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    got = spans(spark, [f"{a} {b}", f"{a} {c}", f"{a} {b}", f"{a} {c}"])
    paths = {key: {u for k, u, _, _ in got if k == key} for key in range(4)}
    assert paths[0] == paths[2] and paths[1] == paths[3]
    assert len(paths[0] & paths[1]) == 1 and len(paths[0] | paths[1]) == 3
    shared = {(f, n) for k, u, f, n in got if u in paths[0] & paths[1]}
    assert len(shared) == 1 and shared.pop()[0] == 0


def test_compacted_chains_and_circles(spark):
    chain = [(i, i, 100 + i, 101 + i, 2) for i in range(37)]
    circle = [(50 + i, 50 + i, 200 + i, 200 + (i + 1) % 5, 1) for i in range(5)]
    fork = [(70, 70, 300, 301, 1), (71, 71, 301, 302, 1), (72, 72, 301, 303, 1), (73, 73, 304, 304, 1)]
    atoms = spark.createDataFrame(chain + circle + fork, "a1 long, a2 long, head long, tail long, edges long")
    got = {r["a1"]: (r["u1"], r["pos"]) for r in substring.compacted(atoms).collect()}
    assert got == {**{i: (0, 2 * i) for i in range(37)}, **{50 + i: (50 + i, 0) for i in range(5)}, **{i: (i, 0) for i in range(70, 74)}}
    assert substring.compacted(atoms.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 1000])
def test_windows_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_ROWS", hot)
    r = random.Random(hot)
    words = [f"v{i}" for i in range(12)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 60))) for _ in range(60)] + ["a b " * 20, "a b c " * 9, "q " * 30, ""]
    covered = {i: set() for i in range(len(texts))}
    for k, _, f, n in spans(spark, texts):
        covered[k].update(range(f, f + n + WINDOW - 1))
    assert covered == brute_windows(texts, WINDOW)


def test_runs_of_one_text_leave_few_pointers(spark, monkeypatch):
    """A text's chain is one run, circles end the rounds at once, and places out of order change no result."""
    chain = [(i, i, 100 + i, 101 + i, 2) for i in range(37)]
    circle = [(50 + i, 50 + i, 200 + i, 200 + (i + 1) % 5, 1) for i in range(5)]
    rows = [(*x, (1 << 30) + x[0]) for x in chain + circle]
    schema, made = "a1 long, a2 long, head long, tail long, edges long, at long", []
    keep = substring.materialize
    monkeypatch.setattr(substring, "materialize", lambda df, name: made.append((name, keep(df, name))) or made[-1][1])
    expected = {**{i: (0, 2 * i) for i in range(37)}, **{50 + i: (50 + i, 0) for i in range(5)}}
    assert {r["a1"]: (r["u1"], r["pos"]) for r in substring.compacted(spark.createDataFrame(rows, schema)).collect()} == expected
    assert [df.count() for name, df in made if name == "run-starts"] == [2]
    assert len([1 for name, _ in made if name == "pointers"]) == 2
    random.Random(5).shuffle(rows)
    mixed = [(*x[:5], (x[5] % 3 << 30) + i) for i, x in enumerate(rows)]
    assert {r["a1"]: (r["u1"], r["pos"]) for r in substring.compacted(spark.createDataFrame(mixed, schema)).collect()} == expected
