"""Removal of repeated word windows by compaction of a De Bruijn graph.

The windows of k words are the edges of a graph whose nodes are runs of k-1 words. A
document is a path of edges. Only repeated edges matter, so unique ones are left out
before the graph is built:

1. An Arrow function cuts each document's path at changes of its windows' minimizers (the
   smallest hash among a window's SEED-word runs). A piece is known by 128 bits of BLAKE2
   of its words at its source coordinates and has the two nodes at its ends. Equal windows
   have equal minimizers, so a piece whose minimizer is seen once holds no repeated edge.
2. Pieces seen twice repeat whole. Where a minimizer has pieces that were seen once, the
   edges of one occurrence of each of its pieces are digested from the source and counted.
   Repeated pieces and repeated single edges are the graph's edges, each once.
3. Degrees: a node with one edge in and one out joins them. Edges that one text has in a row
   become runs; pointer doubling over the runs compacts every nonbranching path: each edge
   gets its path and its place there.
4. Occurrences of edges are put together to spans by document, path and diagonal; their
   source coordinates say which words go. An edge that repeats covers its k words, so the
   union of spans is the union of repeated windows.

Counts are partial before they are shuffled. A minimizer or edge with more than a
HOT_KEYS-th of all pieces (at least HOT_ROWS) is looked up in a broadcast list, of at most
HOT_KEYS rows, instead of a shuffle, so no task gets the occurrences of a frequent one.

Defined results: a null or empty text has no words and nothing is removed; a text of
fewer words than a window is kept whole; repeated rows repeat each other and go whole
(if they reach a window); texts of any length are processed whole; an empty table gives no
rows; other columns are ignored. Paths that close to a circle stay single edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import KeyFilter, materialize, release
from codeloom.llm.words import joined, run_hashes, word_hashes

WINDOW = 35
SEED = 10
HOT_KEYS, HOT_ROWS = 50_000, 1000
#: A piece's place: its first word and its number of edges in one long.
_EDGES = 16  # low bits for the number of edges
_FIRST = 24  # low bits for the first word where a place orders atoms


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _digests(norm: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Both halves of the digest of each norm[lo:hi], a row for each."""
    each = [hashlib.blake2b(norm[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    return np.frombuffer(b"".join(each), "<i8").reshape(-1, 2)


def paths(text: bytes | None, window: int = WINDOW) -> list[np.ndarray]:
    """Pieces of a text's path: minimizers, both halves of digests, first and last nodes, places."""
    norm, start, end = joined(text or b"")
    n = len(start)
    if n < window:
        return [np.zeros(0, np.int64)] * 6
    seed = min(SEED, window)
    words = word_hashes(norm, start, end)
    h = run_hashes(words, seed)
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    at = order[_sliding_min(rank, window - seed + 1)]
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    edges = np.append(first[1:], n - window + 1) - first
    nodes = run_hashes(words, window - 1).view(np.int64)
    digest = _digests(norm, start[first], end[first + edges + window - 2])
    return [h[at[first]].view(np.int64), digest[:, 0], digest[:, 1], nodes[first], nodes[first + edges], (first << _EDGES) | edges]


_PIECE = ["mz", "a1", "a2", "head", "tail", "place", "key"]


def _batch(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """One batch of the arrays of many texts."""
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _pieces(window: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                got = paths(text.as_py(), window)
                parts.append([*got, np.full(len(got[0]), key.as_py(), np.int64)])
                held += len(got[0])
                if held > 50_000:
                    yield _batch(parts, _PIECE)
                    parts, held = [], 0
        yield _batch(parts, _PIECE)

    return pieces


_EDGE = ["a1", "a2", "head", "tail", "place", "key", "n"]


def _edges(window: int):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every edge of the wanted pieces (place, n) of a text, digested from its words."""
        parts, held = [], 0
        for batch in batches:
            for key, text, wanted in zip(*(batch.column(c) for c in ("key", "text", "wanted")), strict=True):
                norm, start, end = joined(text.as_py() or b"")
                nodes = run_hashes(word_hashes(norm, start, end), window - 1).view(np.int64)
                place, n = (wanted.values.field(c).to_numpy() for c in ("place", "n"))
                first, count = place >> _EDGES, place & ((1 << _EDGES) - 1)
                i = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                digest = _digests(norm, start[i], end[i + window - 1])
                parts.append([digest[:, 0], digest[:, 1], nodes[i], nodes[i + 1], (i << _EDGES) | 1, np.full(len(i), key.as_py(), np.int64), np.repeat(n, count)])
                held += len(i)
                if held > 50_000:
                    yield _batch(parts, _EDGE)
                    parts, held = [], 0
        yield _batch(parts, _EDGE)

    return edges


def _kept(window: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                total, gone, texts = [], [], []
                spans = part.column("spans") if "spans" in part.schema.names else [None] * part.num_rows
                for text, found in zip(part.column("text"), spans, strict=True):
                    words = (text.as_py() or b"").split()
                    if found is not None and found.is_valid and len(found):
                        first, count = (found.values.field(c).to_numpy() for c in ("first", "edges"))
                        step = np.bincount(first, minlength=len(words) + 1) - np.bincount(first + count + window - 1, minlength=len(words) + 1)
                        left = list(compress(words, (np.cumsum(step[:-1]) <= 0).tolist()))
                    else:
                        left = words
                    total.append(len(words))
                    gone.append(len(words) - len(left))
                    texts.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return kept


def _looked_up(rows: DataFrame, known: DataFrame, on: list[str], limit: int) -> DataFrame:
    """Inner join of rows with known (unique by `on`, n: its rows); frequent keys are broadcast, not shuffled."""
    hot = F.broadcast(known.filter(F.col("n") > limit))
    cold = known.filter(F.col("n") <= limit)
    rest = rows.join(hot.select(on), on, "left_anti")
    maybe = KeyFilter(cold, F.struct(*on)).mark(rest, F.struct(*on), "__codeloom_maybe").filter("__codeloom_maybe").drop("__codeloom_maybe")
    return rows.join(hot, on).unionByName(maybe.join(cold, on))


def _runs(joints: DataFrame) -> DataFrame:
    """joints with the atom (h1, h2) that starts each one's run in its text, its distance (off) from there, and whether it is that atom (open).

    In the order of `at` a joint whose predecessor is the row before it is in that one's run.
    Without `at` every joint is a run. Where texts place atoms otherwise runs are shorter, not wrong.
    """
    if "at" not in joints.columns:
        return joints.select("*", F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("open"))
    doc = Window.partitionBy(F.shiftright("at", _FIRST)).orderBy("at", "a1", "a2")
    upto = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = (F.lag("a1").over(doc) == F.col("u1")) & (F.lag("a2").over(doc) == F.col("u2"))
    rows = joints.withColumn("open", ~F.coalesce(before, F.lit(False)))
    rows = rows.withColumn("sum", F.sum(F.when(F.col("open"), 0).otherwise(F.col("pos"))).over(upto))
    last = lambda c: F.last(F.when(F.col("open"), F.col(c)), True).over(upto)
    return rows.select("a1", "a2", "u1", "u2", "pos", last("a1").alias("h1"), last("a2").alias("h2"), (F.col("sum") - last("sum")).alias("off"), "open")


def compacted(atoms: DataFrame) -> DataFrame:
    """(a1, a2, u1, u2, pos) for atoms (a1, a2, head, tail, edges): the nonbranching path of each and its place there.

    An atom follows the one before it if no other ends and no other starts at the node
    between them. Atoms that follow each other in one text (told by `at`, which may be missing)
    are put together to runs first. Pointers of runs to predecessors double their reach in every
    round, and each round is written; runs whose pointer arrives at a path's start leave the work.
    A path that is not at its end loses runs in every round, so what is left after a round that
    takes none goes round in circles.
    """
    at = ["at"] if "at" in atoms.columns else []
    atom = F.struct("a1", "a2", *at)
    ends = atoms.select(F.col("head").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"), atom.alias("next"), F.lit(None).alias("last"))
    ends = ends.unionByName(atoms.select(F.col("tail").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"), F.lit(None).alias("next"), F.struct("a1", "a2", "edges").alias("last")))
    joints = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"), F.first("next", True).alias("next"), F.first("last", True).alias("last"))
    joints = joints.filter("out = 1 AND in = 1").select(F.col("next.a1").alias("a1"), F.col("next.a2").alias("a2"), F.col("last.a1").alias("u1"), F.col("last.a2").alias("u2"), F.col("last.edges").cast("long").alias("pos"), *(f"next.{c}" for c in at))
    runs = materialize(_runs(joints.filter("NOT (a1 = u1 AND a2 = u2)")), "runs")
    starts = materialize(atoms.select("a1", "a2").join(runs.select("a1", "a2"), ["a1", "a2"], "left_anti"), "path-starts")
    of = runs.select(F.col("a1").alias("u1"), F.col("a2").alias("u2"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("off").alias("more"))
    moving = runs.filter("open").select("a1", "a2", "u1", "u2", "pos").join(of, ["u1", "u2"], "left")
    moving = materialize(moving.select("a1", "a2", F.coalesce("g1", "u1").alias("u1"), F.coalesce("g2", "u2").alias("u2"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos")), "run-starts")
    fixed, n = [], moving.count()
    while n:
        every = reduce(DataFrame.unionByName, [moving, *fixed]).select(F.col("a1").alias("u1"), F.col("a2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"), F.col("pos").alias("more"))
        step = materialize(moving.join(every, ["u1", "u2"], "left"), "pointers")
        fixed.append(step.filter("v1 IS NULL").select("a1", "a2", "u1", "u2", "pos"))
        moving = step.filter("v1 IS NOT NULL").select("a1", "a2", F.col("v1").alias("u1"), F.col("v2").alias("u2"), (F.col("pos") + F.col("more")).alias("pos"))
        before, n = n, moving.count()
        if n == before:
            break
    none = F.lit(None).cast("long")
    own = lambda df: df.select("a1", "a2", F.col("a1").alias("u1"), F.col("a2").alias("u2"), F.lit(0).cast("long").alias("pos"))
    known = reduce(DataFrame.unionByName, [moving.select("a1", "a2", none.alias("u1"), none.alias("u2"), none.alias("pos")), *fixed])
    known = known.select(F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"), F.col("pos").alias("more"))
    placed = runs.join(known, ["h1", "h2"]).select("a1", "a2", F.coalesce("v1", "a1").alias("u1"), F.coalesce("v2", "a2").alias("u2"), F.coalesce(F.col("more") + F.col("off"), F.lit(0)).alias("pos"))
    return own(starts).unionByName(placed)


def repeated_spans(rows: DataFrame, window: int = WINDOW, unique: bool = True) -> DataFrame:
    """(key, u1, u2, first, edges) of rows (key, text): where a document runs along a compacted path of repeated edges."""
    pieces = materialize(rows.select("key", "text").mapInArrow(_pieces(window), ", ".join(f"{c} long" for c in _PIECE)), "pieces")
    limit = max(HOT_ROWS, pieces.count() // HOT_KEYS)
    seen = materialize(pieces.groupBy("mz").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-minimizers")
    again = materialize(_looked_up(pieces, seen, ["mz"], limit).drop("n"), "candidates")
    release(pieces)  # the largest table; nothing below reads it

    # Any occurrence may stand for a piece: all firsts of one aggregate come from the same row.
    at = F.shiftleft(F.shiftrightunsigned(F.xxhash64("key"), _FIRST + 1), _FIRST).bitwiseOR(F.least(F.shiftright("place", _EDGES), F.lit((1 << _FIRST) - 1))).alias("at")
    kinds = again.select("*", at).groupBy("mz", "a1", "a2").agg(F.count("*").alias("n"), F.min("at").alias("at"), *(F.first(c).alias(c) for c in ("key", "place", "head", "tail")))
    kinds = materialize(kinds, "kinds")
    least = materialize(kinds.groupBy("mz").agg(F.count("*").alias("n"), F.min("n").alias("least")).filter("n > 1 AND least = 1").drop("least"), "open-minimizers")
    opened = _looked_up(kinds.withColumnRenamed("n", "seen"), least, ["mz"], limit)
    wanted = materialize(opened.groupBy("key").agg(F.collect_list(F.struct("place", F.col("seen").alias("n"))).alias("wanted")), "wanted")
    source = KeyFilter(wanted, F.col("key")).mark(rows.select("key", "text"), F.col("key"), "maybe").filter("maybe")
    if not unique:
        source = source.dropDuplicates(["key"])
    edges = source.join(wanted, "key").select("key", "text", "wanted").mapInArrow(_edges(window), ", ".join(f"{c} long" for c in _EDGE))
    edges = materialize(edges, "edges")
    twice = edges.groupBy("a1", "a2").agg(F.sum("n").alias("n")).filter("n > 1")
    parts = materialize(_looked_up(edges.filter("n = 1").drop("n"), materialize(twice, "repeated-edges"), ["a1", "a2"], limit), "repeated-parts")
    release(edges)

    size = F.col("place").bitwiseAND((1 << _EDGES) - 1).alias("edges")
    whole = kinds.filter("n > 1").select("a1", "a2", "head", "tail", size, "n", "at")
    single = parts.select("*", at).groupBy("a1", "a2").agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.lit(1).cast("long").alias("edges"), F.count("*").alias("n"), F.min("at").alias("at"))
    atoms = materialize(whole.unionByName(single).groupBy("a1", "a2").agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.max("edges").alias("edges"), F.sum("n").alias("n"), F.min("at").alias("at")), "atoms")
    units = materialize(compacted(atoms).join(atoms.select("a1", "a2", "n"), ["a1", "a2"]), "paths")

    found = again.select("a1", "a2", "key", "place").unionByName(parts.select("a1", "a2", "key", "place"))
    placed = _looked_up(found, units, ["a1", "a2"], limit).select("key", "u1", "u2", "pos", "place", F.shiftright("place", _EDGES).alias("first"), size)
    line = placed.groupBy("key", "u1", "u2", (F.col("first") - F.col("pos")).alias("diagonal"))
    line = line.agg(F.min("first").alias("from"), F.max(F.col("first") + F.col("edges")).alias("to"), F.sum("edges").alias("total"), F.collect_set("place").alias("parts"))
    # A line without gaps is one span; otherwise its edges stay apart.
    one = F.array(F.struct(F.col("from").alias("first"), (F.col("to") - F.col("from")).alias("edges")))
    apart = F.transform("parts", lambda x: F.struct(F.shiftright(x, _EDGES).alias("first"), x.bitwiseAND((1 << _EDGES) - 1).alias("edges")))
    return line.select("key", "u1", "u2", F.inline(F.when(F.col("total") == F.col("to") - F.col("from"), one).otherwise(apart)))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_text) of each row: words covered by a window that starts anywhere else are removed.

    window: two words at least.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    # Work is keyed by the id where it identifies the row, else by a hash of id and text;
    # rows that are equal in both have equal results.
    unique = rows.groupBy("id").count().filter("count > 1 or id is null").isEmpty()
    rows = rows.withColumn("key", F.col("id") if unique else F.xxhash64("id", "text"))
    spans = repeated_spans(rows, window, unique).groupBy("key").agg(F.collect_list(F.struct("first", "edges")).alias("spans"))
    spans = materialize(spans, "spans")
    marked = KeyFilter(spans, F.col("key")).mark(rows, F.col("key"), "maybe")
    schema = "id long, n_words long, n_removed long, kept_text string"
    clean = marked.filter("not maybe").select("id", "text").mapInArrow(_kept(window), schema)
    cut = marked.filter("maybe").join(spans, "key", "left").select("id", "text", "spans").mapInArrow(_kept(window), schema)
    return clean.unionByName(cut).withColumnRenamed("id", id_col)


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """without_repeats with the kept text's SHA-256 in place of the text."""
    out = without_repeats(docs, id_col, text_col, window)
    return out.select(id_col, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
h AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS s FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM h) WHERE c > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) FILTER (c.i IS NULL) AS kept, count(c.i) AS n_removed
      FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.i = k.i GROUP BY k.doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON t.doc_id = w.doc_id
"""
