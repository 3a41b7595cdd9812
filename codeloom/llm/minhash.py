"""Near-duplicate detection with b-bit MinHash, confirmed on full shingle sets.

1. Every document gets the set of its distinct word shingles, as 64-bit hashes, and
   from it BANDS * ROWS minima. Bands of ROWS minima give candidate buckets; of each
   minimum only BITS mixed low bits are kept, packed into one short binary signature.
2. Documents with equal sets form a class, represented by its smallest id. All later
   work is on representatives, so thousands of copies cost one row.
3. Representatives that share a bucket are candidates. A bucket is known by its smallest
   member, its star, so a pair that shares several buckets is met once or a few times, and
   buckets do not run together. First every member is compared with its star: similarity is
   estimated from the bits (corrected for chance collisions), and exact sets decide within
   MARGIN of the threshold. Components over these links settle most buckets.
4. Where a bucket's members are still in several components, the members outside the
   star's component are compared with all members of other components. Both are dealt in
   blocks; a task gets two blocks and returns a spanning forest of the links it confirmed,
   at most as many as its documents.
5. Components over all confirmed links give the groups.

A pair of similarity 0.85 shares none of the 36 bands with probability 9e-7, and its
estimate falls below the threshold by MARGIN, five standard deviations, with 3e-7.

Defined results: null and empty texts and texts without words have an empty set and
stay alone; a text with fewer words than a shingle is one shingle; a null id is grouped
with nothing and stays; rows of one id share their links whatever their texts; an empty
table gives no rows; other columns are ignored by `near_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import KeyFilter, components, materialize, without_keys
from codeloom.llm.words import joined, mix, run_hashes, word_hashes

SHINGLE = 5
BANDS, ROWS, BITS = 36, 7, 2
MARGIN = 0.14
BLOCK = 512  # members of a bucket compared at once with as many others,
BLOCK_SHINGLES = 4_000_000  # or fewer, if their sets hold more than this together

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)[:, None]


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased."""
    norm, start, end = joined((text or b"").lower())
    if not len(start):
        return np.zeros(0, np.uint64)
    h = word_hashes(norm, start, end)
    return np.unique(run_hashes(h, min(k, len(h))))


def minima(shingles: np.ndarray) -> np.ndarray:
    x = mix(shingles).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(best, (x[None, i : i + 1024] * _MUL + _ADD).min(axis=1), out=best)
    return best


def signature(best: np.ndarray) -> bytes:
    """BITS mixed low bits of every minimum, packed."""
    low = (mix(best.astype(np.uint64) + np.arange(len(best), dtype=np.uint64) * np.uint64(0x1F1F1F1F1)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return np.packbits((low[:, None] >> np.arange(BITS, dtype=np.uint8)) & 1).tobytes()


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) ^ rows[:, r])
    return key.view(np.int64)


_SIGNED = "id long, n_shingles long, digest binary, sig binary, bands array<long>"


def _sign(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, digest, sig, bands = [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, k)
                    n.append(len(s))
                    digest.append(_digest(s))
                    best = minima(s) if len(s) else None
                    sig.append(signature(best) if len(s) else None)
                    bands.append(band_keys(best) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n_shingles", "digest", "sig", "bands"])

    return sign


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of all pairs of packed signatures: matching minima by bit counts, less chance matches."""
    k, chance = BANDS * ROWS, 1 / (1 << BITS)
    x = a[:, None, :] ^ b[None, :, :]
    differs = x.copy()
    for s in range(1, BITS):
        differs |= x >> np.uint64(s)
    lowest = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    same = k - np.bitwise_count(differs & lowest).sum(axis=2, dtype=np.int64)
    return (same / k - chance) / (1 - chance)


def _unpacked(packed: list[bytes]) -> np.ndarray:
    width = -(-BANDS * ROWS * BITS // 64) * 8
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in packed), ">u8").reshape(len(packed), -1).astype(np.uint64)


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return den * shared >= num * (len(a) + len(b) - shared)


def _star(num: int, den: int):
    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by star and block, each block's star first; holds that star and one member."""
        key, own, sig = None, None, None
        for batch in batches:
            found = []
            for cluster, block, node, packed, shingles in zip(*(batch.column(c) for c in ("cluster", "block", "id", "sig", "shingles")), strict=True):
                cluster, block, node, packed = cluster.as_py(), block.as_py(), node.as_py(), packed.as_py()
                these = np.frombuffer(shingles.as_py(), np.uint64)
                if (cluster, block) != key:
                    if node != cluster:
                        raise ValueError("a block without its star")
                    key, own, sig = (cluster, block), these, _unpacked([packed])
                elif den * min(len(own), len(these)) >= num * max(len(own), len(these)) and estimates(sig, _unpacked([packed]))[0, 0] >= num / den - MARGIN and _similar(own, these, num, den):
                    found.append((cluster, node))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return star


def _links(ids: list[int], labels: list[int], side: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs across the sides with den * intersection >= num * union; equal labels are linked already."""
    size = np.array([len(s) for s in sets])
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    head: dict[int, int] = {}
    up = [head.setdefault(label, i) for i, label in enumerate(labels)]

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i in range(0, len(first), 64):
        rows = first[i : i + 64]
        like = estimates(sigs[rows], sigs[second])
        ratio = den * np.minimum(size[rows][:, None], size[second][None, :]) >= num * np.maximum(size[rows][:, None], size[second][None, :])
        x, y = np.nonzero((like >= num / den - MARGIN) & ratio)
        for p in np.argsort(-like[x, y], kind="stable"):  # likely links first: fewer pairs stay to be confirmed
            u, v = int(rows[x[p]]), int(second[y[p]])
            ru, rv = root(u), root(v)
            if ru != rv and _similar(sets[u], sets[v], num, den):
                up[max(ru, rv)] = min(ru, rv)
                out.append((ids[u], ids[v]))
    return out


def _compare(num: int, den: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by block pair; holds one block pair at a time."""
        held, key = [], None

        def links():
            sets = [np.frombuffer(r[4], np.uint64) for r in held]
            found = _links([r[0] for r in held], [r[1] for r in held], np.array([r[2] for r in held]), _unpacked([r[3] for r in held]), sets, num, den)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c) for c in ("cluster", "block_a", "block_b", "id", "label", "side", "sig", "shingles")]
            for row in zip(*cols, strict=True):
                cluster, x, y, *row = (v.as_py() for v in row)
                if (cluster, x, y) != key:
                    if len(held) > 1:
                        yield links()
                    held, key = [], (cluster, x, y)
                held.append(row)
        if len(held) > 1:
            yield links()

    return compare


def stars(reps: DataFrame) -> DataFrame:
    """(cluster, id): the stars of the buckets that a representative (id, bands) shares with others; a star has its own row."""
    member = reps.select("id", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.min("id").alias("cluster"), F.max("id").alias("last")).filter("cluster < last")
    return member.join(shared.select("bucket", "cluster"), "bucket").select("cluster", "id").distinct()


def _blocks(count, shingles):
    return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _block(blocks: str):
    return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (85, 100), shingle: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row; links have den * intersection >= num * union.

    similarity: (num, den). The bands are laid out for 0.8 or more: at 0.8 a pair is
    missed with probability 2e-4, at 0.85 with 9e-7.
    """
    num, den = similarity
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    signed = materialize(rows.mapInArrow(_sign(shingle), _SIGNED), "signatures")
    classes = materialize(
        signed.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep")), "classes"
    )
    reps = signed.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi")

    weight = signed.filter("digest is not null").groupBy("id").agg(F.max("n_shingles").alias("n"))
    star = materialize(stars(reps).join(weight, "id"), "stars")
    ids = star.select("id").distinct()
    near = KeyFilter(ids, F.col("id")).mark(rows, F.col("id"), "maybe").filter("maybe").select("id", "text")
    own = near.join(ids, "id", "left_semi").mapInArrow(_with_sets(shingle), "id long, digest binary, sig binary, shingles binary").filter("digest is not null")
    # Rows of one id may have several texts; the same text once is enough.
    sets = materialize((own.dropDuplicates(["id", "digest"]) if _repeated(rows) else own).drop("digest"), "sets")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    # Every member with its star, which stands first in each block of its members.
    sizes = star.groupBy("cluster").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    placed = star.join(sizes, "cluster").withColumn("own", F.col("id") == F.col("cluster"))
    placed = placed.select("cluster", "id", "own", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block("blocks")))).alias("block"))
    dealt = placed.join(sets, "id").repartition(n, "cluster", "block").sortWithinPartitions("cluster", "block", F.desc("own"))
    links = materialize(dealt.select("cluster", "block", "id", "sig", "shingles").mapInArrow(_star(num, den), "a long, b long"), "star-links")
    label = materialize(components(links).select(F.col("node").alias("id"), "label"), "star-labels")

    # Members outside their star's component, with all members of other components.
    named = star.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    heads = named.filter("id = cluster").select("cluster", F.col("label").alias("star_label"))
    named = materialize(named.join(heads, "cluster").withColumn("odd", F.col("label") != F.col("star_label")).drop("star_label"), "members")
    sizes = named.groupBy("cluster").agg(
        F.count_if("odd").alias("odds"), _blocks(F.count_if("odd"), F.sum(F.when(F.col("odd"), F.col("n")).otherwise(0))).alias("blocks_a"), _blocks(F.count("*"), F.sum("n")).alias("blocks_b"),
    ).filter("odds > 0")
    open_rows = named.join(sizes, "cluster")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    side_a = open_rows.filter("odd").select("cluster", "id", "label", F.lit(0).alias("side"), _block("blocks_a").alias("block_a"), every("blocks_b").alias("block_b"))
    side_b = open_rows.select("cluster", "id", "label", F.lit(1).alias("side"), every("blocks_a").alias("block_a"), _block("blocks_b").alias("block_b"))
    dealt = side_a.unionByName(side_b).join(sets, "id").repartition(n, "cluster", "block_a", "block_b").sortWithinPartitions("cluster", "block_a", "block_b")
    more = materialize(dealt.mapInArrow(_compare(num, den), "a long, b long"), "links")
    label = components(links.unionByName(more)).select(F.col("node").alias("rep"), "label")

    named = classes.join(label, "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    out = signed.select("id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def _repeated(rows: DataFrame) -> bool:
    return not rows.groupBy("id").count().filter("count > 1 and id is not null").isEmpty()


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _with_sets(k: int):
    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t.as_py(), k) for t in part.column("text")]
                columns = [pa.array([f(s) for s in sets], pa.binary()) for f in (_digest, lambda s: signature(minima(s)) if len(s) else None, lambda s: s.tobytes())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "digest", "sig", "shingles"])

    return with_sets


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one row of every near-duplicate group: the smallest id, once."""
    dropped = near_duplicates(docs, id_col, text_col, similarity).filter("not kept").select(F.col(id_col).alias("_id"))
    dropped = materialize(dropped.distinct(), "dropped")
    kept = without_keys(docs, dropped, F.col(id_col).cast("long"))
    if not _repeated(docs.select(F.col(id_col).cast("long").alias("id"))):
        return kept
    lone = kept.filter(F.col(id_col).isNull())
    return lone.unionByName(kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
