"""Anti and semi joins, and repeats, that shuffle rows only where they may have a partner.

Keys meet as hashes and digests, apart from their rows. What that finds becomes a bitmap of
bounded size, and only rows that it may name take part in a join; all others stay where they are.
A bitmap only saves shuffles: with too many keys for it all rows pass, and the result is the same.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.traverse import release, written

#: Most keys that a bitmap pays for, and its most bits (words of 64 bits are broadcast: 2**20 rows).
FEW, MAX_BITS = 2**23, 26
#: Keys that are not worth a bitmap of the rows that they meet.
THIN = 2**16
#: Keys of a bitmap of most bits beyond which several bits a key fill it more than they tell.
CROWDED = 2**24
#: Keys that a task of a join of two large sides takes, however many there are.
TASK_KEYS = 2**19


def digest(on: list[str]) -> Column:
    """20 bytes for the values of text columns in their order; null if one is null, which equals nothing."""
    return F.unhex(F.sha1(F.concat(*(x for c in on for x in (F.length(c).cast("string"), F.lit(":"), F.col(c))))))


def marked(df: DataFrame, hashed: Column, keys: DataFrame, count: int, name: str = "_may") -> DataFrame:
    """df with a boolean column: false where the 64-bit hash is surely none of those in _h of keys, about `count` of them.

    The hash's first bits name a word, its last ones bits of the word: three, which let far fewer other
    hashes pass than one does while words are not crowded.
    """
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(64 * (count + 1)))))
    per_key = 3 if count <= CROWDED else 1
    word = lambda h: F.shiftrightunsigned(h, 70 - bits)
    mask = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(_p, {6 * i}) & 63 as int))" for i in range(per_key))
    words = keys.select(F.col("_h").alias("_p")).groupBy(word(F.col("_p")).alias("_w")).agg(F.bit_or(F.expr(mask)).alias("_bits"))
    out = df.withColumn("_p", hashed).withColumn("_w", word(F.col("_p"))).join(F.broadcast(words), "_w", "left")
    return out.withColumn(name, F.coalesce(F.expr(f"(_bits & ({mask})) = ({mask})"), F.lit(False))).drop("_w", "_p", "_bits")


def possible(df: DataFrame, hashed: Column, keys: DataFrame, count: int) -> DataFrame:
    """df's rows whose hash may be among those of keys."""
    return marked(df, hashed, keys, count).filter("_may").drop("_may")


def _pairs(df: DataFrame, on: list[str]) -> DataFrame:
    """(_h, _d): hash and digest of the columns `on`, of rows without a null in them."""
    return df.select(F.xxhash64(*on).alias("_h"), digest(on).alias("_d")).filter("_d IS NOT NULL")


def thinned(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """keys without most of those that no row of df has, and what was written for that, which goes once nothing reads it.

    Where df is small, its bitmap thins out the keys. Where both are large, their hashes alone meet first.
    """
    h, keys, df = F.xxhash64(*on), keys.select(on), df.select(on)
    n_keys = keys.count()
    if n_keys <= min(FEW, THIN):
        return (keys if n_keys else keys.limit(0)), None
    n = df.count()
    if n < n_keys and n <= FEW:
        spent = written(df.select(h.alias("_h")))
    elif n_keys > FEW:
        spent = written(df.select(h.alias("_h")).join(keys.select(h.alias("_h")), "_h", "left_semi").distinct())
        n = spent.count()
    else:
        return keys, None
    return (possible(keys, h, spent, n) if 0 < n <= FEW else keys if n else keys.limit(0)), spent


class _Met(NamedTuple):
    """What is known of rows and keys: those with a hash in `may` may be in keys; of these, those with none in `odd` surely are. If odd is None, only the digests of `hit` tell."""

    on: list[str]
    may: DataFrame
    n_may: int
    odd: DataFrame | None
    n_odd: int
    hit: DataFrame

    def marks(self, rows: DataFrame, tag: str) -> tuple[DataFrame, Column, Column]:
        """rows with marks, and whether a row is surely in keys, or only digests tell; rows with a null are in none."""
        h, named = F.xxhash64(*self.on), F.concat(*self.on).isNotNull()
        rows = marked(rows, h, self.may, self.n_may, f"_may{tag}")
        may = F.col(f"_may{tag}") & named
        if self.odd is None:
            return rows, F.lit(False), may
        if self.n_odd == 0:
            return rows, may, F.lit(False)
        rows = marked(rows, h, self.odd, self.n_odd, f"_odd{tag}")
        return rows, may & ~F.col(f"_odd{tag}"), may & F.col(f"_odd{tag}")


def _met(df: DataFrame, keys: DataFrame, on: list[str], known: bool = False) -> _Met | None:
    """None if no row of df is in keys.

    Each value that the keys' bitmap lets through meets their digests once, apart from its rows;
    values that are no keys make the second bitmap, so rows in the first alone need no join.
    """
    keys, spent = (keys, None) if known else thinned(df, keys, on)
    h = F.xxhash64(*on)
    hashes = written(keys.filter(F.concat(*on).isNotNull()).select(h.alias("_h")))
    n, out = hashes.count(), None
    if n > FEW:
        release(hashes)
        hit = written(_pairs(df, on).join(_pairs(keys, on).select("_d"), "_d", "left_semi"))
        if n := hit.count():
            out = _Met(on, hit, n, None, 0, hit)
    elif n:
        each = written(possible(_pairs(df, on), F.col("_h"), hashes, n).groupBy("_d").agg(F.min("_h").alias("_h")))
        if n_each := each.count():
            # Of the keys only those that these values may be are digested.
            same = _pairs(possible(keys, h, each, n_each) if n_each <= FEW else keys, on).select("_d", F.lit(True).alias("_hit")).distinct()
            told = written(each.join(same, "_d", "left").select("_h", "_d", F.coalesce("_hit", F.lit(False)).alias("_hit")))
            count = {r["_hit"]: r["count"] for r in told.groupBy("_hit").count().collect()}
            if count.get(True):
                out = _Met(on, hashes, n, told.filter("NOT _hit").select("_h"), count.get(False, 0), told.filter("_hit").select("_h", "_d"))
        release(each)
    if spent is not None:
        release(spent)
    return out


def _packed(df: DataFrame, on: list[str]) -> DataFrame:
    """df with its first column of `on` as _head and _tail: without the SHA-1 in hex that ends it, and that as 20 bytes, or as a whole and no bytes; _rest tells the others, null if a value is null."""
    c = F.col(on[0])
    last = F.right(c, F.lit(40))
    hexed = last.rlike(r"^[0-9a-f]{40}\z")
    out = df.withColumns({"_head": F.when(hexed, F.substring(c, F.lit(1), F.length(c) - 40)).otherwise(c), "_tail": F.when(hexed, F.unhex(last)).otherwise(F.lit(b""))})
    # An empty part of the id keeps Spark from dropping a constant _rest from the join, which would then shuffle again.
    return out.withColumn("_rest", F.concat(F.substring("_head", 1, 0), *(x for k in on[1:] for x in (F.length(k).cast("string"), F.lit(":"), F.col(k))))).drop(on[0])


def apart(df: DataFrame, keys: DataFrame, on: list[str], n_keys: int) -> DataFrame:
    """df without the rows of about n_keys keys: both meet by the columns themselves, and each is shuffled once.

    The first column, an id, travels packed. Tasks are told by the number of keys, which are hashed; rows are not sorted.
    The join is an outer one, as Spark pushes anti joins below unions and repartitions, which shuffles again.
    """
    by = ["_head", "_tail", "_rest"]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_keys // TASK_KEYS))
    # A key with a null gets a tail that no row has: so none is null, and Spark makes no filter of its own, which would build ids twice.
    tail = F.when(F.col("_rest").isNull(), F.lit(b"-")).otherwise(F.coalesce("_tail", F.lit(b"")))
    gone = _packed(keys.select(on), on).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("_head", "_rest")), tail.alias("_tail"), F.lit(True).alias("_gone"))
    met = _packed(df, on).repartition(tasks, *by).join(gone.repartition(tasks, *by).hint("shuffle_hash"), by, "left")
    return met.filter("_gone IS NULL").withColumn(on[0], F.concat("_head", F.lower(F.hex("_tail")))).select(df.columns)


def less(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """As without, for keys of which most name a row, so that nothing is gained by looking first whether they do."""
    n = keys.count()
    return apart(df, keys, on, n) if n > FEW else without(df, (keys, on), known=True) if n else df


def without(df: DataFrame, *conditions: tuple[DataFrame, list[str]], known: bool = False) -> DataFrame:
    """df without the rows that any of the conditions (keys, columns) names: left anti joins. It is df itself if they name none.

    known: the keys are at most FEW, and thinning them out is not worth while.
    """
    found = [m for keys, on in conditions if (m := _met(df, keys, on, known))]
    if not found:
        return df
    if len(found) == 1 and found[0].odd is None:
        # Many rows go: those that stay may be fewer. Rows with a null key stay too.
        on, hit, n = found[0].on, found[0].hit, found[0].n_may
        named = df.filter(F.concat(*on).isNotNull())
        if named.count() - n <= n:
            left = written(_pairs(named, on).join(hit.select("_d"), "_d", "left_anti"))
            stay = possible(named, F.xxhash64(*on), left, left.count()).withColumn("_d", digest(on)).join(left.select("_d"), "_d", "left_semi")
            return stay.select(df.columns).unionByName(df.filter(F.concat(*on).isNull()))
    rows, surely, unsure, closed = df, F.lit(False), F.lit(False), True
    for i, m in enumerate(found):
        rows, gone, open_ = m.marks(rows, str(i))
        surely, unsure, closed = surely | gone, unsure | open_, closed and m.odd is not None and m.n_odd == 0
    rows = rows.filter(~surely)
    if closed:
        return rows.select(df.columns)
    out = rows.filter(unsure)
    for m in found:
        out = out.withColumn("_d", digest(m.on)).join(m.hit.select("_d"), "_d", "left_anti")
    return rows.filter(~unsure).select(df.columns).unionByName(out.select(df.columns))


def within(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df's rows whose columns `on` equal those of a row of keys: a left semi join."""
    m = _met(df, keys, on)
    if m is None:
        return df.limit(0)
    rows, surely, unsure = m.marks(df, "")
    out = rows.filter(unsure).withColumn("_d", digest(on)).join(m.hit.select("_d"), "_d", "left_semi").select(df.columns)
    if m.odd is None:
        return out
    sure = rows.filter(surely).select(df.columns)
    return sure if m.n_odd == 0 else sure.unionByName(out)


def repeated(df: DataFrame, *hashes: Column) -> tuple[DataFrame, int]:
    """(_h) of the hashes that more than one row has, and their number; null hashes are none."""
    each = df.select(F.explode(F.array(*hashes)).alias("_h")).filter("_h IS NOT NULL")
    found = written(each.groupBy("_h").count().filter("count > 1").select("_h"))
    return found, found.count()
