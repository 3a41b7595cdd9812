"""Exact deduplication over a log-structured merge index; DataFrame operations only.

Batches of documents become memtables. Flushing a memtable aggregates it to one row a
digest and appends a run: sorted by digest within digest ranges. Compaction merges runs
and keeps the smallest rank of a digest (rank: the id, or its negation when the largest
id stays) and how many rows it stands for.

Every run has filters. A bitmap of at most 2**25 bits goes to the tasks that probe the
run, so that rows it surely does not hold are not shuffled; a bitmap that is more than
half full is left aside, as it would drop little. Parquet's Bloom filters on the digest
column let `find` skip the row groups that lack the few digests it is asked for. Both
only save work: probes end in a join on the digest. Every hit's bytes are then compared
with those of the row that stays. Rows that share a digest but not the text are grouped
anew by their whole text, so a weak digest costs time, never results.

Hot groups: flushing aggregates before it shuffles. A digest that stands for more than a
HOT_DIGESTS-th of all rows (at least COMPARE_ROWS) is dealt over salts before any text is
shuffled; there are at most HOT_DIGESTS of them, so their list is broadcast.

Defined results: a null text counts as empty; a null id never stays unless its group
has no other; repeated rows are members like others; an empty table gives no rows;
other columns of the input are ignored by `duplicates`, kept by `deduplicated` and `unseen`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import KeyFilter, materialize, scratch_dir, without_keys

COMPARE_ROWS = 512
HOT_DIGESTS = 50_000
MEMTABLES = 4
_BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": "1048576"}


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class Run:
    """A sorted run of (digest, rank, n) and the bitmap of its digests, built when it is first probed."""

    def __init__(self, spark, path: str):
        self.table = spark.read.schema("digest binary, rank long, n long").parquet(path)
        self.path, self._bitmap = path, None

    def candidates(self, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """rows (with a digest) that the run may hold, and those that it surely does not (None: not told apart)."""
        if self._bitmap is None:
            self._bitmap = KeyFilter(self.table, F.col("digest"))
        if 2 * self._bitmap.count > 1 << self._bitmap.bits:
            return rows, None
        marked = self._bitmap.mark(rows, F.col("digest"), "__codeloom_maybe")
        return marked.filter("__codeloom_maybe").drop("__codeloom_maybe"), marked.filter("not __codeloom_maybe").drop("__codeloom_maybe")


class DigestIndex:
    """Sorted runs under one folder; rank orders who stays, smallest first."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path, self.written = spark, path or f"{scratch_dir(spark)}/digest-index", 0
        self.runs: list[Run] = []

    def _append(self, table: DataFrame) -> Run:
        path = f"{self.path}/run-{self.written}"
        table.select("digest", "rank", "n").write.options(**_BLOOM).parquet(path)
        self.written += 1
        return Run(self.spark, path)

    def flush(self, rows: DataFrame, memtables: int = 1) -> None:
        """Appends runs of (digest, rank): one for each of `memtables` slices by a hash of the rank."""
        for i in range(memtables):
            part = rows.filter(F.pmod(F.xxhash64("rank"), F.lit(memtables)) == i) if memtables > 1 else rows
            run = part.groupBy("digest").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
            self.runs.append(self._append(run.sortWithinPartitions("digest")))

    def compact(self) -> Run:
        """Merges all runs into one, which replaces them, and returns it."""
        every = self.spark.read.schema("digest binary, rank long, n long").parquet(*(r.path for r in self.runs))
        merged = every.groupBy("digest").agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))
        self.runs = [self._append(merged.sortWithinPartitions("digest"))]
        return self.runs[0]

    def repeated(self) -> Run:
        """The digests of a compacted index that stand for several rows, as a run of their own."""
        return self._append(self.runs[0].table.filter("n > 1").sortWithinPartitions("digest"))

    def find(self, digests: list[bytes]) -> DataFrame:
        """(digest, rank, n) of a few digests; opens only row groups whose statistics and Bloom filters allow them."""
        wanted = F.lit(False)
        for d in digests:
            wanted = wanted | (F.col("digest") == F.lit(bytearray(d)))
        parts = [r.table.filter(wanted) for r in self.runs]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return found.groupBy("digest").agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))

    def probe(self, rows: DataFrame) -> DataFrame:
        """The rows (with a digest) that some run holds, with the smallest rank as `known`, once for each run that does."""
        hits = []
        for run in self.runs:
            maybe, _ = run.candidates(rows)
            hits.append(maybe.join(run.table.select("digest", F.col("rank").alias("known")), "digest"))
        out = hits[0]
        for h in hits[1:]:
            out = out.unionByName(h)
        return out


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest=sha256_digest) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Equal texts are identical ones; `keep` says whether the largest or smallest id stays.
    Of rows with the same id and text, one is kept.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep}")
    sign = -1 if keep == "largest" else 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.select("id", (F.col("id") * sign).alias("rank"), digest(F.col("text")).alias("digest"), "text")

    index = DigestIndex(docs.sparkSession)
    index.flush(materialize(rows.select("digest", "rank"), "digests"), MEMTABLES)
    index.compact()
    repeated = index.repeated()
    maybe, alone = repeated.candidates(rows)
    shared = repeated.table

    # Only texts that may have copies are shuffled, hot ones over salts.
    total = index.runs[0].table.agg(F.sum("n").alias("n")).first()["n"] or 0
    limit = max(COMPARE_ROWS, total // HOT_DIGESTS)
    salts = F.ceil(F.col("n") / limit).cast("int")
    hot = F.broadcast(shared.filter(F.col("n") > limit).select("digest", salts.alias("salts")))
    maybe = maybe.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("id", "text"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    group = shared.select("digest", F.col("rank").alias("keep_rank"), F.col("n").alias("copies"), salts.alias("salts")).select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    maybe = materialize(maybe.join(group, ["digest", "salt"], "left"), "hits")
    # One row a digest needs no comparison: it is its own group.
    single = maybe.filter("keep_rank is null and salts is null").select("id", "text")
    single = single if alone is None else single.unionByName(alone.select("id", "text"))
    single = single.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.sha2("text", 256).alias("text_sha256"))
    # Byte verification: the keeper's text goes to each of the group's salts.
    member = maybe.filter("salts is not null")
    keeper = member.filter("rank <=> keep_rank").groupBy("digest").agg(F.min("text").alias("keeper_text"), F.max("salts").alias("salts"))
    keeper = keeper.select("digest", "keeper_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    checked = materialize(
        member.join(keeper, ["digest", "salt"]).select(
            "id", "digest", "rank", "keep_rank", "copies", F.sha2("text", 256).alias("text_sha256"),
            (F.col("text") == F.col("keeper_text")).alias("same"),
            F.when(F.col("text") != F.col("keeper_text"), F.col("text")).alias("other"),
        ), "verified"
    )
    odd = checked.filter("not same")
    if odd.isEmpty():
        # What the index says of a digest holds for its text.
        found = single.unionByName(checked.select("id", (F.col("keep_rank") * sign).alias("keep_id"), F.col("copies").alias("group_size"), "text_sha256"))
    else:
        size = checked.filter("same").groupBy("digest").agg(F.count("*").alias("group_size"), F.min("rank").alias("best"))
        same = checked.filter("same").join(size, "digest").select("id", (F.col("best") * sign).alias("keep_id"), "group_size", "text_sha256")
        odd_size = odd.groupBy("digest", "other").agg(F.count("*").alias("group_size"), F.min("rank").alias("best"))
        other = odd.join(odd_size, ["digest", "other"]).select("id", (F.col("best") * sign).alias("keep_id"), "group_size", "text_sha256")
        found = single.unionByName(same).unionByName(other)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _row_key(row_id: Column, sha: Column) -> Column:
    return F.concat(F.coalesce(row_id.cast("long").cast("string"), F.lit("-")), F.lit(":"), sha)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """docs without the rows that duplicates() drops; of rows with the same id and text one stays.

    Rows are told apart by id and text, so only dropped rows are shuffled, and no group of
    copies meets in one task.
    """
    found = materialize(duplicates(docs, id_col, text_col, keep).filter("group_size > 1"), "copies")
    found = found.select("kept", _row_key(F.col(id_col), F.col("text_sha256")).alias("gone"))
    key = _row_key(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    left = without_keys(docs, found.filter("not kept").select("gone").distinct(), key)
    repeated = materialize(found.filter("kept").groupBy("gone").count().filter("count > 1").select("gone"), "repeated-rows")
    if repeated.isEmpty():
        return left
    keyed = left.withColumn("__codeloom_key", key)
    again = KeyFilter(repeated, F.col("gone")).mark(keyed, F.col("__codeloom_key"), "__codeloom_maybe").filter("__codeloom_maybe")
    once = again.join(repeated, F.col("__codeloom_key") == F.col("gone"), "left_semi").dropDuplicates(["__codeloom_key"])
    return without_keys(left, repeated, key).unionByName(once.select(docs.columns))


def unseen(batch: DataFrame, stored: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest=sha256_digest) -> DataFrame:
    """The rows of a later batch whose text no row of `stored` has; index: over `stored`, its ranks by `keep`.

    The runs are probed through their filters; hits are compared with all stored texts of
    their digest's kept id. A hit with another text is looked for among all stored texts.
    """
    sign = -1 if keep == "largest" else 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = batch.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select("id", "text", digest(F.col("text")).alias("digest"))
    hits = materialize(index.probe(rows).select("id", "digest", "text", (F.col("known") * sign).alias("known")), "probed")
    ids = hits.select(F.col("known").alias("id")).distinct()
    kept = stored.select(F.col(id_col).cast("long").alias("id"), text.alias("stored_text"))
    kept = KeyFilter(ids, F.col("id")).mark(kept, F.col("id"), "__codeloom_maybe").filter("__codeloom_maybe").join(ids, "id", "left_semi")
    compared = hits.join(kept.withColumnRenamed("id", "known"), "known", "left").withColumn("same", F.coalesce(F.col("text") == F.col("stored_text"), F.lit(False)))
    verdict = compared.groupBy("id", "digest", F.sha2("text", 256).alias("sha")).agg(F.max("same").alias("same"), F.first("text").alias("text"))
    verdict = materialize(verdict, "compared")
    odd = verdict.filter("not same").select("id", "sha", "text")
    texts = stored.select(text.alias("text"))
    elsewhere = odd.join(texts, "text", "left_semi") if not odd.isEmpty() else odd
    seen = verdict.filter("same").select("id", "sha").unionByName(elsewhere.select("id", "sha"))
    gone = materialize(seen.select(_row_key(F.col("id"), F.col("sha")).alias("gone")).distinct(), "seen")
    return without_keys(batch, gone, _row_key(F.col(id_col), F.sha2(text, 256)))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
