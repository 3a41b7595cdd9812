"""Keep-first deduplication, by an explicit position and with map-side aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.ids import has_text, is_blank


def first_by(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The row with the smallest pos of each key. min_by combines before the shuffle, so a hot key is no hot task.

    A set, always empty, is collected beside it: with that a task hashes its rows while their keys
    are few, where min_by of structs alone sorts all rows first.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(pos, *[c for c in rest if c != pos and not dict(df.dtypes)[c].startswith("map")]))
    best = df.groupBy(*keys).agg(row.alias("_row"), F.collect_set(F.lit(None).cast("int")).alias("_none")).filter("size(_none) = 0")
    return best.select(*keys, "_row.*").select(df.columns)


def first_by_id(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Keep-first by id; rows with a blank id are all kept."""
    return first_by(df.filter(has_text(F.col("id"))), ["id"], pos).unionByName(df.filter(is_blank(F.col("id"))))


def edges(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Keep-first of edges by id or by (from, to, type), in the order of pos.

    An edge is dropped if a kept one before it has its id or its ends and type. Blank ids are
    no ids: such edges are compared by ends and type alone; null ends and types equal empty
    ones. Where ids are functions of ends and type (checked by one aggregation) that is one
    keep-first. Otherwise rounds keep the edges that are first both by id and by ends and
    type, and drop what shares either with them, until no edge is left; the number of rounds
    is that of the longest chain of edges that each await the one before.
    """
    from codeloom.operators.keys import marked, repeated
    from codeloom.operators.traverse import stored, written

    # Rows that share neither id nor ends and type with another stay; only the others are compared.
    df = df if stored(df) else written(df)
    by_key = F.xxhash64(F.lit("key"), *(F.coalesce(F.col(c), F.lit("")) for c in ("fromNodeId", "toNodeId", "relationshipType")))
    by_id = F.when(has_text(F.col("id")), F.xxhash64(F.lit("id"), F.col("id")))
    again, n = repeated(df, by_key, by_id)
    if n == 0:
        return df
    both = marked(marked(df, by_key, again, n, "_key_again"), F.coalesce(by_id, by_key), again, n, "_id_again")
    alone = both.filter("NOT (_key_again OR _id_again)").select(df.columns)
    return alone.unionByName(written(_compared(both.filter("_key_again OR _id_again").select(df.columns), pos)))


def _compared(df: DataFrame, pos: str) -> DataFrame:
    """edges() of rows that are compared each with each."""
    names, key = df.columns, ["_from", "_to", "_type"]
    blank_as_empty = {k: F.coalesce(F.col(c), F.lit("")) for k, c in zip(key, ["fromNodeId", "toNodeId", "relationshipType"], strict=True)}
    keyed = df.withColumns(blank_as_empty).withColumn("_id", F.when(has_text(F.col("id")), F.col("id")))
    from codeloom.operators.traverse import written

    keyed = written(keyed)  # read by the two checks and by what follows
    hashed = keyed.withColumn("_k", F.xxhash64(*key))
    plain = hashed.filter("_id IS NOT NULL").groupBy("_id").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).filter("lo < hi").isEmpty()
    plain = plain and keyed.groupBy(*key).agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).filter("lo < hi").isEmpty()
    if plain:
        return first_by(keyed.drop("_id"), key, pos).select(names)
    # Rows of equal pos stay apart by a number that is written once.
    every = written(keyed.withColumn("_o", F.struct(F.col(pos).alias("pos"), F.monotonically_increasing_id().alias("n"))))
    rest, kept = every.select("_id", *key, "_o"), None
    while not rest.isEmpty():
        by_id = rest.filter("_id IS NOT NULL").groupBy("_id").agg(F.min("_o").alias("_o")).select("_o")
        by_key = rest.groupBy(*key).agg(F.min("_o").alias("_o"), F.min_by("_id", "_o").alias("_id"))
        with_id = by_key.filter("_id IS NOT NULL").join(by_id, "_o", "left_semi")
        new = written(with_id.unionByName(by_key.filter("_id IS NULL")))
        kept = new.select("_o") if kept is None else kept.unionByName(new.select("_o"))
        left = rest.join(new.select(*key), key, "left_anti").join(new.select("_id"), "_id", "left_anti")
        rest = written(left.select("_id", *key, "_o"))
    return every.join(kept, "_o", "left_semi").select(names)
