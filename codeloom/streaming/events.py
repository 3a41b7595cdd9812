"""A stream of change events kept as one row for each file: its last event.

Each micro-batch drops events whose id an earlier batch has, is reduced to the last event
of a file (by time, then id) and written with the ids it took. Ids are told apart exactly
in these tables, however late a repeat comes; no watermark drops events. Batches carry
their number, so one that is replayed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.dedupe import first_by
from codeloom.operators.traverse import scratch, written

#: Kinds of events as changes of files.
CHANGE_OF = {"signup": "SOURCE_ADDED", "error": "SOURCE_DELETED", "purchase": "SOURCE_MODIFIED", "click": "CASCADE_UPDATE", "view": "CASCADE_UPDATE"}


def change_events(events: DataFrame) -> DataFrame:
    """Rows of the events table as change events of files."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in CHANGE_OF.items() for x in kv)), F.col("event_type"))
    return events.select(F.col("event_id").cast("long").alias("eventId"), F.col("ts").cast("timestamp").alias("timestamp"), kind.alias("changeType"), F.concat(F.lit("cust/c"), F.col("user_id").cast("string"), F.lit(".java")).alias("file"))


def last_changes(events: DataFrame) -> DataFrame:
    """(file, eventId, changeType, n): the last change of each file and its number of changes."""
    order = F.struct("timestamp", "eventId")
    return events.groupBy("file").agg(F.max_by("eventId", order).alias("eventId"), F.max_by("changeType", order).alias("changeType"), F.max("timestamp").alias("timestamp"), F.count("*").alias("n"))


def run_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Drains a folder of events as a stream and returns last_changes of all of it."""
    folder = scratch(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    # A stream reads folders; of a lone file it reads the folder by that file's name.
    source = reader.option("pathGlobFilter", path.rpartition("/")[2]).parquet(path.rpartition("/")[0]) if single else reader.parquet(path)
    events = change_events(source)

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["eventId"])
        if number > 0:
            earlier = spark.read.schema("eventId long, batch long").parquet(f"{folder}/ids").filter(F.col("batch") < number)
            new = new.join(earlier.select("eventId"), "eventId", "left_anti").select(batch.columns)
        new = written(new)  # of repeated ids in a batch any row may stay, but one
        new.select("eventId").write.mode("overwrite").parquet(f"{folder}/ids/batch={number}")
        last_changes(new).withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    query = events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.schema("file string, eventId long, changeType string, timestamp timestamp, n long").parquet(f"{folder}/batches")
    total = parts.groupBy("file").agg(F.sum("n").alias("n"))
    last = first_by(parts.withColumn("_o", -F.unix_micros("timestamp")).withColumn("_e", -F.col("eventId")).withColumn("_pos", F.struct("_o", "_e")), ["file"], "_pos")
    return last.select("file", "eventId", "changeType").join(total, "file")


__all__ = ["CHANGE_OF", "change_events", "last_changes", "run_stream", "written"]
