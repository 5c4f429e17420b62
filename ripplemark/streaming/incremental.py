"""Tables that grow: counts by a stream over files as they arrive, and batches merged once each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.runtime import _STAGED, shared_dir


def daily_counts(spark: SparkSession, path: str, at: str, kind: str, key: str, late: str = "40 days") -> DataFrame:
    """(day, kind, events) of all files at `path` that are there now; a repeated key within `late` counts once.

    Structured Streaming over the folder: copies are dropped within the watermark, days are tumbling windows. State and
    progress are kept in the shared folder, so a restarted stream goes on where it was."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _STAGED.append(base)
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():  # a stream reads folders
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    rows = reader.parquet(path).withColumn("_at", F.col(at).cast("timestamp"))
    once = rows.withWatermark("_at", late).dropDuplicatesWithinWatermark([key])
    counts = once.groupBy(F.window("_at", "1 day"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("events"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.to_date(F.col("window.start")).alias("day"), "kind", "events").write.mode("overwrite").parquet(f"{base}/out/{number}")

    # changed windows of every batch; the newest batch that names a window has its count
    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("day date, kind string, events bigint").parquet(f"{base}/out/*")
    n = F.regexp_extract(F.col("_metadata.file_path"), r"/out/([0-9]+)/", 1).cast("int")
    return out.withColumn("n", n).groupBy("day", "kind").agg(F.max_by("events", "n").alias("events"))


def merge_once(batch: DataFrame, number: int, path: str, run: str) -> bool:
    """Write a batch under its run key and number unless it is there already; for foreachBatch sinks. True if written."""
    spark = batch.sparkSession
    at = f"{path}/run={run}/batch={number}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return False
    batch.write.mode("overwrite").parquet(at)
    return True
