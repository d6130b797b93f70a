"""Incremental ingestion of documents as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: Parts of a target.
PARTS = 64


def ingest(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Parquet files that land are hashed and added to target unless it holds the same key and hash.

    The target is dealt into PARTS by the key's hash; a batch reads the parts of its own keys only. Batches that are replayed, also after a
    failure midway, write what is missing, because each is compared with the target first. No state is kept between batches.
    """
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    rows = spark.readStream.schema(schema).parquet(landing).withColumn("file_hash", F.sha2(F.col(text), 256)).withColumn("_part", part)

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key, "file_hash"])
        if _exists(spark, target):
            touched = [r[0] for r in new.select("_part").distinct().collect()]  # PARTS at most
            there = spark.read.parquet(target).where(F.col("_part").isin(touched))
            new = new.join(there.select(key, "file_hash"), [key, "file_hash"], "left_anti")
        new.write.mode("append").partitionBy("_part").parquet(target)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per type and tumbling window of a stream or table, with a bound on how late they may come."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return at.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
