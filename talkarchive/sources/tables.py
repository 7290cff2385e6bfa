"""The given tables in the shape of an archive of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents as timed segments of 4 s."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("seg_idx", "text"))
    return docs.withColumn("start", F.col("seg_idx") * 4.0).withColumn("end", F.col("start") + 4.0)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Chat turns as segments of 10 s with a speaker."""
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), "text")
    return rows.withColumn("start", F.col("seg_idx") * 10.0).withColumn("end", F.col("start") + 10.0)


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as processing jobs of customers' recordings."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("video_id"), F.col("o_orderpriority").alias("batch_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


def videos(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as recordings; every tenth is gone, so that anti joins have something to find."""
    return table(spark, folder, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("video_id"))
