"""The event log as a stream: latest rows and active intervals by session windows, with late events dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files that are added to a folder."""
    return spark.readStream.schema(schema).parquet(path)


def sessions(events: DataFrame, ts: str, key: str, gap: str = "300 seconds", late: str = "5 minutes") -> DataFrame:
    """Stretches of a key's events without a longer gap."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there and ends."""
    q = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
