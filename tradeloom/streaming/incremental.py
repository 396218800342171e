"""Structured Streaming forms of the incremental work: arrivals once, activity windows, latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 50) -> DataFrame:
    """New Parquet files below ``path`` as a stream; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_arrivals(stream: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Each key once within the watermark; state older than ``late`` is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def activity(stream: DataFrame, keys: list[str], time: str, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts per key and window; windows close when the watermark passes them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, keys: list[str], time: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a key that end after a pause of ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what has arrived, write Parquet exactly once, and stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(stream: DataFrame, folder: str, keys: list[str], order: str, checkpoint: str) -> None:
    """Keep the latest row of each key in ``folder``, batch by batch, and stop when all arrivals are worked off.

    Each batch writes a new version beside the last and then names it in ``folder/current.txt``, so a
    lost executor or a restart repeats the batch without harm.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
        mark = jvm.org.apache.hadoop.fs.Path(f"{folder}/current.txt")
        fs = mark.getFileSystem(hadoop)
        newest = batch
        if fs.exists(mark):
            last = spark.read.text(f"{folder}/current.txt").first()[0]
            if int(last) >= number:
                return
            newest = spark.read.parquet(f"{folder}/v{last}").unionByName(batch)
        row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
        newest.groupBy(*keys).agg(F.max_by(row, F.struct(order, F.xxhash64(*batch.columns))).alias("_r")).select("_r.*").write.mode("overwrite").parquet(f"{folder}/v{number}")
        out = fs.create(mark, True)
        out.write(bytearray(f"{number}\n".encode()))
        out.close()

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The table that ``upsert_stream`` keeps."""
    return spark.read.parquet(f"{folder}/v{spark.read.text(f'{folder}/current.txt').first()[0]}")
