"""The stateless stages as a stream: records or raw lines in, checked records or numbered domains out.

Cleaning, validation, translation, search and numbering look at one record at a time, so the
batch plans run unchanged inside ``foreachBatch``; choices among a record's hits happen within
its micro-batch.  Removing redelivered records needs state, bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import sequence as S
from ..operators.rejects import loaded_lines, rejected_lines
from ..operators.translate import six_frames_of


def line_stream(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Parquet files of raw lines as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def checked(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejected lines) of a stream of raw lines."""
    return loaded_lines(lines), rejected_lines(lines)


def translated(records: DataFrame, key: str = "id") -> DataFrame:
    """Six frames of the valid DNA records of a stream."""
    clean = records.withColumn("s", S.normalise(F.col("sequence"))).filter((F.lower(F.trim("input_type")) == "dna") & S.valid_dna(F.col("s")))
    return six_frames_of(clean, key)


def without_redeliveries(records: DataFrame, keys: list[str], time: str = "loaded_at", delay: str = "30 days") -> DataFrame:
    """First arrival of every key within the delay."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def arrivals(records: DataFrame, time: str = "loaded_at", window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Records per window of arrival; late ones count until the delay has passed."""
    return records.withWatermark(time, delay).groupBy(F.window(time, window)).agg(F.count("*").alias("n"))


def number_stream(records: DataFrame, number: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write ``number(batch)`` of every micro-batch once, under its batch number."""

    def write(batch: DataFrame, epoch: int) -> None:
        number(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
