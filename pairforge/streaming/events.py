"""Structured Streaming (extension): windows with watermarks, duplicates, a stateful fold; each run equals its batch twin.

Streams are read file by file (S13) and run until the input is used up. Results go to a table in the shared folder: a
window's last state by its key, so that a repeated micro-batch after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pyspark.sql.types import IntegerType, StructField, StructType

from pairforge.session import work_dir

#: How late an event may be; state is kept that long.
LATE = "1 day"


def read_stream(spark: SparkSession, path: str, schema, files: int = 1, glob: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as they appear, `files` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(path)


def run(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """The stream's whole result. mode complete or update: the last micro-batch's table wins; append: all rows."""
    spark = stream.sparkSession
    path = path or work_dir(spark)
    names = stream.columns
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number:09d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(schema).parquet(f"{path}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.filter(F.col("batch") == last)
    return out.select(*names)


def stamped(events: DataFrame) -> DataFrame:
    """Event time with a zone, as watermarks need it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    w = stamped(events).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = LATE) -> DataFrame:
    w = stamped(events).withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def session(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    w = stamped(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def deduplicated(events: DataFrame, *keys: str, late: str = LATE) -> DataFrame:
    return stamped(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, cents = state.get if state.exists else (0, 0)
    for df in frames:
        n += len(df)
        cents += int((df["value"] * 100).round().sum())
    state.update((n, cents))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "cents": [cents]})


def folded(events: DataFrame) -> DataFrame:
    """V16's analogue: a state for each user, carried over micro-batches; emits each user's totals so far."""
    return stamped(events).groupBy("user_id").applyInPandasWithState(_fold, "user_id BIGINT, n BIGINT, cents BIGINT", "n BIGINT, cents BIGINT", "update", GroupStateTimeout.NoTimeout)

