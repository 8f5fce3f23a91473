"""The edit log as a stream: windowed counts, sessions and a running state. An extension; batch tables work the same way."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(log: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Edits of each type in each window; rows later than `late` are dropped from a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    marked = log.withWatermark("ts", late) if log.isStreaming else log
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(log: DataFrame, pause: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    marked = log.withWatermark("ts", late) if log.isStreaming else log
    return marked.groupBy(F.session_window("ts", pause).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_state(log: DataFrame) -> DataFrame:
    """A stream of (user_id, event_id, ts): the newest edit of each user, given out as it changes."""

    def step(key, frames, state):
        best = state.get if state.exists else (-1, pd.Timestamp.min)
        for pdf in frames:
            top = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if (top.ts, top.event_id) > (pd.Timestamp(best[1]), best[0]):
                best = int(top.event_id), top.ts.to_pydatetime()
        state.update(best)
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [best[0]], "ts": [best[1]]})

    return log.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ts timestamp", "event_id long, ts timestamp", "update", "NoTimeout")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs over what there is now, then stops; the checkpoint folder makes each row count once."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
