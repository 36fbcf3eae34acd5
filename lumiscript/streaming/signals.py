"""The signals on a stream. Each is an expression in its row, so no state, shuffle or watermark is needed for them; rates by window are an extra of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiscript import schemas
from lumiscript.operators.detect import Thresholds, flag_columns, text_signals


def generation_stream(spark: SparkSession, path: str, schema: str = schemas.GENERATIONS + ", tag string, generated_at timestamp") -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def flagged_stream(stream: DataFrame, text: str = "output", finish_reason: str | None = "finish_reason", th: Thresholds = Thresholds()) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = stream.withColumns(text_signals(F.col(text), F.col(finish_reason) if finish_reason else None))
    return rows.withColumn("tone_loss_tokens", none).withColumn("unknown_citations", none).withColumns(flag_columns(th))


def windowed_rates(flagged: DataFrame, at: str = "generated_at", by: str = "tag", window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Flag rates by event-time window; rows later than the watermark are left out."""
    rows = flagged.withWatermark(at, late)
    return rows.groupBy(F.window(at, window).alias("window"), by).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in ("E1", "E2", "E5", "E6")])


def write_stream(rows: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return rows.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
