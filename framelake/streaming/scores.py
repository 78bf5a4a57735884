"""Streaming forms (an extension): scores of arriving predictions, and counts of events in time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import metrics


def score_stream(predictions: DataFrame, truths: DataFrame, task: str = "kis") -> DataFrame:
    """predictions (query_id, pos, p) as they arrive, joined with the static truths and scored; stateless."""
    own = [c for c in truths.columns if c != "query_id"]
    static = truths.select("query_id", F.struct(*own).alias("g"))
    return predictions.join(static, "query_id").select("query_id", "pos", metrics.SCORERS[task](F.col("p"), F.col("g")).alias("score"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events and their mean value for each window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("events"), F.avg("value").alias("mean_value"))
