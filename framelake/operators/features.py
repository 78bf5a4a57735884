"""Feature extraction and the feature store's checks. The vector is a column, so nothing is joined by position."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.vectors import hash_vector


@dataclass(frozen=True)
class HashEncoder:
    """A stand-in encoder: stable vectors without meaning. Any other one has the same fields and two Column builders."""

    dimension: int = 32
    model_version: str = "0.1"
    model_name: str = "deterministic_dummy"

    def encode_frames(self, frame_uid: Column) -> Column:
        return hash_vector(frame_uid, "frame", self.dimension, self.model_version)

    def encode_text(self, text: Column) -> Column:
        return hash_vector(text, "text", self.dimension, self.model_version)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the row's number from 0 in the order, without sorting all rows in one task: ranges are counted, then numbered.

    The ranges are sampled, so they are kept for both uses: sampled twice, they could differ.
    """
    parts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    inside = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    counts = ranged.groupBy("_part").count()
    bases = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return inside.join(F.broadcast(bases), "_part").withColumn(name, (F.col("_base") + F.col("_k")).cast("long")).drop("_part", "_k", "_base")  # parts rows


def extract(frames: DataFrame, encoder: HashEncoder = HashEncoder(), artifact_path: str = "features", order: tuple[str, ...] = ("video_id", "actual_frame_id", "frame_uid")) -> DataFrame:
    """Feature rows of frames; feature_row numbers them in the order given, as a DataFrame has none of its own."""
    rows = numbered(frames.select("frame_uid", *(c for c in order if c != "frame_uid")), list(order), "feature_row")
    return rows.select(
        F.concat_ws(":", F.lit(encoder.model_name), F.lit(encoder.model_version), "frame_uid").alias("feature_uid"), "frame_uid",
        F.lit(encoder.model_name).alias("model_name"), F.lit(encoder.model_version).alias("model_version"), "feature_row",
        F.lit(encoder.dimension).alias("dimension"), F.lit(True).alias("normalized"), F.lit(artifact_path).alias("artifact_path"),
        encoder.encode_frames(F.col("frame_uid")).alias("vector"),
    )


def encode(frames: DataFrame, encoder: HashEncoder = HashEncoder()) -> DataFrame:
    """frame_uid and vector, without numbers: what a search needs."""
    return frames.select("frame_uid", encoder.encode_frames(F.col("frame_uid")).alias("vector"))


def store_faults(features: DataFrame) -> DataFrame:
    """One row: rows, whether feature_row runs from 0 without a gap, and whether all dimensions equal their vector's length."""
    return features.agg(
        F.count("*").alias("rows"),
        ((F.count("*") == 0) | ((F.min("feature_row") == 0) & (F.max("feature_row") == F.count("*") - 1) & (F.count_distinct("feature_row") == F.count("*")))).alias("rows_contiguous"),
        F.coalesce(F.every((F.size("vector") == F.col("dimension"))), F.lit(True)).alias("dimensions_match"),
        (F.count_distinct(F.size("vector")) <= 1).alias("one_dimension"),
    )


def require_store(features: DataFrame) -> DataFrame:
    found = store_faults(features).head()
    if not found.rows_contiguous:
        raise ValueError("feature rows are not numbered 0, 1, 2 and so on")
    if not (found.dimensions_match and found.one_dimension):
        raise ValueError("a stated dimension differs from its vector's length")
    return features


TextEncoder = Callable[[Column], Column]
