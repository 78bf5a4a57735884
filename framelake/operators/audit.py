"""Manifest audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.schema import valid_relative_path


def totals(videos: DataFrame) -> DataFrame:
    return videos.agg(F.count("*").alias("total_videos"), F.coalesce(F.sum("total_frames"), F.lit(0)).alias("total_frames"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_duration_ms"))


def duplicate_video_ids(videos: DataFrame) -> DataFrame:
    return videos.groupBy("video_id").count().where("count > 1").select("video_id")


def invalid_paths(videos: DataFrame) -> DataFrame:
    """Rows whose path is empty, absolute or climbs; duplicates stay."""
    return videos.where(~F.coalesce(valid_relative_path(F.col("relative_path")), F.lit(False)))


def missing_paths(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with a valid path that files (relative_path) doesn't list."""
    valid = videos.where(valid_relative_path(F.col("relative_path"))).withColumn("_path", F.translate("relative_path", "\\", "/"))
    there = files.select(F.translate("relative_path", "\\", "/").alias("_path"))
    return valid.join(there, "_path", "left_anti").drop("_path")


def listing(spark, root: str) -> DataFrame:
    """relative_path of every file under root, by the binary-file source without contents."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return found.select(F.substr("path", F.locate(full.split(":", 1)[1].lstrip("/"), F.col("path")) + len(full.split(":", 1)[1].lstrip("/")) + 1).alias("relative_path"))


def report(videos: DataFrame, files: DataFrame) -> DataFrame:
    """One row: totals, missing paths, duplicate ids and invalid records. The arrays hold faults only."""
    lists = (
        missing_paths(videos, files).agg(F.array_sort(F.collect_list("relative_path")).alias("missing_paths")),
        duplicate_video_ids(videos).agg(F.array_sort(F.collect_list("video_id")).alias("duplicate_video_ids")),
        invalid_paths(videos).agg(F.array_sort(F.collect_list(F.concat(F.lit("invalid relative path: "), F.coalesce("relative_path", F.lit(""))))).alias("invalid_records")),
    )
    out = totals(videos)
    for part in lists:
        out = out.crossJoin(part)  # one row each
    return out
