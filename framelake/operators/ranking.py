"""Grouping, suppression of near frames, and ranking of videos."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_by_video(candidates: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """by, video_id, first_rank and the frames in rank order; groups order by first_rank."""
    return candidates.groupBy(*by, "video_id").agg(F.min("rank").alias("first_rank"), F.array_sort(F.collect_list(F.struct("rank", "frame_uid", "frame_id", "score"))).alias("frames"))


def suppress_nearby(candidates: DataFrame, max_distance: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rows that are kept when they are taken by falling score, then rank, and none within max_distance of a kept one of its video.

    Each video's rows are sorted by Spark and streamed; kept frames are a sorted list, so a row costs a binary search. Frames
    that are more than max_distance apart cannot suppress each other, so each video is first cut at such gaps, and a long
    video is many small groups.
    """
    if max_distance < 0:
        raise ValueError("a distance below zero")
    own = [*by, "video_id"]
    line = Window.partitionBy(*own).orderBy("frame_id")
    gap = F.coalesce((F.col("frame_id") - F.lag("frame_id").over(line) > max_distance).cast("long"), F.lit(0))
    parts = candidates.withColumn("_gap", gap).withColumn("_part", F.sum("_gap").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
    shape = candidates.schema

    def keep(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["_part"]).combine_chunks()
        frames, scores, ranks = (table.column(c).to_pylist() for c in ("frame_id", "score", "rank"))
        kept, rows = [], []
        for k in sorted(range(len(frames)), key=lambda k: (-scores[k], ranks[k], frames[k])):
            at = bisect.bisect_left(kept, frames[k] - max_distance)
            if at == len(kept) or kept[at] > frames[k] + max_distance:
                bisect.insort(kept, frames[k])
                rows.append(k)
        return table.take(rows)

    return parts.groupBy(*own, "_part").applyInArrow(keep, shape)


def rank_videos(candidates: DataFrame, strategy: str = "best_frame", top_k: int = 3, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Videos of each group by their best frame's score or the mean of their top_k frames', ties by video_id."""
    if strategy not in ("best_frame", "top_k_mean"):
        raise ValueError("the strategy is neither best_frame nor top_k_mean")
    if top_k <= 0:
        raise ValueError("top_k has to be positive")
    own = [*by, "video_id"]
    place = Window.partitionBy(*own).orderBy(F.col("score").desc(), "rank")
    best = candidates.withColumn("_nth", F.row_number().over(place)).where(F.col("_nth") <= top_k)
    frames = F.array_sort(F.collect_list(F.struct("_nth", "frame_uid", "frame_id", "score", "rank")))
    mean = F.aggregate("best_frames", F.lit(0.0), lambda s, x: s + x["score"]) / F.size("best_frames")
    grouped = best.groupBy(*own).agg(frames.alias("best_frames"))
    branches = candidates.groupBy(*own).agg(F.array_sort(F.collect_set("source_branch")).alias("source_branches"))
    score = F.col("best_frames")[0]["score"] if strategy == "best_frame" else mean
    scored = grouped.withColumn("score", score).withColumn("matched_event_count", F.size("best_frames")).join(branches, own)
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "video_id")
    return scored.withColumn("rank", F.row_number().over(order))
