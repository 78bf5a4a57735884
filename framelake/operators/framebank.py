"""Shots and retrieval frames. A detector maps videos to shots and a selector videos and shots to frames, DataFrames all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import mapping
from framelake.schema import refuse

Detector = Callable[[DataFrame], DataFrame]
Selector = Callable[[DataFrame, DataFrame], DataFrame]


def full_video_shots(videos: DataFrame, name: str = "dummy", version: str = "0.1") -> DataFrame:
    """One shot over all frames of each video that has any."""
    last = F.col("total_frames") - 1
    return videos.where(F.col("total_frames") > 0).select(
        mapping.shot_id(F.col("video_id"), F.lit(0)).alias("shot_id"), "video_id", F.lit(0).cast("long").alias("start_frame"), last.alias("end_frame"),
        F.lit(0).cast("long").alias("start_time_ms"), mapping.frame_to_timestamp_ms(last, F.col("fps")).alias("end_time_ms"),
        F.lit(name).alias("detector_name"), F.lit(version).alias("detector_version"), F.lit(None).cast("double").alias("confidence"),
    )


def _frames(joined: DataFrame, frame, policy: str, version: str, strict: bool) -> DataFrame:
    inside = mapping.frame_in_video(F.col("_frame"), F.col("total_frames"))
    joined = joined.withColumn("_frame", frame)
    if strict:
        joined = refuse(joined, [(F.concat(F.lit("frame is outside video "), "video_id"), ~F.coalesce(inside, F.lit(False)))])
    else:
        joined = joined.where(inside)
    f = F.col("_frame")
    return joined.select(
        mapping.frame_uid(F.col("dataset_version"), F.col("video_id"), f, policy, version).alias("frame_uid"), "video_id", f.alias("actual_frame_id"),
        mapping.frame_to_timestamp_ms(f, F.col("fps")).alias("timestamp_ms"), mapping.image_path(F.col("video_id"), f).alias("image_path"),
        F.lit(policy).alias("source_policy"), "shot_id", "dataset_version", F.lit(version).alias("extraction_version"),
    )


def center_frames(videos: DataFrame, shots: DataFrame, version: str = "0.1", strict: bool = True) -> DataFrame:
    """The middle frame of each shot. strict: a shot without its video, or a middle outside of it, is an error."""
    joined = shots.join(videos.select("video_id", "fps", "total_frames", "dataset_version"), "video_id", "left" if strict else "inner")
    return _frames(joined, mapping.center_frame(F.col("start_frame"), F.col("end_frame")), "SHOT_CENTER", version, strict)


def sampled_frames(videos: DataFrame, shots: DataFrame, policy: str = "UNIFORM_FALLBACK", step_ms: int = 5000, version: str = "0.1") -> DataFrame:
    """Frames every step_ms within each shot, from its first (own design for the policies that are named but not defined)."""
    joined = shots.join(videos.select("video_id", "fps", "total_frames", "dataset_version"), "video_id")
    step = F.greatest(F.lit(1), mapping.timestamp_ms_to_frame(F.lit(step_ms), F.col("fps"))).cast("long")
    joined = joined.withColumn("_pick", F.explode(F.sequence("start_frame", "end_frame", step)))
    return _frames(joined, F.col("_pick"), policy, version, False)


def supplied_keyframes(videos: DataFrame, keyframes: DataFrame, version: str = "0.1", strict: bool = True) -> DataFrame:
    """Frames that come with the videos (video_id, frame_id, shot_id if there is one); each once, whatever repeats.
    strict: a frame without its video, or outside of it, is an error."""
    shot = F.col("shot_id") if "shot_id" in keyframes.columns else F.lit(None).cast("string")
    given = keyframes.select("video_id", F.col("frame_id").cast("long").alias("_pick"), shot.alias("shot_id")).groupBy("video_id", "_pick").agg(F.min("shot_id").alias("shot_id"))
    joined = given.join(videos.select("video_id", "fps", "total_frames", "dataset_version"), "video_id", "left" if strict else "inner")
    return _frames(joined, F.col("_pick"), "BTC_KEYFRAME", version, strict)


def adaptive_frames(videos: DataFrame, shots: DataFrame, short_s: float = 5, medium_s: float = 15, interval_s: float = 5, max_gap_s: float = 5, version: str = "0.1") -> DataFrame:
    """Frames by a shot's length (own design for the thresholds that are only named): its middle up to short_s seconds; its
    first, middle and last frame up to medium_s; else a frame every interval_s, and the last. Gaps over max_gap_s are cut evenly."""
    joined = shots.join(videos.select("video_id", "fps", "total_frames", "dataset_version"), "video_id")
    first, last = F.col("start_frame"), F.col("end_frame")
    seconds, middle = (last - first + 1) / F.col("fps"), mapping.center_frame(first, last)
    step = F.greatest(F.lit(1), F.floor(F.col("fps") * interval_s)).cast("long")
    picks = F.when(seconds <= short_s, F.array(middle)).when(seconds <= medium_s, F.array(first, middle, last)).otherwise(F.concat(F.sequence(first, last, step), F.array(last)))
    joined = joined.withColumn("_picks", F.array_sort(F.array_distinct(picks)))
    gap = F.greatest(F.lit(1), F.floor(F.col("fps") * max_gap_s)).cast("long")
    next_pick = lambda k: F.coalesce(F.get(F.col("_picks"), k + 1), F.get(F.col("_picks"), k))
    parts = lambda x, k: F.greatest(F.lit(1), F.ceil((next_pick(k) - x) / gap)).cast("long")
    cut = F.transform("_picks", lambda x, k: F.transform(F.sequence(F.lit(0).cast("long"), parts(x, k) - 1), lambda j: x + F.floor(j * (next_pick(k) - x) / parts(x, k)).cast("long")))
    return _frames(joined.withColumn("_pick", F.explode(F.array_distinct(F.flatten(cut)))), F.col("_pick"), "ADAPTIVE_MULTIFRAME", version, False)


def frames_per_video(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """video_id and frames, with 0 for a video without any."""
    counts = frames.groupBy("video_id").agg(F.count("*").alias("_n"))
    return videos.select("video_id").distinct().join(counts, "video_id", "left").select("video_id", F.coalesce("_n", F.lit(0)).alias("frames"))


def report(videos: DataFrame, shots: DataFrame, frames: DataFrame) -> DataFrame:
    """One row of totals; the average counts every row of videos."""
    one = shots.agg(F.count("*").alias("total_shots")).crossJoin(frames.agg(F.count("*").alias("total_selected_frames"))).crossJoin(videos.agg(F.count("*").alias("_videos")))  # one row each
    return one.select("total_shots", "total_selected_frames", F.when(F.col("_videos") > 0, F.col("total_selected_frames") / F.col("_videos")).otherwise(0.0).alias("average_frames_per_video"))


def build(videos: DataFrame, detector: Detector = full_video_shots, selector: Selector = center_frames) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shots, frames and the report."""
    shots = detector(videos)
    frames = selector(videos, shots)
    return shots, frames, report(videos, shots, frames)
