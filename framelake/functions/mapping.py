"""Frame numbers, timestamps and identities. Rounding is half to even, as `rint` does and `round` does not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(value: Column, fps: Column, name: str, result: Column) -> Column:
    return F.when(value < 0, F.raise_error(F.lit(f"{name} below zero"))).when((fps <= 0) | F.isnan(fps), F.raise_error(F.lit("a frame rate has to be positive"))).otherwise(result)


def frame_to_timestamp_ms(frame_id: Column, fps: Column, strict: bool = True) -> Column:
    out = F.rint(frame_id * 1000 / fps).cast("long")
    return _checked(frame_id, fps, "frame_id", out) if strict else out


def timestamp_ms_to_frame(timestamp_ms: Column, fps: Column, strict: bool = True) -> Column:
    out = F.rint(timestamp_ms * fps / 1000).cast("long")
    return _checked(timestamp_ms, fps, "timestamp_ms", out) if strict else out


def center_frame(start: Column, end: Column) -> Column:
    """Floor of the middle; `div` would cut negative sums toward zero."""
    return F.floor((start + end) / 2).cast("long")


def frame_in_video(frame_id: Column, total_frames: Column) -> Column:
    return (frame_id >= 0) & (frame_id < total_frames)


def frame_uid(dataset_version: Column, video_id: Column, frame: Column, policy: str, extraction_version: str) -> Column:
    identity = F.concat_ws("|", dataset_version, video_id, frame.cast("string"), F.lit(policy), F.lit(extraction_version))
    return F.concat(F.lit("frm_"), F.substring(F.sha2(identity, 256), 1, 20))


def image_path(video_id: Column, frame: Column) -> Column:
    return F.format_string("frames/%s/%09d.jpg", video_id, frame)


def shot_id(video_id: Column, number: Column) -> Column:
    return F.format_string("%s:shot:%06d", video_id, number.cast("long"))
