"""Record schemas and their invariants as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Origins of retrieval frames.
SOURCE_POLICIES = ("BTC_KEYFRAME", "SHOT_CENTER", "ADAPTIVE_MULTIFRAME", "UNIFORM_FALLBACK", "QUERY_LOCAL_DENSE")

VIDEO = "video_id STRING, relative_path STRING, batch_id STRING, fps DOUBLE, total_frames BIGINT, duration_ms BIGINT, width INT, height INT, has_audio BOOLEAN, dataset_version STRING"
SHOT = "shot_id STRING, video_id STRING, start_frame BIGINT, end_frame BIGINT, start_time_ms BIGINT, end_time_ms BIGINT, detector_name STRING, detector_version STRING, confidence DOUBLE"
FRAME = "frame_uid STRING, video_id STRING, actual_frame_id BIGINT, timestamp_ms BIGINT, image_path STRING, source_policy STRING, shot_id STRING, dataset_version STRING, extraction_version STRING"
FEATURE = "feature_uid STRING, frame_uid STRING, model_name STRING, model_version STRING, feature_row BIGINT, dimension INT, normalized BOOLEAN, artifact_path STRING, vector ARRAY<FLOAT>"
CANDIDATE = "query_id STRING, video_id STRING, frame_id BIGINT, timestamp_ms BIGINT, frame_uid STRING, score DOUBLE, rank INT, source_branch STRING"
RUN = "run_id STRING, created_at_utc STRING, git_commit STRING, config_path STRING, data_version STRING, artifact_name STRING, command STRING, status STRING"


def _fails(test: Column) -> Column:
    """True where the test holds; a null operand breaks no invariant but the ones on presence."""
    return F.coalesce(test, F.lit(False))


def invariants(kind: str) -> list[tuple[str, Column]]:
    """(message, test that holds where a row breaks it) in the order of checking."""
    c = F.col
    return {
        "video": [
            ("a video needs an id", F.coalesce(F.length(F.trim(F.regexp_replace("video_id", r"(?U)\s+", " "))) == 0, F.lit(True))),
            ("a frame rate has to be positive", F.coalesce((c("fps") <= 0) | F.isnan("fps"), F.lit(True))),  # NaN is refused as well
            ("a frame count below zero", _fails(c("total_frames") < 0)),
            ("a duration below zero", _fails(c("duration_ms") < 0)),
        ],
        "shot": [
            ("the shot's first frame lies after its last", _fails(c("start_frame") > c("end_frame"))),
            ("the shot starts after it ends", _fails(c("start_time_ms") > c("end_time_ms"))),
        ],
        "frame": [
            ("the source policy is not a known one", ~F.coalesce(c("source_policy").isin(*SOURCE_POLICIES), F.lit(False))),
            ("a frame number or timestamp below zero", _fails((c("actual_frame_id") < 0) | (c("timestamp_ms") < 0))),
        ],
    }[kind]


def with_violations(df: DataFrame, kind: str) -> DataFrame:
    """df with the array `violations` of the messages of all invariants that a row breaks."""
    return df.withColumn("violations", F.array_compact(F.array(*(F.when(test, F.lit(message)) for message, test in invariants(kind)))))


def refuse(df: DataFrame, faults: list[tuple[Column, Column]]) -> DataFrame:
    """df, failing with the first message (message, test) whose test holds for a row. A filter is not pruned, whichever columns are used."""
    guard = F.lit(True)
    for message, test in reversed(faults):
        guard = F.when(test, F.raise_error(message).cast("boolean")).otherwise(guard)
    return df.where(F.coalesce(guard, F.lit(True)))


def require(df: DataFrame, kind: str) -> DataFrame:
    """df, failing with the first message where a row breaks an invariant."""
    return refuse(df, [(F.lit(message), test) for message, test in invariants(kind)])


def valid_relative_path(path: Column) -> Column:
    """Neither empty nor absolute nor with a parent segment, after back slashes count as slashes."""
    flat = F.translate(path, "\\", "/")
    return (flat != "") & ~flat.startswith("/") & ~F.array_contains(F.split(flat, "/"), "..")
