"""Command-line jobs: python -m framelake.jobs JOB --config FILE ... ; 2 is returned on a known error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake import schema
from framelake.operators import audit, features, framebank, index, metrics, ranking
from framelake.sources import files, run, spec

_POINT = "query_id STRING, video_id STRING, start_frame BIGINT, end_frame BIGINT"
TRUTHS = {"kis": _POINT, "qa": _POINT + ", accepted_answers ARRAY<STRING>", "trake": "query_id STRING, video_id STRING, intervals ARRAY<ARRAY<BIGINT>>"}
PREDICTIONS = {
    "kis": "query_id STRING, predictions ARRAY<STRUCT<video_id: STRING, frame_id: BIGINT>>",
    "qa": "query_id STRING, predictions ARRAY<STRUCT<video_id: STRING, frame_id: BIGINT, answer: STRING>>",
    "trake": "query_id STRING, predictions ARRAY<STRUCT<video_id: STRING, frame_ids: ARRAY<BIGINT>>>",
}


def sample_videos(spark: SparkSession, version: str = "synthetic-v0.1") -> DataFrame:
    """Two small videos (fixed values)."""
    rows = [("demo_video_001", "videos/demo_video_001.mp4", "demo", 25.0, 250, 10000, 1920, 1080, True, version), ("demo_video_002", "videos/demo_video_002.mp4", "demo", 30.0, 360, 12000, 1280, 720, False, version)]
    return spark.createDataFrame(rows, schema.VIDEO)


def audit_data(spark: SparkSession, config: dict) -> dict:
    videos = files.read_manifest(spark, config["manifest"])
    return audit.report(videos, audit.listing(spark, config["data_root"])).head().asDict()


def build_frame_bank(spark: SparkSession, manifest: str, out: str) -> dict:
    videos = files.read_manifest(spark, manifest)
    shots, frames, report = framebank.build(videos)
    files.write_jsonl(shots, f"{out}/shots")
    files.write_jsonl(frames, f"{out}/frames")
    return report.head().asDict()


def extract_features(spark: SparkSession, frames: str, out: str, dimension: int = 32) -> dict:
    rows = features.extract(files.read_jsonl(spark, frames, schema.FRAME), features.HashEncoder(dimension), out)
    files.save_features(rows, f"{out}/features")
    return {"rows": files.load_features(spark, f"{out}/features").count(), "dimension": dimension}


def retrieve(spark: SparkSession, store: str, frames: str, query: str, k: int) -> DataFrame:
    rows = files.load_features(spark, store)
    first = rows.select("dimension", "model_version").head()
    texts = spark.createDataFrame([("q", query)], "query_id string, text string")
    return index.retrieve(files.read_jsonl(spark, frames, schema.FRAME), rows, texts, features.HashEncoder(first.dimension, first.model_version), k)


def evaluate(spark: SparkSession, task: str, truths: str, predictions: str) -> dict:
    lists = files.read_json_list(spark, predictions, PREDICTIONS[task]).withColumn("group_order", F.monotonically_increasing_id())
    queries, total = metrics.evaluate(files.read_json_list(spark, truths, TRUTHS[task]), lists, task)
    return total.head().asDict() | {"task": task, "per_query": [r.asDict() for r in queries.orderBy("query_id").collect()]}


def demo(spark: SparkSession, config: dict, config_path: str, root: str) -> dict:
    """Videos, shots, frames, features, search and groups, with a run folder."""
    version = config.get("data_version", "synthetic-v0.1")
    encoder = features.HashEncoder(int(config.get("dimension", 32)), str(config.get("model_version", "0.1")))
    with run.Run.start(root, "demo", config_path, config, version, "demo") as own:
        videos = sample_videos(spark, version)
        shots, frames, _ = framebank.build(videos)
        files.write_jsonl(frames, f"file://{own.folder}/frames")
        files.save_features(features.extract(frames, encoder, str(own.folder)), f"file://{own.folder}/features")
        texts = spark.createDataFrame([("q", config.get("query", "a person presenting an idea"))], "query_id string, text string")
        hits = index.retrieve(frames, files.load_features(spark, f"file://{own.folder}/features"), texts, encoder, int(config.get("top_k", 4)))
        files.write_jsonl(hits, f"file://{own.folder}/retrieval_results")
        groups = ranking.group_by_video(files.read_jsonl(spark, f"file://{own.folder}/retrieval_results", schema.CANDIDATE))
        return {"run": str(own.folder), "videos": [r.asDict(True) for r in groups.orderBy("first_rank").collect()]}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="framelake")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, options in {"audit": ["config"], "frame-bank": ["manifest", "out"], "features": ["frames", "out"], "search": ["store", "frames", "query"], "evaluate": ["ground-truth", "predictions"], "demo": ["config", "out"], "spec-check": ["spec"], "spec-assets": ["spec", "out"]}.items():
        job = jobs.add_parser(name)
        for option in options:
            job.add_argument(f"--{option}", required=True)
        if name == "search":
            job.add_argument("--top-k", type=int, default=10)
        if name == "features":
            job.add_argument("--dimension", type=int, default=32)
        if name == "evaluate":
            job.add_argument("--task", choices=sorted(TRUTHS), required=True)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("framelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.job == "audit":
            out = audit_data(spark, run.load_config(a.config, ("data_root", "manifest")))
        elif a.job == "frame-bank":
            out = build_frame_bank(spark, a.manifest, a.out)
        elif a.job == "features":
            out = extract_features(spark, a.frames, a.out, a.dimension)
        elif a.job == "search":
            out = {"results": [r.asDict() for r in retrieve(spark, a.store, a.frames, a.query, a.top_k).orderBy("rank").collect()]}
        elif a.job == "evaluate":
            out = evaluate(spark, a.task, a.ground_truth, a.predictions)
        elif a.job == "spec-check":
            out = {"faults": [r.asDict() for r in spec.faults(spark, spec.load(a.spec), 9, True).orderBy("check", "page_id", "subject").collect()]}
        elif a.job == "spec-assets":
            out = spec.generate(spark, a.spec, a.out)
        else:
            out = demo(spark, run.load_config(a.config), a.config, a.out)
    except (OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return 2
    print(json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
