import json

import duckdb
import pytest
from framelake import jobs, schema
from framelake.plans import workload
from framelake.sources import files, run
from framelake.streaming import scores
from pyspark.sql import functions as F

HEADER = "video_id,relative_path,batch_id,fps,total_frames,duration_ms,width,height,has_audio,dataset_version,more\n"


def manifest(tmp_path, *lines):
    path = tmp_path / "m.csv"
    path.write_text(HEADER + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_manifest(spark, tmp_path):
    path = manifest(tmp_path, "v1,videos/v1.mp4,b,25.0, 250 ,1_0000,1920,,true,d,x", "v2,videos/v2.mp4,b,30.0,360,12000,,720,FALSE,d,x", "v3,v3.mp4,b,24,0,0,1,1,,d,x")
    got = files.read_manifest(spark, path)
    assert got.schema.simpleString() == spark.createDataFrame([], schema.VIDEO).schema.simpleString()
    assert [tuple(r)[4:9] for r in got.collect()] == [(250, 10000, 1920, None, True), (360, 12000, None, 720, False), (0, 0, 1, 1, None)]
    files.write_manifest(got, str(tmp_path / "out"))
    assert files.read_manifest(spark, str(tmp_path / "out")).orderBy("video_id").collect() == got.orderBy("video_id").collect()
    for bad in ("v,p,b,0,1,1,,,,d,x", "v,p,b,x,1,1,,,,d,x", "v,p,b,1,1,1,,, true,d,x", ",p,b,1,1,1,,,,d,x", "v,p,b,1,-1,1,,,,d,x"):
        with pytest.raises(Exception):
            files.read_manifest(spark, manifest(tmp_path, bad)).collect()
    (tmp_path / "short.csv").write_text("video_id\nv\n")
    with pytest.raises(ValueError, match="fps"):
        files.read_manifest(spark, str(tmp_path / "short.csv"))
    with pytest.raises(FileNotFoundError):
        files.read_manifest(spark, str(tmp_path / "none.csv"))


def test_json(spark, tmp_path):
    rows = spark.createDataFrame([("é", None, [1, 2])], "a string, b int, c array<bigint>")
    files.write_jsonl(rows, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a string, b int, c array<bigint>").collect() == rows.collect()
    assert '"b":null' in "".join(part.read_text() for part in (tmp_path / "j").glob("part-*"))
    (tmp_path / "bad.jsonl").write_text('{"a": "x"}\n\n[1\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a string").collect()
    truths = [{"query_id": "t", "video_id": "v", "intervals": [[0, 10], [20, 30], [40, 50], [60, 70]]}]
    lists = [{"query_id": "t", "predictions": [{"video_id": "v", "frame_ids": [5, 25, 45, 99]}, {"video_id": "w", "frame_ids": [5, 25, 45, 65]}]}]
    (tmp_path / "t.json").write_text(json.dumps(truths))
    (tmp_path / "p.json").write_text(json.dumps(lists, indent=1))
    out = jobs.evaluate(spark, "trake", str(tmp_path / "t.json"), str(tmp_path / "p.json"))
    assert out["macro_final"] == 0.75 and out["per_query"][0]["r_at_1"] == 0.75


def test_jobs(spark, tmp_path):
    out = jobs.demo(spark, {"top_k": 4}, "none", str(tmp_path))
    assert [v["video_id"] for v in out["videos"]] == ["demo_video_001", "demo_video_002"]
    folder = next((tmp_path / "demo").iterdir())
    assert json.loads((folder / "run_manifest.json").read_text())["status"] == "COMPLETED" and (folder / "used_config.yaml").exists()
    path = manifest(tmp_path, "v1,videos/v1.mp4,b,25.0,250,10000,,,,d,x", "v1,videos/../v2.mp4,b,30.0,360,12000,,,,d,x", "v3,videos/v3.mp4,b,30.0,360,12000,,,,d,x")
    (tmp_path / "root/videos").mkdir(parents=True)
    (tmp_path / "root/videos/v1.mp4").write_text("x")
    got = jobs.audit_data(spark, {"manifest": path, "data_root": str(tmp_path / "root")})
    assert got == {"total_videos": 3, "total_frames": 970, "total_duration_ms": 34000, "missing_paths": ["videos/v3.mp4"], "duplicate_video_ids": ["v1"], "invalid_records": ["invalid relative path: videos/../v2.mp4"]}
    path = manifest(tmp_path, "v1,videos/v1.mp4,b,25.0,250,10000,,,,d,x", "v2,v2.mp4,b,30.0,0,0,,,,d,x")
    assert jobs.build_frame_bank(spark, path, str(tmp_path / "bank"))["average_frames_per_video"] == 0.5
    assert jobs.extract_features(spark, str(tmp_path / "bank/frames"), str(tmp_path / "f"), 8) == {"rows": 1, "dimension": 8}
    assert jobs.retrieve(spark, str(tmp_path / "f/features"), str(tmp_path / "bank/frames"), "x", 3).count() == 1
    with pytest.raises(ValueError):
        jobs.retrieve(spark, str(tmp_path / "f/features"), str(tmp_path / "bank/frames"), " \t", 3)


def test_run_and_config(tmp_path, monkeypatch):
    monkeypatch.setenv("HERE", "x")
    (tmp_path / "c.yaml").write_text("a: {b: ['${HERE}/y', 1]}\n")
    assert run.load_config(tmp_path / "c.yaml", ["a.b"]) == {"a": {"b": ["x/y", 1]}}
    with pytest.raises(ValueError, match="a.c, d"):
        run.load_config(tmp_path / "c.yaml", ["a.c", "d"])
    with pytest.raises(ValueError, match="NOT_THERE"):
        run.expand("${NOT_THERE}", {})
    with pytest.raises(RuntimeError), run.Run.start(tmp_path, "n", "c", {}, "v", "cmd") as own:
        raise RuntimeError
    assert json.loads((own.folder / "run_manifest.json").read_text())["status"] == "FAILED"
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            run.safe_name(bad)
    run.write_report({"a": 1}, tmp_path / "x/r.json")
    assert json.loads((tmp_path / "x/r.json").read_text()) == {"a": 1}


def test_streams(spark, tmp_path):
    truths = spark.createDataFrame([("a", "v", 0, 9)], "query_id string, video_id string, start_frame long, end_frame long")
    spark.createDataFrame([("a", 1, ("v", 5)), ("a", 2, ("w", 5)), ("b", 1, ("v", 5))], "query_id string, pos int, p struct<video_id: string, frame_id: bigint>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id string, pos int, p struct<video_id: string, frame_id: bigint>").parquet(str(tmp_path / "in"))
    query = scores.score_stream(stream, truths).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("scored").collect()) == [("a", 1, 1.0), ("a", 2, 0.0)]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    assert scores.windowed_counts(events).agg(F.sum("events")).head()[0] == events.count()


@pytest.mark.parametrize("name", sorted(workload.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in workload._TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    stated = con.sql(workload.oracle_sql()[name])
    frame = workload.queries()[name](spark, folder)
    names = sorted(frame.columns)
    assert names == sorted(stated.columns)
    places = [stated.columns.index(n) for n in names]
    assert sorted(str(tuple(r[n] for n in names)) for r in frame.collect()) == sorted(str(tuple(r[k] for k in places)) for r in stated.fetchall())
