import hashlib
import math

import numpy as np
import pytest
from framelake import jobs, schema
from framelake.functions import mapping, text, vectors
from framelake.operators import audit, features, framebank, fusion, graph, index, metrics, ranking, temporal
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_mapping(spark):
    ms = lambda f, fps: one(spark, mapping.frame_to_timestamp_ms(F.lit(f), F.lit(fps)))
    assert [ms(50, 25.0), ms(1, 16.0), ms(3, 16.0), ms(1, 2000.0), ms(3, 2000.0)] == [2000, 62, 188, 0, 2]
    assert one(spark, mapping.timestamp_ms_to_frame(F.lit(2000), F.lit(25.0))) == 50
    assert one(spark, mapping.center_frame(F.lit(-8), F.lit(1))) == -4
    with pytest.raises(Exception, match="below zero"):
        ms(-1, 25.0)
    with pytest.raises(Exception, match="positive"):
        ms(1, 0.0)


def test_demo_frames(spark):
    videos = jobs.sample_videos(spark)
    shots, frames, report = framebank.build(videos)
    got = {r.video_id: r for r in frames.collect()}
    assert (got["demo_video_001"].frame_uid, got["demo_video_001"].actual_frame_id, got["demo_video_001"].timestamp_ms) == ("frm_078250a4bc461fc3663a", 124, 4960)
    assert (got["demo_video_002"].frame_uid, got["demo_video_002"].actual_frame_id, got["demo_video_002"].timestamp_ms) == ("frm_8299cc759b5613596f3a", 179, 5967)
    assert {r.video_id: r.end_time_ms for r in shots.collect()} == {"demo_video_001": 9960, "demo_video_002": 11967}
    assert report.head().asDict() == {"total_shots": 2, "total_selected_frames": 2, "average_frames_per_video": 1.0}
    texts = spark.createDataFrame([("q", "a person presenting an idea")], "query_id string, text string")
    hits = index.retrieve(frames, features.extract(frames), texts, features.HashEncoder(), 4).orderBy("rank").collect()
    assert [(r.video_id, r.rank) for r in hits] == [("demo_video_001", 1), ("demo_video_002", 2)]
    assert np.allclose([r.score for r in hits], [0.291121, -0.089572], atol=1e-5)


def test_center_selector(spark):
    videos = spark.createDataFrame([("v", 25.0, 100, "d")], "video_id string, fps double, total_frames long, dataset_version string")
    shots = spark.createDataFrame([("s", "v", 10, 20)], "shot_id string, video_id string, start_frame long, end_frame long")
    r = framebank.center_frames(videos, shots).head()
    assert (r.actual_frame_id, r.timestamp_ms, r.source_policy) == (15, 600, "SHOT_CENTER")
    outside = spark.createDataFrame([("s", "v", 10, 500)], shots.schema)
    with pytest.raises(Exception, match="outside"):
        framebank.center_frames(videos, outside).collect()
    assert framebank.center_frames(videos, outside, strict=False).count() == 0
    with pytest.raises(Exception, match="outside"):
        framebank.center_frames(videos, spark.createDataFrame([("s", "w", 1, 2)], shots.schema)).collect()


def test_hash_encoder_against_numpy(spark):
    for dimension in (5, 16, 32):
        for value in ("", "frm_1", "été"):
            seed = f"text|{value}|0.1".encode()
            data = b"".join(hashlib.sha256(seed + k.to_bytes(4, "big")).digest() for k in range(8))[: 4 * dimension]
            v = np.frombuffer(data, "<u4") / (2**32 - 1) * 2 - 1
            got = one(spark, vectors.hash_vector(F.lit(value), "text", dimension))
            assert np.allclose(got, (v / np.linalg.norm(v)).astype("f4"), atol=1e-7)
    with pytest.raises(ValueError):
        vectors.hash_vector(F.lit("x"), "text", 0)


def test_index(spark):
    rows = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [1.0, 0.0]), ("c", [2.0, 0.0])], "id string, v array<float>")
    query = spark.createDataFrame([(1, [0.9, 0.1]), (2, [1.0, 0.0])], "query_id int, vector array<float>")
    got = index.cosine_topk(rows, query, 9, "id", "v").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, "a"), (1, "c"), (1, "b"), (2, "a"), (2, "c"), (2, "b")]
    assert index.require_index(rows, "id", "v") == 2
    for bad in ([("a", [1.0]), ("a", [2.0])], [("a", [0.0])], [("a", [1.0]), ("b", [1.0, 2.0])]):
        with pytest.raises(ValueError):
            index.require_index(spark.createDataFrame(bad, rows.schema), "id", "v")
    with pytest.raises(ValueError):
        index.require_index(rows.limit(0), "id", "v")
    with pytest.raises(ValueError):
        index.cosine_topk(rows, query, 0, "id", "v")
    with pytest.raises(Exception, match="dimensions"):
        index.cosine_topk(rows, spark.createDataFrame([(1, [1.0, 2.0, 3.0])], query.schema), 1, "id", "v").collect()
    assert index.cosine_topk(rows, query.limit(0), 3, "id", "v").count() == 0


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id string, branch string, branch_order int, pos int, rank int, score double, frame_uid string")


def test_fusion(spark):
    rows = [("q", "visual", 0, 1, 1, 0.5, "a"), ("q", "text", 1, 1, 0, 0.9, "b"), ("q", "text", 1, 2, 2, 0.5, "a"), ("q", "text", 1, 3, 1, 9.0, "a")]
    got = {r.frame_uid: r for r in fusion.reciprocal_rank_fusion(candidates(spark, rows), k=10, weights={"visual": 2.0}).collect()}
    assert math.isclose(got["a"].score, 2 / 11 + 1 / 12) and math.isclose(got["b"].score, 1 / 11)
    assert (got["a"].rank, got["b"].rank, got["a"].source_branch) == (1, 2, "rrf")
    for bad in ({"k": -1}, {"weights": {"x": -1.0}}):
        with pytest.raises(ValueError):
            fusion.reciprocal_rank_fusion(candidates(spark, rows), **bad)


def test_suppression_is_against_kept_rows(spark):
    rng = np.random.default_rng(0)
    rows = [("q", f"v{k % 3}", int(f), str(k), float(s), k, "b") for k, (f, s) in enumerate(zip(rng.integers(0, 400, 200), rng.integers(0, 9, 200), strict=True))]
    frame = spark.createDataFrame(rows, "query_id string, video_id string, frame_id long, frame_uid string, score double, rank int, source_branch string")
    for d in (0, 4, 30):
        kept = []
        for r in sorted(rows, key=lambda r: (-r[4], r[5])):
            if not any(x[1] == r[1] and abs(x[2] - r[2]) <= d for x in kept):
                kept.append(r)
        assert {r.frame_uid for r in ranking.suppress_nearby(frame, d).collect()} == {r[3] for r in kept}
    with pytest.raises(ValueError):
        ranking.suppress_nearby(frame, -1)
    best = ranking.rank_videos(frame, "top_k_mean", 2).orderBy("rank").collect()
    for r in best:
        top = sorted((x[4] for x in rows if x[1] == r.video_id), reverse=True)[:2]
        assert math.isclose(r.score, sum(top) / 2) and r.matched_event_count == 2 and r.source_branches == ["b"]
    groups = ranking.group_by_video(frame).orderBy("first_rank").collect()
    assert [g.video_id for g in groups] == ["v0", "v1", "v2"]
    for bad in ({"strategy": "x"}, {"top_k": 0}):
        with pytest.raises(ValueError):
            ranking.rank_videos(frame, **bad)


def score(spark, scorer, p, g, pt, gt, **more):
    row = spark.createDataFrame([(p, g)], f"p struct<{pt}>, g struct<{gt}>")
    return row.select(scorer(F.col("p"), F.col("g"), **more).alias("x")).head().x


def test_scorers(spark):
    pt, gt = "video_id: string, frame_id: bigint, answer: string", "video_id: string, start_frame: bigint, end_frame: bigint, accepted_answers: array<string>"
    truth = ("v1", 10, 20, ["Ho Chi Minh City"])
    kis = lambda *p: score(spark, metrics.kis_score, p, truth, pt, gt)
    assert [kis("v1", 15, None), kis("v2", 15, None), kis("v1", 21, None), kis("v1", 20, None), kis("v1", None, None)] == [1, 0, 0, 1, 0]
    qa = lambda a: score(spark, metrics.qa_score, ("v1", 15, a), truth, pt, gt)
    assert [qa("  HO CHI   MINH CITY "), qa("Hanoi"), qa(None)] == [1, 0, 0]
    pt, gt = "video_id: string, frame_ids: array<bigint>", "video_id: string, intervals: array<array<bigint>>"
    spans = [[0, 10], [20, 30], [40, 50], [60, 70]]
    assert score(spark, metrics.trake_score, ("v", [5, 25, 45, 99]), ("v", spans), pt, gt) == 0.75
    assert score(spark, metrics.trake_score, ("w", [5, 25, 45, 99]), ("v", spans), pt, gt) == 0
    for p, g in ((("w", [1]), ("v", spans)), (("w", []), ("v", [])), (("v", [1]), ("v", [[1]]))):
        with pytest.raises(Exception, match="interval"):
            score(spark, metrics.trake_score, p, g, pt, gt)
        assert score(spark, metrics.trake_score, p, g, pt, gt, strict=False) is None
    assert math.isclose(one(spark, metrics.final_from(F.create_map(*(F.lit(x) for kv in {1: 0.5, 5: 0.8, 20: 0.8, 50: 0.8, 100: 0.8}.items() for x in kv)))), 0.74)


def test_evaluate(spark):
    truths = spark.createDataFrame([("a", "v", 0, 9), ("b", "v", 0, 9), ("a", "w", 5, 5)], "query_id string, video_id string, start_frame long, end_frame long")
    lists = spark.createDataFrame([("a", [("v", 99), ("v", 3)], 1), ("a", [("x", 1)], 0), ("z", [("v", 1)], 2)], "query_id string, predictions array<struct<video_id: string, frame_id: bigint>>, group_order int")
    queries, total = metrics.evaluate(truths, lists, "kis")
    assert sorted((r.query_id, r.r_at_1, r.r_at_5, r.final) for r in queries.collect()) == [("a", 0.0, 0.0, 0.0), ("a", 0.0, 1.0, 0.8), ("b", 0.0, 0.0, 0.0)]
    assert total.head().queries == 3 and math.isclose(total.head().macro_final, 0.8 / 3)
    assert metrics.evaluate(truths.limit(0), lists, "kis")[1].head().macro_final == 0
    ranked = spark.createDataFrame([(1, False), (2, True), (3, True)], "rank int, relevant boolean")
    assert ranked.agg(metrics.reciprocal_rank().alias("x")).head().x == 0.5
    assert ranked.agg(metrics.recall_at(2, F.lit(4)).alias("x")).head().x == 0.25


def test_answers(spark):
    assert one(spark, text.normalize_answer(F.lit("  A\t\tb C \n"))) == "a b c"
    assert one(spark, text.short_label(F.array(F.lit("one"), F.lit("two")), 6)) == "one →…"


def test_records(spark):
    rows = [("v", "a", "b", 25.0, 1, 1, None, None, None, "d"), (" ", "a", "b", 0.0, -1, -1, None, None, None, "d"), ("v", "a", "b", float("nan"), 1, 1, None, None, None, "d")]
    videos = spark.createDataFrame(rows, schema.VIDEO)
    assert [len(r.violations) for r in schema.with_violations(videos, "video").collect()] == [0, 4, 1]
    with pytest.raises(Exception, match="needs an id"):
        schema.require(videos.where("total_frames < 0"), "video").collect()
    paths = ["", "/a", "a/../b", "a\\..\\b", "..", "a..b/c", "a/b.mp4"]
    frame = spark.createDataFrame([(p,) for p in paths], "relative_path string")
    assert [r.relative_path for r in audit.invalid_paths(frame).collect()] == paths[:5]
    frames = spark.createDataFrame([("UNKNOWN", 1, 1), ("SHOT_CENTER", -1, 0), ("SHOT_CENTER", 1, 1)], "source_policy string, actual_frame_id long, timestamp_ms long")
    assert [len(r.violations) for r in schema.with_violations(frames, "frame").collect()] == [1, 1, 0]


def test_feature_store_faults(spark):
    rows = spark.createDataFrame([(0, 2, [1.0, 2.0]), (1, 2, [1.0, 2.0])], "feature_row long, dimension int, vector array<float>")
    assert features.require_store(rows).count() == 2
    for bad in ([(0, 2, [1.0, 2.0]), (2, 2, [1.0, 2.0])], [(0, 3, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            features.require_store(spark.createDataFrame(bad, rows.schema))


def test_graph(spark):
    nodes = spark.createDataFrame([("p", "a", [], ["b"], ["in"], ["out x"], "A", ["o1", "o2"]), ("p", "b", ["a"], [], ["x"], ["y"], "B", ["o1"])], "page_id string, node_id string, dependencies array<string>, next_modules array<string>, inputs array<string>, outputs array<string>, title string, owners array<string>")
    edges = spark.createDataFrame([("p", "a", "b", "X")], "page_id string, source string, target string, label string")
    assert graph.orphan_edges(nodes, edges).count() == 0 and graph.dependency_faults(nodes, edges).count() == 0
    assert graph.unsupported_labels(nodes, edges).count() == 0
    bad = spark.createDataFrame([("p", "b", "c", "zz"), ("p", "b", "a", "zz")], edges.schema)
    assert graph.orphan_edges(nodes, bad).count() == 1 and graph.dependency_faults(nodes, bad).count() == 2
    assert graph.unsupported_labels(nodes, bad).count() == 1
    assert graph.repeated(nodes.union(nodes), "page_id", "node_id").count() == 2
    assert {(r.owner, r.value, r.nodes) for r in graph.owner_counts(nodes, "title").collect()} == {("o1", "A", 1), ("o2", "A", 1), ("o1", "B", 1)}
    assert graph.drift(nodes.select("node_id"), nodes.select("node_id").limit(1)).count() == 1
    assert 'a["A"]' in graph.mermaid(nodes, edges).head().text


def test_chains_against_all_combinations(spark):
    import itertools

    rng = np.random.default_rng(3)
    rows = [("q", "v", int(rng.integers(0, 3)), int(rng.integers(0, 40)), float(rng.random())) for _ in range(25)]
    frame = spark.createDataFrame(rows, "query_id string, video_id string, event int, frame_id long, score double")
    got = [(round(r.chain_score, 9), r.frame_ids) for r in temporal.best_chains(frame, 3, 4).orderBy("chain_rank").collect()]
    by = [[r for r in rows if r[2] == e] for e in range(3)]
    every = sorted((-sum(r[4] for r in c), [r[3] for r in c]) for c in itertools.product(*by) if c[0][3] < c[1][3] < c[2][3])
    assert got == [(round(-s, 9), f) for s, f in every[:4]]


def spec_of(**change):
    import copy

    node = {"id": "A", "title": "First", "subtitle": "s", "layer": "l", "type": "process", "criticality": "CORE", "criticality_scope": "c", "maturity": "PLANNED", "source_basis": "TEAM_DECISION", "fallback": "f", "group": "G"}
    node |= {c: ["x"] for c in ("responsibility", "non_responsibility", "inputs", "processing", "implementations", "outputs", "artifacts", "metrics", "failure_modes")}
    node |= {"architecture_owner": ["o"], "implementation_owner": ["o"], "reviewers": [], "dependencies": [], "next_modules": ["B"], "outputs": ["goes on"], "geometry": {"x": 0, "y": 0, "width": 100, "height": 50}}
    other = copy.deepcopy(node) | {"id": "B", "dependencies": ["A"], "next_modules": [], "inputs": ["what goes on"], "geometry": {"x": 200, "y": 0, "width": 100, "height": 50}}
    edge = {"id": "E", "source": "A", "target": "B", "label": "Goes on", "flow_type": "data"}
    page = {"id": "P", "title": "t", "direction": "LR", "detail_level": "full", "mermaid_file": "p.mmd", "groups": [{"id": "G", "title": "g", "layer": "l", "geometry": {"x": 0, "y": 0, "width": 320, "height": 220}}]}
    node.update(change.get("node", {}))
    edge.update(change.get("edge", {}))
    return {"owners": {"o": {}}, "styles": {"layers": {"l": {}}}, "pages": [page | {"nodes": [node, other], "edges": [edge]} | change.get("page", {})]}


def test_spec_faults(spark):
    from framelake.sources import spec

    checks = lambda **change: sorted({r.check for r in spec.faults(spark, spec_of(**change)).collect()})
    assert checks() == []
    assert checks(node={"maturity": "OLD", "group": "H", "geometry": {"x": 150, "y": 0, "width": 50, "height": 50}}, edge={"label": "zz"}, page={"direction": "UP"}) == ["label without an interface", "maturity", "overlap", "page direction", "unknown group"]
    assert checks(node={"next_modules": [], "fallback": " ", "id": "1A", "reviewers": ["z"]}, edge={"flow_type": "x"}) == ["empty fallback", "flow type", "node id", "orphan edge", "unknown reviewers"]
    assert "A[\"First\"]" in spec.flowcharts(spark, spec_of()).head().text
    assert {(r.field, r.value, r.nodes) for r in spec.summary(spark, spec_of()).collect()} >= {("maturity", "PLANNED", 2), ("architecture_owner", "o", 2)}


def whole_spec(**change):
    import copy

    from framelake.sources import spec

    whole = spec_of(page={"id": "PAGE_00", "description": "d", "layout": {}, "notes": []})
    for part in whole["pages"][0]["nodes"]:
        part["number"] = 1
    whole |= {"project": {"version": "1.1"}, "models": {"m": dict.fromkeys(spec.KEYS["model"]) | {"source_basis": "TEAM_DECISION", "maturity": "PLANNED", "validation_status": "UNSELECTED"}}}
    whole |= {registry: dict.fromkeys(spec.TAXONOMIES[field]) for registry, field in (("criticalities", "criticality"), ("maturities", "maturity"), ("source_bases", "source_basis"))}
    whole["styles"]["fonts"] = {"page_title": 24, "group_title": 18, "node": 10}
    whole = copy.deepcopy(whole) | {k: v for k, v in change.items() if k not in ("page", "node", "edge")}
    whole["pages"][0].update(change.get("page", {}))
    whole["pages"][0]["nodes"][0].update(change.get("node", {}))
    whole["pages"][0]["edges"][0].update(change.get("edge", {}))
    return whole


def test_whole_spec_faults(spark):
    from framelake.sources import spec

    checks = lambda **change: sorted({r.check for r in spec.faults(spark, whole_spec(**change), 1).collect()})
    assert checks() == []
    assert checks(project={"version": 1.0}, statuses={}, maturities={"PLANNED": 1}, models={}) == ["old key", "registry", "version"]
    model = {"source_basis": "TEAM_DECISION", "maturity": "PLANNED", "validation_status": "UNSELECTED", "selected": "x"}
    assert checks(models={"m": model}, styles={"layers": {"l": {}}, "fonts": {"node": 9, "page_title": 23}}) == ["model lacks keys", "selection without a decision", "small font", "unselected model with a selection"]
    assert checks(node={"status": "x", "processing": ["Execute bounded  retry policy"], "implementation_owner": []}, edge={"waypoints": [{"x": 1}]}, page={"mermaid_file": "../p.mmd"}) == ["empty implementation_owner", "file name", "old key", "placeholder", "waypoint"]
    assert checks(node={"type": "graph_node", "title": "Query Event Graph", "inputs": [3]}) == ["graph node on another page", "graph node type", "inputs is no list of texts", "module as a graph node"]
    assert checks(node={"type": "decision", "title": "Frame Bank"}, page={"id": "PAGE_07"}) == ["module as a decision", "pages or their order"]
    missing = [(r.check, r.subject) for r in spec.faults(spark, whole_spec(), 1, True).collect()]
    assert {c: sum(x == c for x, _ in missing) for c, _ in missing} == {"missing graph node type": 6, "missing graph relation": 7, "missing criticality": 4, "missing module": 4}


def test_spec_assets(spark, tmp_path):
    import hashlib

    import yaml
    from framelake.sources import spec

    path = tmp_path / "s.yaml"
    path.write_text(yaml.safe_dump(whole_spec()), encoding="utf-8")
    out = spec.generate(spark, path, tmp_path / "out", 1, False)
    assert out["spec_sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    assert (out["page_count"], out["node_count"], out["edge_count"]) == (1, 2, 1)
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.*")) == ["generated/quality_report.md", "generated/summary.json", "mermaid/p.mmd"]
    path.write_text(yaml.safe_dump(whole_spec(page={"mermaid_file": "../../../p.mmd"})), encoding="utf-8")
    with pytest.raises(ValueError, match="file name"):
        spec.generate(spark, path, tmp_path / "more", 1, False)
    assert not (tmp_path / "more").exists()


def test_guards_are_not_pruned(spark):
    from framelake import schema

    rows = [("v", "p", "b", 25.0, 10, 1, 1, 1, True, "d"), ("w", "p", "b", 0.0, 7, 1, 1, 1, True, "d")]
    videos = schema.require(spark.createDataFrame(rows, schema.VIDEO), "video")
    for use in (lambda: videos.count(), lambda: videos.agg(F.sum("total_frames")).collect()):
        with pytest.raises(Exception, match="frame rate"):
            use()
    shots = spark.createDataFrame([("s", "v", 30, 40)], "shot_id string, video_id string, start_frame long, end_frame long")
    good = spark.createDataFrame(rows[:1], schema.VIDEO)
    with pytest.raises(Exception, match="outside video v"):
        framebank.center_frames(good, shots).count()
    assert framebank.center_frames(good, shots, strict=False).count() == 0


def test_shot_id_of_large_numbers(spark):
    got = spark.sql("SELECT explode(array(0, 42, 999999, 1234567)) AS n").select(mapping.shot_id(F.lit("v"), F.col("n")).alias("id")).collect()
    assert [r.id for r in got] == ["v:shot:000000", "v:shot:000042", "v:shot:999999", "v:shot:1234567"]


def test_supplied_and_adaptive_frames(spark):
    from framelake import schema

    videos = spark.createDataFrame([("v", "p", "b", 10.0, 400, 1, 1, 1, True, "d")], schema.VIDEO)
    given = spark.createDataFrame([("v", 5), ("v", 5), ("v", 399), ("x", 1)], "video_id string, frame_id long")
    assert sorted(r.actual_frame_id for r in framebank.supplied_keyframes(videos, given, strict=False).collect()) == [5, 399]
    with pytest.raises(Exception, match="outside video x"):
        framebank.supplied_keyframes(videos, given).collect()
    shots = spark.createDataFrame([("a", "v", 0, 30), ("b", "v", 100, 219), ("c", "v", 220, 399)], "shot_id string, video_id string, start_frame long, end_frame long")
    got = {}
    for r in framebank.adaptive_frames(videos, shots).collect():
        got.setdefault(r.shot_id, []).append(r.actual_frame_id)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [15], "b": [100, 129, 159, 189, 219], "c": [220, 270, 320, 370, 399]}
