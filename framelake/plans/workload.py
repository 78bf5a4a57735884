"""Registered queries over the test tables and the SQL that states the same results.

VIEWS are the inputs in SQL that both engines read alike; the queries apply the library's operators to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake import schema
from framelake.functions import mapping, text, vectors
from framelake.operators import audit, features, framebank, fusion, graph, index, metrics, ranking, temporal

_FPS = "CASE p_partkey % 6 WHEN 0 THEN 25.0 WHEN 1 THEN 30.0 WHEN 2 THEN 24.0 WHEN 3 THEN 29.97 WHEN 4 THEN 16.0 ELSE 23.976 END"
_PATH = "CASE WHEN p_partkey % 97 = 0 THEN '' WHEN p_partkey % 89 = 0 THEN '/abs/' || p_name WHEN p_partkey % 83 = 0 THEN 'videos/../' || p_name WHEN p_partkey % 79 = 0 THEN '..' || chr(92) || p_name ELSE 'videos/' || p_brand || chr(92) || CAST(p_partkey AS VARCHAR(20)) || '.mp4' END"

VIEWS = {
    "videos": f"""SELECT 'v' || CAST(CASE WHEN p_partkey % 50 = 0 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR(20)) AS video_id, {_PATH} AS relative_path,
        'b' || CAST(p_partkey % 7 AS VARCHAR(20)) AS batch_id, CAST({_FPS} AS DOUBLE) AS fps, CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size * 37 END AS BIGINT) AS total_frames,
        CAST(p_size * 1480 AS BIGINT) AS duration_ms, 'tables-1' AS dataset_version, p_partkey FROM part""",
    "unique_videos": f"""SELECT 'v' || CAST(p_partkey AS VARCHAR(20)) AS video_id, CAST({_FPS} AS DOUBLE) AS fps, CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size * 37 END AS BIGINT) AS total_frames,
        'tables-1' AS dataset_version FROM part""",
    "ranked": """SELECT CAST(user_id AS VARCHAR(20)) AS query_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS rank, event_type AS video_id,
        CAST(floor(value) AS BIGINT) AS frame_id, CAST(event_id AS VARCHAR(20)) AS frame_uid, CAST(value AS DOUBLE) AS score FROM events""",
    "truth": """SELECT CAST(user_id AS VARCHAR(20)) AS query_id, event_type AS video_id, CAST(floor(value) AS BIGINT) - 20 AS start_frame, CAST(floor(value) AS BIGINT) + 20 AS end_frame
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) latest WHERE nth = 1""",
    "trake": """SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k FROM lineitem""",
    "nodes": """SELECT 'p' || CAST(n_regionkey AS VARCHAR(20)) AS page_id, 'n' || CAST(n_nationkey AS VARCHAR(20)) AS node_id, n_name AS title, CAST(n_nationkey % 3 AS VARCHAR(20)) AS maturity,
        CAST(n_nationkey % 5 AS VARCHAR(20)) AS criticality FROM nation""",
    "edges": """SELECT DISTINCT 'p' || CAST(n_regionkey AS VARCHAR(20)) AS page_id, 'n' || CAST(s_nationkey AS VARCHAR(20)) AS source, 'n' || CAST((s_nationkey + s_suppkey % 6) % 27 AS VARCHAR(20)) AS target
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "rectangles": """SELECT 'p' || CAST(s_nationkey % 5 AS VARCHAR(20)) AS page_id, 'r' || CAST(s_suppkey AS VARCHAR(20)) AS node_id, CAST(s_suppkey * 37 % 4000 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 3000 AS DOUBLE) AS y,
        CAST(200 + s_suppkey % 600 AS DOUBLE) AS w, CAST(100 + s_suppkey % 400 AS DOUBLE) AS h FROM supplier""",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations", "benchmark")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, from the tables under sf_dir by path, so that calls with other folders don't mix."""
    import re

    query = VIEWS[name]
    for table in _TABLES:
        query = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 parquet.`{sf_dir}/{table}.parquet` AS {table}", query)
    return spark.sql(query)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


_COSINE = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_BEST = "greatest(0.0, coalesce(max(CASE WHEN rank <= {0} THEN hit END), 0.0))"
_HITS = "hits AS (SELECT g.query_id, r.rank, CASE WHEN r.video_id IS NOT DISTINCT FROM g.video_id AND r.frame_id BETWEEN g.start_frame AND g.end_frame THEN 1.0 ELSE 0.0 END AS hit FROM truth g LEFT JOIN ranked r ON g.query_id = r.query_id)"
_FINAL = "(" + " + ".join(_BEST.format(k) for k in metrics.CUTOFFS) + ") / 5"

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- vector search ---


def _ranked_cosine(spark, sf_dir, queries, k):
    emb = table(spark, sf_dir, "embeddings")
    stated = emb.where(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return index.cosine_topk(emb, stated, k).withColumn("score", F.round("score", 6))


@_query(f"""SELECT query_id, vec_id, round(s, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COSINE} AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    return _ranked_cosine(spark, sf_dir, "vec_id % 50 = 0", 10)


@_query(f"""SELECT query_id, vec_id, round(s, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COSINE} AS s,
    row_number() OVER (ORDER BY {_COSINE} DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id = 7) WHERE rank <= 25""")
def cosine_topk_single(spark, sf_dir):
    return _ranked_cosine(spark, sf_dir, "vec_id = 7", 25)


@_query("""SELECT count(*) AS size, CAST(max(len(embedding)) AS INT) AS dimension, count(*) - count(DISTINCT vec_id) AS repeated_ids, coalesce(max(len(embedding)) - min(len(embedding)), 0) <> 0 AS mixed_dimensions,
    CAST(count(*) FILTER (WHERE list_sum(list_transform(embedding, lambda x: x * x)) = 0) AS BIGINT) AS zero_vectors FROM embeddings""")
def index_validate(spark, sf_dir):
    return index.build_faults(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@_query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS length FROM embeddings")
def vector_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"))


@_query("SELECT count(*) AS rows, count(*) = 0 OR (min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AND count(DISTINCT vec_id) = count(*)) AS rows_contiguous, bool_and(len(embedding) = 64) AS dimensions_match, count(DISTINCT len(embedding)) <= 1 AS one_dimension FROM embeddings")
def feature_store_validate(spark, sf_dir):
    return features.store_faults(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("feature_row"), F.lit(64).alias("dimension"), F.col("embedding").alias("vector")))


def _frames(spark, sf_dir):
    videos = view(spark, sf_dir, "unique_videos")
    return framebank.center_frames(videos, framebank.full_video_shots(videos))


_CENTER = "CAST(floor((total_frames - 1) / 2.0) AS BIGINT)"
_UID = f"'frm_' || substr(sha256(dataset_version || '|' || video_id || '|' || CAST({_CENTER} AS VARCHAR) || '|SHOT_CENTER|0.1'), 1, 20)"


def _hash_sql(value: str, namespace: str, dimension: int) -> str:
    """The unit vector of hash_vector() as a list of DOUBLE in SQL."""
    seed = f"encode('{namespace}|' || {value} || '|0.1')"
    blocks = " || ".join(f"sha256({seed} || '\\x00\\x00\\x00\\x{k:02x}'::BLOB)" for k in range(-(-dimension // 8)))
    word = "substr(h, k * 8 + 7, 2) || substr(h, k * 8 + 5, 2) || substr(h, k * 8 + 3, 2) || substr(h, k * 8 + 1, 2)"
    raw = f"list_transform(range({dimension}), lambda k: CAST(CAST('0x' || {word} AS UBIGINT) AS DOUBLE) / 4294967295.0 * 2.0 - 1.0)"
    return f"(SELECT list_transform(r, lambda x: CAST(CAST(x / sqrt(list_sum(list_transform(r, lambda y: y * y))) AS FLOAT) AS DOUBLE)) FROM (SELECT {raw} AS r FROM (SELECT {blocks} AS h)))"


@_query(f"""WITH f AS (SELECT frame_uid, video_id, frame_id, {_hash_sql('frame_uid', 'frame', 32)} AS v FROM (SELECT {_UID} AS frame_uid, video_id, {_CENTER} AS frame_id FROM ({VIEWS['unique_videos']}) WHERE total_frames > 0)),
    q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {_hash_sql('text', 'text', 32)} AS w FROM benchmark WHERE item_id % 50 = 0),
    s AS (SELECT query_id, frame_uid, video_id, frame_id, list_cosine_similarity(v, w) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(v, w) DESC, frame_uid) AS rank FROM f, q)
    SELECT query_id, frame_uid, video_id, frame_id, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM s WHERE rank <= 10""")
def retrieve_frames(spark, sf_dir):
    """Text search over hash-encoded frames; the queries are the texts of benchmark whose id is divisible by 50."""
    frames = _frames(spark, sf_dir)
    texts = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").cast("string").alias("query_id"), "text")
    found = index.retrieve(frames, features.encode(frames), texts, features.HashEncoder(), 10)
    return found.select("query_id", "frame_uid", "video_id", "frame_id", F.round("score", 5).alias("score"), "rank")


@_query(f"SELECT conv_id, turn, {', '.join(f'round(v[{k + 1}], 5) AS v{k}' for k in range(16))} FROM (SELECT conv_id, turn, {_hash_sql('t', 'text', 16)} AS v FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations))")
def hash_encoder_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", features.HashEncoder(16).encode_text(F.coalesce("text", F.lit(""))).alias("v"))
    return rows.select("conv_id", "turn", *(F.round(F.col("v")[k].cast("double"), 5).alias(f"v{k}") for k in range(16)))


@_query(f"SELECT 'deterministic_dummy:0.1:' || {_UID} AS feature_uid, row_number() OVER (ORDER BY video_id, {_CENTER}) - 1 AS feature_row FROM ({VIEWS['unique_videos']}) WHERE total_frames > 0")
def feature_rows(spark, sf_dir):
    return features.extract(_frames(spark, sf_dir)).select("feature_uid", "feature_row")


# --- frame mapping and frame bank ---


@_query(f"SELECT video_id, frame, CAST(round_even(frame * 1000 / fps, 0) AS BIGINT) AS ms FROM ({VIEWS['unique_videos']}), (SELECT unnest([0, 1, 3, 124, 999]) AS frame)")
def frame_to_ts(spark, sf_dir):
    rows = view(spark, sf_dir, "unique_videos").withColumn("frame", F.explode(F.array(*map(F.lit, (0, 1, 3, 124, 999)))))
    return rows.select("video_id", "frame", mapping.frame_to_timestamp_ms(F.col("frame"), F.col("fps")).alias("ms"))


@_query(f"SELECT video_id, ms, CAST(round_even(ms * fps / 1000, 0) AS BIGINT) AS frame FROM ({VIEWS['unique_videos']}), (SELECT unnest([0, 20, 1000, 2031, 99999]) AS ms)")
def ts_to_frame(spark, sf_dir):
    rows = view(spark, sf_dir, "unique_videos").withColumn("ms", F.explode(F.array(*map(F.lit, (0, 20, 1000, 2031, 99999)))))
    return rows.select("video_id", "ms", mapping.timestamp_ms_to_frame(F.col("ms"), F.col("fps")).alias("frame"))


@_query(f"SELECT count(*) AS frames, count(*) FILTER (WHERE CAST(round_even(round_even(frame * 1000 / fps, 0) * fps / 1000, 0) AS BIGINT) = frame) AS same FROM ({VIEWS['unique_videos']}), (SELECT unnest([0, 1, 3, 124, 999]) AS frame)")
def frame_roundtrip(spark, sf_dir):
    rows = view(spark, sf_dir, "unique_videos").withColumn("frame", F.explode(F.array(*map(F.lit, (0, 1, 3, 124, 999)))))
    back = mapping.timestamp_ms_to_frame(mapping.frame_to_timestamp_ms(F.col("frame"), F.col("fps")), F.col("fps"))
    return rows.agg(F.count("*").alias("frames"), F.count_if(back == F.col("frame")).alias("same"))


@_query(f"""SELECT video_id || ':shot:000000' AS shot_id, video_id, CAST(0 AS BIGINT) AS start_frame, total_frames - 1 AS end_frame, CAST(0 AS BIGINT) AS start_time_ms,
    CAST(round_even((total_frames - 1) * 1000 / fps, 0) AS BIGINT) AS end_time_ms FROM ({VIEWS['unique_videos']}) WHERE total_frames > 0""")
def shots_full_video(spark, sf_dir):
    return framebank.full_video_shots(view(spark, sf_dir, "unique_videos")).select("shot_id", "video_id", "start_frame", "end_frame", "start_time_ms", "end_time_ms")


@_query(f"""SELECT {_UID} AS frame_uid, video_id, {_CENTER} AS actual_frame_id, CAST(round_even({_CENTER} * 1000 / fps, 0) AS BIGINT) AS timestamp_ms,
    'frames/' || video_id || '/' || printf('%09d', {_CENTER}) || '.jpg' AS image_path, 'SHOT_CENTER' AS source_policy, video_id || ':shot:000000' AS shot_id FROM ({VIEWS['unique_videos']}) WHERE total_frames > 0""")
def center_frames(spark, sf_dir):
    return _frames(spark, sf_dir).select("frame_uid", "video_id", "actual_frame_id", "timestamp_ms", "image_path", "source_policy", "shot_id")


@_query(f"SELECT video_id, CAST(CASE WHEN total_frames > 0 THEN 1 ELSE 0 END AS BIGINT) AS frames FROM ({VIEWS['unique_videos']})")
def frames_per_video(spark, sf_dir):
    videos = view(spark, sf_dir, "unique_videos")
    return framebank.frames_per_video(videos, _frames(spark, sf_dir))


@_query(f"SELECT count(*) FILTER (WHERE total_frames > 0) AS total_shots, count(*) FILTER (WHERE total_frames > 0) AS total_selected_frames, count(*) FILTER (WHERE total_frames > 0) / count(*) AS average_frames_per_video FROM ({VIEWS['unique_videos']})")
def frame_bank_report(spark, sf_dir):
    return framebank.build(view(spark, sf_dir, "unique_videos"))[2]


@_query(f"""WITH v AS ({VIEWS['unique_videos']}), s AS (SELECT *, unnest(range(CAST(0 AS BIGINT), total_frames, greatest(1, CAST(round_even(5000 * fps / 1000, 0) AS BIGINT)))) AS f FROM v WHERE total_frames > 0)
    SELECT video_id, f AS actual_frame_id, CAST(round_even(f * 1000 / fps, 0) AS BIGINT) AS timestamp_ms FROM s""")
def sampled_frames(spark, sf_dir):
    videos = view(spark, sf_dir, "unique_videos")
    return framebank.sampled_frames(videos, framebank.full_video_shots(videos)).select("video_id", "actual_frame_id", "timestamp_ms")


@_query(f"""WITH v AS ({VIEWS['unique_videos']}), k AS (SELECT DISTINCT 'v' || CAST(l_partkey AS VARCHAR(20)) AS video_id, CAST(l_quantity AS BIGINT) AS f FROM lineitem)
    SELECT video_id, f AS actual_frame_id, CAST(round_even(f * 1000 / fps, 0) AS BIGINT) AS timestamp_ms, 'BTC_KEYFRAME' AS source_policy FROM k JOIN v USING (video_id) WHERE f < total_frames""")
def supplied_keyframes(spark, sf_dir):
    given = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("video_id"), F.col("l_quantity").cast("long").alias("frame_id"))
    return framebank.supplied_keyframes(view(spark, sf_dir, "unique_videos"), given, strict=False).select("video_id", "actual_frame_id", "timestamp_ms", "source_policy")


@_query(f"""WITH v AS (SELECT *, total_frames - 1 AS last, floor((total_frames - 1) / 2.0)::BIGINT AS mid, greatest(1, floor(fps * 5)::BIGINT) AS step FROM ({VIEWS['unique_videos']}) WHERE total_frames > 0),
    p AS (SELECT DISTINCT video_id, unnest(CASE WHEN total_frames / fps <= 5 THEN [mid] WHEN total_frames / fps <= 15 THEN [0, mid, last] ELSE list_concat(range(0, total_frames, step), [last]) END) AS f FROM v),
    n AS (SELECT video_id, f, coalesce(lead(f) OVER (PARTITION BY video_id ORDER BY f), f) AS t FROM p),
    c AS (SELECT video_id, f, t, greatest(1, ceil((t - f) / step)::BIGINT) AS parts FROM n JOIN v USING (video_id))
    SELECT video_id, actual_frame_id, count(*) AS frames FROM (SELECT DISTINCT video_id, f + floor(j * (t - f) / parts)::BIGINT AS actual_frame_id FROM (SELECT *, unnest(range(0, parts)) AS j FROM c)) GROUP BY ALL""")
def adaptive_frames(spark, sf_dir):
    videos = view(spark, sf_dir, "unique_videos")
    found = framebank.adaptive_frames(videos, framebank.full_video_shots(videos))
    return found.groupBy("video_id", "actual_frame_id").agg(F.count("*").alias("frames"))


@_query(f"""WITH n AS ({VIEWS['nodes']}), o AS (SELECT DISTINCT 'n' || CAST(s_nationkey AS VARCHAR(20)) AS node_id, 'owner' || CAST(s_suppkey % 3 AS VARCHAR(20)) AS owner FROM supplier)
    SELECT owner, maturity AS value, count(*) AS nodes FROM n JOIN o USING (node_id) GROUP BY ALL""")
def owner_counts(spark, sf_dir):
    owners = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("node_id")).agg(F.collect_set(F.concat(F.lit("owner"), (F.col("s_suppkey") % 3).cast("string"))).alias("owners"))
    return graph.owner_counts(view(spark, sf_dir, "nodes").join(owners, "node_id"), "maturity")


@_query("""WITH a AS (SELECT c_nationkey % 7 AS k, c_mktsegment AS s, row_number() OVER (PARTITION BY c_nationkey % 7, c_mktsegment) AS i FROM customer),
    b AS (SELECT s_nationkey % 7 AS k, 'BUILDING' AS s, row_number() OVER (PARTITION BY s_nationkey % 7) AS i FROM supplier)
    SELECT k, s, 'expected' AS only_in, count(*) AS rows FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY ALL UNION ALL SELECT k, s, 'found', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY ALL""")
def drift(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 7).alias("k"), F.col("c_mktsegment").alias("s"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 7).alias("k"), F.lit("BUILDING").alias("s"))
    return graph.drift(a, b).groupBy("k", "s", "only_in").agg(F.count("*").alias("rows"))


# --- fusion, suppression, ranking ---

#: A query for each vector whose id is divisible by 50: its neighbours are one branch, those of the next vector the other.
_BRANCH = f"""SELECT q.vec_id - {{k}} AS query_id, 'b{{k}}' AS branch, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = {{k}} QUALIFY rank <= 50"""
_RRF = "WITH b AS (" + " UNION ALL ".join(_BRANCH.format(k=k) for k in (0, 1)) + ")"


def _branches(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    stated = emb.where("vec_id % 50 IN (0, 1)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = index.cosine_topk(emb, stated, 50)
    order = (F.col("query_id") % 50).cast("int")
    return found.select((F.col("query_id") - order).alias("query_id"), F.concat(F.lit("b"), order).alias("branch"), order.alias("branch_order"), F.col("rank").alias("pos"), "rank", F.round("score", 6).alias("score"), F.col("vec_id").cast("string").alias("frame_uid"), (F.col("vec_id") % 10).alias("bucket"), "vec_id")


@_query(f"{_RRF} SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM b GROUP BY query_id, vec_id")
def rrf_two_branch(spark, sf_dir):
    return fusion.reciprocal_rank_fusion(_branches(spark, sf_dir)).select("query_id", "vec_id", F.round("score", 9).alias("score"))


@_query(f"""{_RRF} SELECT query_id, vec_id, round(t, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY t DESC, CAST(vec_id AS VARCHAR)) AS INT) AS rank
    FROM (SELECT query_id, vec_id, coalesce(sum(2.0 / (10 + rank)) FILTER (WHERE branch = 'b0'), 0.0) + coalesce(sum(1.0 / (10 + rank)) FILTER (WHERE branch = 'b1'), 0.0) AS t FROM b GROUP BY query_id, vec_id)""")
def rrf_weighted(spark, sf_dir):
    fused = fusion.reciprocal_rank_fusion(_branches(spark, sf_dir), k=10, weights={"b0": 2.0})
    return fused.select("query_id", "vec_id", F.round("score", 9).alias("score"), "rank")


@_query(f"""{_RRF}, first AS (SELECT query_id, branch, vec_id % 10 AS bucket, min(rank) AS rank FROM b GROUP BY ALL)
    SELECT query_id, bucket, round(coalesce(sum(1.0 / (60 + rank)) FILTER (WHERE branch = 'b0'), 0.0) + coalesce(sum(1.0 / (60 + rank)) FILTER (WHERE branch = 'b1'), 0.0), 9) AS score FROM first GROUP BY query_id, bucket""")
def rrf_dup_key(spark, sf_dir):
    return fusion.reciprocal_rank_fusion(_branches(spark, sf_dir), key=F.col("bucket")).select("query_id", "bucket", F.round("score", 9).alias("score"))


_CANDIDATES = "SELECT label AS video_id, vec_id AS frame_id, round(CAST(embedding[1] AS DOUBLE), 6) AS score, row_number() OVER (ORDER BY round(CAST(embedding[1] AS DOUBLE), 6) DESC, vec_id) AS rank FROM embeddings"


def _candidates(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("video_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    rows = features.numbered(emb.withColumn("down", -F.col("score")), ["down", "frame_id"], "rank").withColumn("rank", (F.col("rank") + 1).cast("int")).drop("down")
    return rows.select(F.lit("q").alias("query_id"), "video_id", "frame_id", F.col("frame_id").cast("string").alias("frame_uid"), "score", "rank", F.concat(F.lit("b"), F.col("frame_id") % 3).alias("source_branch"))


@_query(f"""WITH RECURSIVE c AS ({_CANDIDATES}), o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, rank) AS k FROM c),
    walk AS (SELECT video_id, k, [frame_id] AS kept FROM o WHERE k = 1 UNION ALL
      SELECT o.video_id, o.k, CASE WHEN len(list_filter(w.kept, lambda x: abs(x - o.frame_id) <= 25)) > 0 THEN w.kept ELSE list_append(w.kept, o.frame_id) END FROM walk w JOIN o ON o.video_id = w.video_id AND o.k = w.k + 1),
    fin AS (SELECT video_id, unnest(kept) AS frame_id FROM walk w WHERE k = (SELECT max(k) FROM o WHERE o.video_id = w.video_id))
    SELECT video_id, frame_id, CAST(rank AS INT) AS rank FROM fin JOIN c USING (video_id, frame_id)""")
def nms_dedup(spark, sf_dir):
    return ranking.suppress_nearby(_candidates(spark, sf_dir), 25).select("video_id", "frame_id", "rank")


@_query(f"WITH c AS ({_CANDIDATES}) SELECT video_id, CAST(min(rank) AS INT) AS first_rank, count(*) AS frames, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY rank) AS frame_list FROM c GROUP BY video_id")
def group_by_video(spark, sf_dir):
    out = ranking.group_by_video(_candidates(spark, sf_dir))
    return out.select("video_id", "first_rank", F.size("frames").cast("long").alias("frames"), F.array_join(F.col("frames")["frame_uid"], ",").alias("frame_list"))


_TOP = f"""WITH c AS ({_CANDIDATES}), n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, rank) AS k FROM c),
    s AS (SELECT video_id, {{0}} AS score, CAST(count(*) AS INT) AS matched_event_count, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY k) AS best FROM n WHERE k <= 3 GROUP BY video_id)
    SELECT video_id, round(score, 6) AS score, matched_event_count, best, 'b0,b1,b2' AS branches, CAST(row_number() OVER (ORDER BY score DESC, video_id) AS INT) AS rank FROM s"""


def _ranked_videos(spark, sf_dir, strategy):
    out = ranking.rank_videos(_candidates(spark, sf_dir), strategy)
    return out.select("video_id", F.round("score", 6).alias("score"), "matched_event_count", F.array_join(F.col("best_frames")["frame_uid"], ",").alias("best"), F.array_join("source_branches", ",").alias("branches"), "rank")


@_query(_TOP.format("max(score)"))
def rank_videos_best(spark, sf_dir):
    return _ranked_videos(spark, sf_dir, "best_frame")


@_query(_TOP.format("sum(score ORDER BY k) / count(*)"))
def rank_videos_topk_mean(spark, sf_dir):
    return _ranked_videos(spark, sf_dir, "top_k_mean")


# --- evaluation ---


def _kis_rows(spark, sf_dir):
    lists = view(spark, sf_dir, "ranked").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "video_id", "frame_id"))).alias("predictions"))
    return metrics.scored(view(spark, sf_dir, "truth"), lists, "kis")


@_query(f"{_with('ranked', 'truth')}, {_HITS} SELECT query_id, rank AS pos, CAST(hit AS DOUBLE) AS score FROM hits")
def kis_scores(spark, sf_dir):
    return _kis_rows(spark, sf_dir).select("query_id", "pos", "score")


@_query(f"{_with('ranked', 'truth')}, {_HITS} SELECT query_id, " + ", ".join(f"CAST({_BEST.format(k)} AS DOUBLE) AS r_at_{k}" for k in metrics.CUTOFFS) + " FROM hits GROUP BY query_id")
def kis_at_k(spark, sf_dir):
    return metrics.per_query(_kis_rows(spark, sf_dir)).drop("final", "_truth")


@_query(f"{_with('ranked', 'truth')}, {_HITS} SELECT query_id, round(CAST({_FINAL} AS DOUBLE), 6) AS final FROM hits GROUP BY query_id")
def kis_final(spark, sf_dir):
    return metrics.per_query(_kis_rows(spark, sf_dir)).select("query_id", F.round("final", 6).alias("final"))


@_query(f"{_with('ranked', 'truth')}, {_HITS} SELECT count(*) AS queries, round(avg(f), 6) AS macro_final FROM (SELECT CAST({_FINAL} AS DOUBLE) AS f FROM hits GROUP BY query_id)")
def macro_final(spark, sf_dir):
    lists = view(spark, sf_dir, "ranked").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "video_id", "frame_id"))).alias("predictions"))
    return metrics.evaluate(view(spark, sf_dir, "truth"), lists, "kis")[1].withColumn("macro_final", F.round("macro_final", 6))


@_query(r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS answer FROM conversations")
def answer_normalize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_answer(F.col("text")).alias("answer"))


@_query(r"""SELECT conv_id, turn, CAST(CASE WHEN (turn % 2 = 0 OR length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) = 0) AND turn BETWEEN 0 AND 4 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM conversations WHERE text IS NOT NULL""")
def qa_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    given = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  "), F.regexp_replace("text", " ", " \t "), F.lit("\n"))).otherwise(F.concat("text", F.when(F.length(text.normalize_answer(F.col("text"))) == 0, F.lit("")).otherwise(F.lit("x"))))
    p = F.struct(F.lit("v").alias("video_id"), F.col("turn").alias("frame_id"), F.lower(given).alias("answer"))
    g = F.struct(F.lit("v").alias("video_id"), F.lit(0).alias("start_frame"), F.lit(4).alias("end_frame"), F.array(F.col("text"), F.lit("~")).alias("accepted_answers"))
    return rows.withColumns({"p": p, "g": g}).select("conv_id", "turn", metrics.qa_score(F.col("p"), F.col("g")).alias("score"))


@_query(f"""{_with('trake')} SELECT l_orderkey, count(*) AS events, round(sum(CASE WHEN l_quantity + (l_orderkey + k) % 9 - 2 BETWEEN l_quantity - 5 AND l_quantity + 5 THEN 1 ELSE 0 END) / count(*), 6) AS score FROM trake GROUP BY l_orderkey""")
def trake_scores(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    rows = view(spark, sf_dir, "trake").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", (q + (F.col("l_orderkey") + F.col("k")) % 9 - 2).alias("f"), F.array(q - 5, q + 5).alias("s")))).alias("e"))
    p = F.struct(F.lit("v").alias("video_id"), F.col("e")["f"].alias("frame_ids"))
    g = F.struct(F.lit("v").alias("video_id"), F.col("e")["s"].alias("intervals"))
    return rows.withColumns({"p": p, "g": g}).select("l_orderkey", F.size("e").cast("long").alias("events"), F.round(metrics.trake_score(F.col("p"), F.col("g")), 6).alias("score"))


@_query(f"{_with('ranked', 'truth')}, {_HITS} SELECT query_id, round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0.0), 6) AS rr FROM hits GROUP BY query_id")
def reciprocal_rank(spark, sf_dir):
    rows = _kis_rows(spark, sf_dir).select("query_id", F.col("pos").alias("rank"), (F.col("score") == 1).alias("relevant"))
    return rows.groupBy("query_id").agg(F.round(metrics.reciprocal_rank(), 6).alias("rr"))


@_query(f"{_with('ranked', 'truth')}, {_HITS} SELECT query_id, round(sum(CASE WHEN hit = 1 AND rank <= 20 THEN 1 ELSE 0 END) / sum(hit), 6) AS recall_at_20 FROM hits GROUP BY query_id HAVING sum(hit) > 0")
def recall_at_k(spark, sf_dir):
    rows = _kis_rows(spark, sf_dir).select("query_id", F.col("pos").alias("rank"), (F.col("score") == 1).alias("relevant"))
    total = F.sum(F.col("relevant").cast("int"))
    found = rows.groupBy("query_id").agg(total.alias("total"), F.sum((F.col("relevant") & (F.col("rank") <= 20)).cast("int")).alias("_"), F.collect_list(F.struct("relevant", "rank")).alias("r"))
    kept = found.where("total > 0").select("query_id", "total", F.explode("r").alias("r")).select("query_id", "total", "r.*")
    return kept.groupBy("query_id", "total").agg(F.round(metrics.recall_at(20, F.col("total")), 6).alias("recall_at_20")).drop("total")


# --- audits and record checks ---


@_query(f"{_with('videos')} SELECT count(*) AS total_videos, CAST(sum(total_frames) AS BIGINT) AS total_frames, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms FROM videos")
def audit_totals(spark, sf_dir):
    return audit.totals(view(spark, sf_dir, "videos"))


@_query(f"{_with('videos')} SELECT video_id FROM videos GROUP BY video_id HAVING count(*) > 1")
def dup_video_ids(spark, sf_dir):
    return audit.duplicate_video_ids(view(spark, sf_dir, "videos"))


_BAD = "(replace(relative_path, chr(92), '/') = '' OR replace(relative_path, chr(92), '/') LIKE '/%' OR list_contains(string_split(replace(relative_path, chr(92), '/'), '/'), '..'))"


@_query(f"{_with('videos')} SELECT p_partkey, relative_path FROM videos WHERE {_BAD}")
def bad_paths(spark, sf_dir):
    return audit.invalid_paths(view(spark, sf_dir, "videos")).select("p_partkey", "relative_path")


@_query(f"{_with('videos')} SELECT p_partkey FROM videos WHERE NOT {_BAD} AND p_partkey % 4 = 1")
def missing_paths(spark, sf_dir):
    videos = view(spark, sf_dir, "videos")
    return audit.missing_paths(videos, videos.where("p_partkey % 4 <> 1").select("relative_path")).select("p_partkey")


@_query(f"""{_with('videos')}, m AS (SELECT * FROM videos WHERE NOT {_BAD} AND p_partkey % 4 = 1) SELECT (SELECT count(*) FROM videos) AS total_videos, (SELECT count(*) FROM m) AS missing,
    (SELECT count(*) FROM (SELECT video_id FROM videos GROUP BY 1 HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM videos WHERE {_BAD}) AS invalid""")
def audit_report(spark, sf_dir):
    videos = view(spark, sf_dir, "videos")
    out = audit.report(videos, videos.where("p_partkey % 4 <> 1").select("relative_path"))
    return out.select("total_videos", *(F.size(c).cast("long").alias(a) for c, a in (("missing_paths", "missing"), ("duplicate_video_ids", "duplicates"), ("invalid_records", "invalid"))))


@_query(f"""{_with('videos')} SELECT p_partkey, CAST((CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END) AS INT) AS violations
    FROM videos WHERE p_partkey % 13 = 0 OR p_partkey % 17 = 0 OR p_partkey % 19 = 0""")
def record_violations(spark, sf_dir):
    videos = view(spark, sf_dir, "videos")
    broken = videos.withColumns({
        "fps": F.when(F.col("p_partkey") % 13 == 0, -F.col("fps")).otherwise(F.col("fps")),
        "video_id": F.when(F.col("p_partkey") % 17 == 0, F.lit(" \t ")).otherwise(F.col("video_id")),
        "duration_ms": F.when(F.col("p_partkey") % 19 == 0, -F.col("duration_ms") - 1).otherwise(F.col("duration_ms")),
    })
    return schema.with_violations(broken, "video").where("size(violations) > 0").select("p_partkey", F.size("violations").alias("violations"))


# --- graph checks ---


@_query(f"""{_with('nodes', 'edges')} SELECT page_id, source, target, e AS missing_end FROM edges, (SELECT unnest(['source', 'target']) AS e)
    WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.page_id = edges.page_id AND n.node_id = CASE WHEN e = 'source' THEN source ELSE target END)""")
def graph_orphans(spark, sf_dir):
    return graph.orphan_edges(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"))


@_query(f"""{_with('nodes', 'edges')}, i AS (SELECT page_id, target AS node_id, list_sort(list(DISTINCT source)) AS s FROM edges GROUP BY ALL), o AS (SELECT page_id, source AS node_id, list_sort(list(DISTINCT target)) AS t FROM edges GROUP BY ALL)
    SELECT page_id, node_id, coalesce(array_to_string(s, ','), '') AS unstated, coalesce(array_to_string(list_filter(t, lambda x: x <> 'n1'), ','), '') AS unstated_next, CASE WHEN list_contains(coalesce(t, []), 'n1') THEN '' ELSE 'n1' END AS false_next
    FROM nodes LEFT JOIN i USING (page_id, node_id) LEFT JOIN o USING (page_id, node_id) WHERE s IS NOT NULL OR len(list_filter(coalesce(t, []), lambda x: x <> 'n1')) > 0 OR NOT list_contains(coalesce(t, []), 'n1')""")
def dep_set_equality(spark, sf_dir):
    nodes = view(spark, sf_dir, "nodes").withColumns({"dependencies": F.array().cast("array<string>"), "next_modules": F.array(F.lit("n1"))})
    out = graph.dependency_faults(nodes, view(spark, sf_dir, "edges"))
    return out.select("page_id", "node_id", F.array_join("unstated_dependencies", ",").alias("unstated"), F.array_join("unstated_next", ",").alias("unstated_next"), F.array_join("false_next", ",").alias("false_next"))


@_query(f"""{_with('rectangles')} SELECT a.page_id, a.node_id AS a, b.node_id AS b FROM rectangles a JOIN rectangles b ON a.page_id = b.page_id AND a.node_id < b.node_id
    AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h""")
def rect_overlaps(spark, sf_dir):
    return graph.overlaps(view(spark, sf_dir, "rectangles"))


@_query(f"""{_with('rectangles')}, p AS (SELECT a.page_id, a.node_id AS a, b.node_id AS b, greatest(b.x - a.x - a.w, a.x - b.x - b.w, 0) AS dx, greatest(b.y - a.y - a.h, a.y - b.y - b.h, 0) AS dy
    FROM rectangles a JOIN rectangles b ON a.page_id = b.page_id AND a.node_id < b.node_id) SELECT page_id, a, b FROM p WHERE (dx = 0 AND dy > 0 AND dy < 40) OR (dy = 0 AND dx > 0 AND dx < 40)""")
def tight_gaps(spark, sf_dir):
    return graph.tight_gaps(view(spark, sf_dir, "rectangles"))


@_query(f"{_with('rectangles')} SELECT page_id, max(x + w) + 20 AS width, max(y + h) + 20 AS height, count(*) AS nodes, round((max(x + w) + 20) / (max(y + h) + 20), 3) AS aspect FROM rectangles GROUP BY page_id")
def page_bounds(spark, sf_dir):
    return graph.page_bounds(view(spark, sf_dir, "rectangles"))


@_query(f"""{_with('nodes', 'edges')} SELECT page_id, node_id, (SELECT count(*) FROM edges e WHERE e.page_id = n.page_id AND e.target = n.node_id) AS in_degree, (SELECT count(*) FROM edges e WHERE e.page_id = n.page_id AND e.source = n.node_id) AS out_degree FROM nodes n""")
def degree_stats(spark, sf_dir):
    return graph.degrees(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"))


@_query(f"{_with('nodes')} SELECT 'maturity' AS field, maturity AS value, count(*) AS nodes FROM nodes GROUP BY maturity UNION ALL SELECT 'criticality', criticality, count(*) FROM nodes GROUP BY criticality")
def label_counts(spark, sf_dir):
    return graph.label_counts(view(spark, sf_dir, "nodes"), "maturity", "criticality")


@_query(f"""{_with('nodes', 'edges')} SELECT page_id, 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, line) AS text FROM (
    SELECT page_id, 0 AS part, '    ' || node_id || '["' || title || '"]' AS line FROM nodes UNION ALL SELECT page_id, 1, '    ' || source || ' --> ' || target FROM edges) GROUP BY page_id""")
def flowchart_text(spark, sf_dir):
    return graph.mermaid(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges").withColumn("label", F.lit("")))


# --- chains of events ---


@_query("""WITH c AS (SELECT user_id, CAST(epoch_ms(ts) AS BIGINT) AS f, round(value, 4) AS s, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS e FROM events)
    SELECT CAST(a.user_id AS VARCHAR) AS query_id, round(max(a.s + b.s + d.s), 4) AS chain_score FROM c a JOIN c b ON a.user_id = b.user_id AND a.e = 0 AND b.e = 1 AND a.f < b.f JOIN c d ON d.user_id = b.user_id AND d.e = 2 AND b.f < d.f GROUP BY 1""")
def chain_best(spark, sf_dir):
    number = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.lit("v").alias("video_id"), number.alias("event"), F.unix_millis(F.col("ts").cast("timestamp")).alias("frame_id"), F.round("value", 4).alias("score"))
    return temporal.best_chains(rows.where("event IS NOT NULL"), 3, 1).select("query_id", F.round("chain_score", 4).alias("chain_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
