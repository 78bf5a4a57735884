"""Scores of ranked answers: known-item search, question answering and temporal events, at rank cutoffs.

Scorers are columns over a row that has the prediction in struct p and the ground truth in struct g.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.text import exact_answer_match

#: The cutoffs of the final score.
CUTOFFS = (1, 5, 20, 50, 100)


def located(p: Column, g: Column) -> Column:
    """The right video (missing equals missing) and a frame within the bounds; a missing frame counts as -1."""
    frame = F.coalesce(p["frame_id"], F.lit(-1))
    return p["video_id"].eqNullSafe(g["video_id"]) & F.coalesce(frame.between(g["start_frame"], g["end_frame"]), F.lit(False))


def kis_score(p: Column, g: Column) -> Column:
    return located(p, g).cast("double")


def qa_score(p: Column, g: Column, matcher: Callable[[Column, Column], Column] = exact_answer_match) -> Column:
    return (located(p, g) & F.coalesce(matcher(p["answer"], g["accepted_answers"]), F.lit(False))).cast("double")


def trake_score(p: Column, g: Column, strict: bool = True) -> Column:
    """Share of events whose frame lies in its interval; 0 for another video. Malformed rows are errors, or null if not strict."""
    frames, spans = p["frame_ids"], g["intervals"]
    fault = lambda message: F.raise_error(F.lit(message)).cast("double") if strict else F.lit(None).cast("double")
    hits = F.aggregate(F.zip_with(frames, spans, lambda f, s: F.coalesce(f.between(s[0], s[1]), F.lit(False)).cast("int")), F.lit(0), lambda a, x: a + x)
    return (
        F.when(F.coalesce(F.size(spans), F.lit(-1)) < 1, fault("ground truth without an interval"))
        .when(F.coalesce(F.size(frames), F.lit(-1)) != F.size(spans), fault("as many frames as intervals are needed"))
        .when(~p["video_id"].eqNullSafe(g["video_id"]), F.lit(0.0))
        .when(F.exists(spans, lambda s: F.coalesce(F.size(s), F.lit(-1)) != 2), fault("an interval needs a first and a last frame"))
        .otherwise(hits / F.size(spans))
    )


SCORERS = {"kis": kis_score, "qa": qa_score, "trake": trake_score}


def best_at(k: int, pos: str = "pos", score: str = "score") -> Column:
    """Aggregate: the best score among the first k places, 0 without any."""
    if k <= 0:
        raise ValueError("a cutoff has to be positive")
    return F.coalesce(F.max(F.when(F.col(pos) <= k, F.col(score))), F.lit(0.0))


def scored(truths: DataFrame, predictions: DataFrame, task: str) -> DataFrame:
    """A row for each truth and place of its prediction list (pos from 1; null without any), with score.

    truths: query_id and the truth's columns. predictions: query_id, predictions (array, in rank order) and optionally
    group_order; of several lists of a query the last counts. Lists of other queries are ignored.
    """
    scorer = SCORERS[task]
    if "group_order" in predictions.columns:
        predictions = predictions.groupBy("query_id").agg(F.max_by("predictions", "group_order").alias("predictions"))
    truth_columns = [c for c in truths.columns if c != "query_id"]
    rows = truths.withColumn("_truth", F.monotonically_increasing_id()).select("query_id", "_truth", F.struct(*truth_columns).alias("g"))
    joined = rows.join(predictions.select("query_id", "predictions"), "query_id", "left")
    places = joined.select("query_id", "_truth", "g", F.posexplode_outer("predictions").alias("_k", "p"))
    return places.select("query_id", "_truth", (F.col("_k") + 1).alias("pos"), F.when(F.col("_k").isNotNull(), scorer(F.col("p"), F.col("g"))).alias("score"))


def per_query(rows: DataFrame, by: tuple[str, ...] = ("query_id", "_truth"), cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """by, r_at_k for each cutoff, and final, their mean, from rows with pos and score."""
    out = rows.groupBy(*by).agg(*(best_at(k).alias(f"r_at_{k}") for k in cutoffs))
    total = F.col(f"r_at_{cutoffs[0]}")
    for k in cutoffs[1:]:
        total = total + F.col(f"r_at_{k}")
    return out.withColumn("final", total / len(cutoffs))


def final_from(scores: Column, cutoffs: tuple[int, ...] = CUTOFFS) -> Column:
    """The final score from a map of cutoff to score; a missing cutoff is an error."""
    total = F.lit(0.0)
    for k in cutoffs:
        total = total + F.coalesce(F.element_at(scores, F.lit(k)), F.raise_error(F.lit(f"no score at cutoff {k}")).cast("double"))
    return total / len(cutoffs)


def evaluate(truths: DataFrame, predictions: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """Scores of each query, and one row with their number and mean final score (0 without a query)."""
    queries = per_query(scored(truths, predictions, task)).drop("_truth")
    return queries, queries.agg(F.count("*").alias("queries"), F.coalesce(F.avg("final"), F.lit(0.0)).alias("macro_final"))


def reciprocal_rank(relevant: str = "relevant", rank: str = "rank") -> Column:
    """Aggregate: 1 over the first relevant rank, 0 without one."""
    return F.coalesce(1 / F.min(F.when(F.col(relevant), F.col(rank))), F.lit(0.0))


def recall_at(k: int, total: Column, relevant: str = "relevant", rank: str = "rank") -> Column:
    """Aggregate: relevant rows among the first k over total."""
    if k <= 0:
        raise ValueError("a cutoff has to be positive")
    hits = F.coalesce(F.sum(F.when(F.col(relevant) & (F.col(rank) <= k), 1)), F.lit(0))
    return F.when(total > 0, hits / total).otherwise(F.raise_error(F.lit("recall needs a positive total")).cast("double"))
