"""Chains of events in time order (own design for a planned solver): one candidate an event, frames strictly rising.

A chain's score is the sum of its candidates' scores. For each event in turn the best chains that end at each candidate are
those of the best prefixes that end before it, so a video costs its candidates times the chains kept, not all combinations.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame

CHAIN = "query_id string, video_id string, chain_rank int, chain_score double, frame_ids array<long>, events int"


def best_chains(candidates: DataFrame, events: int, top_m: int = 3) -> DataFrame:
    """The top_m chains of each query_id and video_id. candidates: event (0 to events - 1), frame_id, score."""
    if events <= 0 or top_m <= 0:
        raise ValueError("events and top_m have to be positive")

    def solve(key, table):
        by: dict[int, list[tuple[int, float]]] = {e: [] for e in range(events)}
        for e, f, s in zip(*(table.column(c).to_pylist() for c in ("event", "frame_id", "score")), strict=True):
            if e in by:
                by[e].append((f, s))
        chains = [(0.0, ())]  # of the events so far, for the first event a single empty one
        for e in range(events):
            chains.sort(key=lambda c: c[1][-1] if c[1] else -1)
            out, heap, at = [], [], 0
            for f, s in sorted(by[e]):
                while at < len(chains) and (not chains[at][1] or chains[at][1][-1] < f):
                    heapq.heappush(heap, (chains[at][0], tuple(-x for x in chains[at][1]), chains[at][1]))
                    if len(heap) > top_m:
                        heapq.heappop(heap)
                    at += 1
                out += [(total + s, (*frames, f)) for total, _, frames in heap]
            chains = out
        best = sorted(chains, key=lambda c: (-c[0], c[1]))[:top_m]
        names = [key[0].as_py()] * len(best), [key[1].as_py()] * len(best)
        columns = [*names, range(1, len(best) + 1), [c[0] for c in best], [list(c[1]) for c in best], [events] * len(best)]
        kinds = pa.string(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.int32()
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query_id", "video_id", "chain_rank", "chain_score", "frame_ids", "events"])

    rows = candidates.selectExpr("CAST(query_id AS STRING) query_id", "CAST(video_id AS STRING) video_id", "CAST(event AS INT) event", "CAST(frame_id AS BIGINT) frame_id", "CAST(score AS DOUBLE) score")
    return rows.groupBy("query_id", "video_id").applyInArrow(solve, CHAIN)
