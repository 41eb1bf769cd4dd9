"""Incremental forms for Structured Streaming: what needs no whole trace, and a tracker that keeps state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def roi_means(frames: DataFrame, tile: int, width: int) -> DataFrame:
    """Means of the tiles of frames as they arrive: ``(stack, frame, roi, value)``.  Stateless: one row in, one per tile out."""
    across = width // tile

    def mean(pixels, i: int):
        rows = [F.slice(pixels, (i // across * tile + r) * width + i % across * tile + 1, tile) for r in range(tile)]
        return F.aggregate(F.flatten(F.array(*rows)), F.lit(0.0), lambda s, v: s + v) / (tile * tile)

    values = F.array(*(mean(F.col("pixels"), i) for i in range(across * across)))
    out = frames.select("stack", "frame", F.posexplode(values).alias("i", "value"))
    return out.select("stack", "frame", (F.col("i") + 1).alias("roi"), "value")


def frozen_threshold_spikes(samples: DataFrame, levels: DataFrame) -> DataFrame:
    """Samples above their trace's threshold from a calibration run; ``levels`` is a static table ``(trace_id, threshold)``."""
    return samples.join(levels, "trace_id").where("value > threshold")


def windowed_means(samples: DataFrame, event_time: str, window: str, late: str) -> DataFrame:
    """Means by trace in tumbling windows of event time; rows later than ``late`` are dropped."""
    return samples.withWatermark(event_time, late).groupBy("trace_id", F.window(event_time, window)).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def activity_sessions(events: DataFrame, event_time: str, gap: str, late: str) -> DataFrame:
    """Sessions of activity by trace that a pause of ``gap`` ends."""
    return events.withWatermark(event_time, late).groupBy("trace_id", F.session_window(event_time, gap)).agg(F.count("*").alias("events"))


def run_tracker(events: DataFrame) -> DataFrame:
    """Runs of equal kinds per entity over a stream of ``(entity, pos, kind)`` in order: a run comes out when it ends.

    State is the open run of each entity; what is still open at the end stays in the state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, first, last, n = state.get if state.exists else (None, 0, 0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values("pos").itertuples(index=False):
            if kind == r.kind and r.pos == last + 1:
                last, n = int(r.pos), n + 1
            else:
                if kind is not None:
                    out.append((key[0], kind, first, last, n))
                kind, first, last, n = r.kind, int(r.pos), int(r.pos), 1
        state.update((kind, first, last, n))
        yield pd.DataFrame(out, columns=["entity", "kind", "first_pos", "last_pos", "n"])

    return events.groupBy("entity").applyInPandasWithState(
        step, "entity string, kind string, first_pos bigint, last_pos bigint, n bigint", "kind string, first_pos bigint, last_pos bigint, n bigint", "append", GroupStateTimeout.NoTimeout
    )
