"""Readings that a recorder can't have measured: spikes, physical impossibilities and frozen stretches, per source."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.isolation import isolation_scores
from traceloom.operators.grouped import starts_of, whole_groups

#: A source is judged in pieces of so many positions, each with a margin on both sides, so that a hot source is many groups.
PIECE, MARGIN = 4096, 512

#: Neighbours on each side that say what a reading should have been.
REACH = 4

#: A spike lies at least so many noise units from its neighbours, and so many outside the range that its source's smoothed
#: course takes.  Events rise over several readings and stay well below either.
FAR, OUTSIDE = 22.0, 22.0

#: Where a neighbour next to it stands between these shares of the way, the reading is the top of a rise, not a spike.
ON_THE_WAY = (0.2, 0.8)

#: The forest must find a spike at least this isolated.  At scale 0.1 half of all readings score below 0.477 and 92 % below
#: this; what the limits alone would take for a spike scores 0.544 at least.
ISOLATED = 0.54

# The physical range of a reading, a mean of 16-bit counts: it is never negative and never above the top count.
LEAST, MOST = 0.0, 65_535.0

#: Rows that a task works through at once, beside the rest of the last piece.
BATCH = 65_536

#: A frozen stretch has at least this many equal readings, and fewer than ``BY_CHANCE`` such stretches are to be expected.
FROZEN, BY_CHANCE = 15, 0.02


def readings(trace_samples: DataFrame, signal_frames: DataFrame, frame_tracks: DataFrame) -> DataFrame:
    """``(table_name, series_key, pos, value)`` of every reading; nulls are kept out later, repeated rows too."""
    traces = trace_samples.select(F.lit("trace_samples").alias("table_name"), F.col("trace_id").alias("series_key"), F.col("idx").alias("pos"), F.col("raw").alias("value"))
    frames = signal_frames.select("source_tiff", "frame", F.posexplode("signals").alias("i", "value")).select(
        F.lit("signal_frames").alias("table_name"), F.concat_ws("#", "source_tiff", (F.col("i") + 1).cast("string")).alias("series_key"), F.col("frame").alias("pos"), "value"
    )
    tracks = frame_tracks.select(
        F.lit("frame_tracks").alias("table_name"), F.concat("source_tiff", F.lit("#"), F.col("mask_index").cast("string")).alias("series_key"), F.col("frame").alias("pos"), F.col("signal").alias("value")
    )
    return traces.unionByName(frames).unionByName(tracks)


def _segments(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))


def run_lengths(v: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """For each value the length of the stretch of equal values of its source that it belongs to."""
    edges = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (segment[1:] != segment[:-1]), True])
    return np.repeat(np.diff(edges), np.diff(edges))


def neighbours(v: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Median of the ``REACH`` readings of the same source on either side, without the reading itself."""
    n = len(v)
    around = np.full((n, 2 * REACH), np.nan)
    for i in range(1, REACH + 1):
        same = segment[i:] == segment[:-i]
        around[i:, i - 1][same] = v[:-i][same]
        around[:-i, REACH + i - 1][same] = v[i:][same]
    around.sort(axis=1)
    have = 2 * REACH - np.isnan(around).sum(axis=1)
    rows = np.arange(n)
    last = np.maximum(have - 1, 0)
    middle = (around[rows, last // 2] + around[rows, np.minimum(have // 2, last)]) / 2
    return np.where(have > 0, middle, v)


def _ranked(x: np.ndarray, segment: np.ndarray, starts: np.ndarray, counts: np.ndarray, shares: tuple[float, ...]) -> list[np.ndarray]:
    """Values at given shares of each source's sorted values; 0 for a source without any."""
    ordered = x[np.lexsort((x, segment))]
    out = []
    for share in shares:
        at = starts + np.minimum((counts * share).astype(np.int64), np.maximum(counts - 1, 0))
        out.append(np.where(counts > 0, ordered[np.minimum(at, max(len(x) - 1, 0))] if len(x) else 0.0, 0.0))
    return out


def noise_of(v: np.ndarray, segment: np.ndarray, sources: int) -> np.ndarray:
    """Reading-to-reading noise of each source: the median step, or for coarsely rounded readings half of the rounding step."""
    step, own = np.abs(np.diff(v)), segment[1:]
    inside = own == segment[:-1]
    step, own = step[inside], own[inside]

    def shares(keep, share):
        counts = np.bincount(own[keep], minlength=sources)
        return _ranked(step[keep], own[keep], np.cumsum(counts) - counts, counts, (share,))[0]

    usual = shares(np.ones(len(step), bool), 0.5)
    rounding = shares(step > 0, 0.1)
    return np.maximum(np.where(usual == 0, rounding * 0.5, usual / 0.954), 1e-9)


def seasonal_residual(smooth: np.ndarray, v: np.ndarray, segment: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Readings less the mean smoothed course at their phase of the source's strongest period."""
    counts = np.diff(np.r_[starts, len(v)])
    period = np.ones(len(starts), dtype=np.int64)
    for i, (a, c) in enumerate(zip(starts, counts)):
        if c >= 16:
            course = smooth[a : a + c]
            power = np.abs(np.fft.rfft(course - course.mean()))
            period[i] = max(2, round(c / (int(np.argmax(power[2 : c // 4 + 1])) + 2)))
    phase = (np.arange(len(v)) - starts[segment]) % period[segment]
    slot = (np.cumsum(period) - period)[segment] + phase
    level = np.bincount(slot, smooth) / np.maximum(np.bincount(slot), 1)
    return v - level[slot]


def judge(pos: np.ndarray, value: np.ndarray, starts: np.ndarray | None = None, seeds: np.ndarray | None = None) -> pd.DataFrame:
    """Score and flags of the finite readings of one or more sources: ``row, pos, value, score, spike, frozen, out_of_range``.

    Readings of a source, which begins at each of ``starts``, are in order of position; ``row`` is the place in the input.
    Repeated positions count once.  Sources of under five readings get no score and no flag.  ``seeds`` has a number for each
    source, from which its forest is drawn.
    """
    starts = np.zeros(min(len(pos), 1), dtype=np.int64) if starts is None else starts
    source = _segments(starts, len(pos))
    kept = np.isfinite(value)
    rows = np.flatnonzero(kept)
    again = (pos[rows][1:] == pos[rows][:-1]) & (source[rows][1:] == source[rows][:-1])
    rows = rows[np.r_[True, ~again]] if len(rows) else rows
    # sources without any reading left drop out
    left, first, segment = np.unique(source[rows], return_index=True, return_inverse=True)
    v, n, sources = value[rows].astype(float), len(rows), len(first)
    if not n:
        return pd.DataFrame({"row": rows, "pos": pos[rows], "value": v, "score": np.zeros(0), "spike": np.zeros(0, bool), "frozen": np.zeros(0, bool), "out_of_range": np.zeros(0, bool)})
    counts = np.diff(np.r_[first, n])
    noise = noise_of(v, segment, sources)[segment]
    middle = neighbours(v, segment)
    away = np.abs(v - middle)
    # the range of a source is that of its smoothed course, where nothing far off draws the medians along
    calm = away <= FAR * noise
    lo, hi = np.minimum.reduceat(np.where(calm, np.maximum(middle, v - noise), np.inf), first), np.maximum.reduceat(np.where(calm, np.minimum(middle, v + noise), -np.inf), first)
    outside = np.maximum(np.maximum(v - hi[segment], lo[segment] - v), 0)
    runs = run_lengths(v, segment)
    squeezed = lambda a: np.sign(a) * np.log1p(np.abs(a))
    level = _ranked(v, segment, first, counts, (0.5,))[0][segment]
    step = np.r_[0.0, np.where(segment[1:] == segment[:-1], np.diff(v), 0.0)]
    features = np.column_stack(
        [squeezed((v - level) / noise), squeezed((v - middle) / noise), squeezed(seasonal_residual(middle, v, segment, first) / noise), squeezed(step / noise), np.log(runs)]
    )
    score = isolation_scores(features, first, seeds=None if seeds is None else seeds[left])
    jump = np.where(away > 0, v - middle, 1.0)
    inside = segment[1:] == segment[:-1]
    before = np.r_[0.0, np.where(inside, v[:-1] - middle[1:], 0.0)] / jump
    after = np.r_[np.where(inside, v[1:] - middle[:-1], 0.0), 0.0] / jump
    rising = ((before > ON_THE_WAY[0]) & (before < ON_THE_WAY[1])) | ((after > ON_THE_WAY[0]) & (after < ON_THE_WAY[1]))
    enough = (counts >= 5)[segment]
    spike = (away > FAR * noise) & (outside > OUTSIDE * noise) & (score >= ISOLATED) & ~rising & enough
    long = runs >= FROZEN
    same = np.r_[False, (v[1:] == v[:-1]) & inside]
    usual = ~np.r_[False, long[1:] & long[:-1] & inside] & np.r_[False, inside]
    repeats, pairs = np.bincount(segment, same & usual, sources), np.bincount(segment, usual, sources)
    chance = np.clip((repeats + 0.5) / (pairs + 1), 1e-3, 0.999)[segment]
    frozen = long & enough & (np.log(counts)[segment] + (runs - 1) * np.log(chance) < np.log(BY_CHANCE))
    out = (v < LEAST) | (v > MOST)
    return pd.DataFrame({"row": rows, "pos": pos[rows], "value": v, "score": np.where(enough, score, 0.0), "spike": spike, "frozen": frozen, "out_of_range": out})


def score_readings(rows: DataFrame) -> DataFrame:
    """Every finite reading of ``(table_name, series_key, pos, value)`` with ``score``, ``spike``, ``frozen`` and ``out_of_range``.

    Each piece of a source gets an isolation forest over level, difference, seasonal and run-length features, relative to
    that piece's own noise, drawn by a number of that piece alone; then limits that no event or drift can pass decide, and the physical range of a
    reading, which holds for sources of any length.  Null, NaN and infinite readings and rows
    without a key or position are left out; repeated rows count once; sources of under five readings are only passed on.
    A source of any length is cut into pieces of ``PIECE`` positions with ``MARGIN`` more on either side, so no task
    holds a whole hot source, and every reading is judged in one piece only.  Spark brings the readings of a piece together
    in order; a task works through many pieces at once.
    """
    finite = rows.where("value is not null and not isnan(value) and abs(value) < double('infinity') and pos is not null and series_key is not null")
    own = F.floor(F.col("pos") / PIECE)
    at = F.pmod("pos", F.lit(PIECE))
    pieces = F.array_compact(F.array(own, F.when((at < MARGIN) & (own > 0), own - 1), F.when(at >= PIECE - MARGIN, own + 1)))
    split = finite.select("table_name", "series_key", F.explode(pieces).alias("piece"), F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))
    keys = ["table_name", "series_key", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, BATCH):
            pos = table.column("pos").to_numpy()
            starts = starts_of(table, keys)
            named = table.select(keys).take(pa.array(starts)).to_pylist()
            seeds = np.array([zlib.crc32("\0".join(str(r[k]) for k in keys).encode()) for r in named], dtype=np.uint64)
            out = judge(pos, table.column("value").to_numpy(), starts, seeds)
            out = out[(out["pos"] // PIECE).to_numpy() == table.column("piece").to_numpy()[out["row"]]]
            picked = table.take(pa.array(out["row"].to_numpy())).select(["table_name", "series_key", "pos", "value"])
            for name, kind in (("score", pa.float64()), ("spike", pa.bool_()), ("frozen", pa.bool_()), ("out_of_range", pa.bool_())):
                picked = picked.append_column(name, pa.array(out[name].to_numpy(), kind))
            yield from picked.to_batches()

    schema = "table_name string, series_key string, pos bigint, value double, score double, spike boolean, frozen boolean, out_of_range boolean"
    return split.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(run, schema)


def implausible(scored: DataFrame) -> DataFrame:
    """``(table_name, series_key, pos)`` of the readings that can't have been measured."""
    return scored.where("spike or frozen or out_of_range").select("table_name", "series_key", "pos")
