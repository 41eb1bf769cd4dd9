"""Events in traces: spikes over a threshold, plateaus by a trigger with two thresholds, downward dropouts, their shapes.

Thresholds and noise come from native aggregates per trace and are joined to the samples.  What needs the order of samples
runs over pieces of a trace with a halo of neighbours, so a trace of any length is many groups; an event belongs to the piece
that it starts in, and is found whole as long as it and what it depends on lie within the halo.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.peaks import find_peaks, prominences, zero_phase_butterworth
from traceloom.functions.scalars import finite
from traceloom.operators import masks, stats
from traceloom.operators.grouped import map_groups
from traceloom.operators.ordered import bucketed_lag
from traceloom.operators.signals import aligned_windows, lagged, lagged_snr, numbered, rolling_rank, with_halo
from traceloom.session import cut_lineage

#: Samples in a piece and in the halo on either side of it.
PIECE, HALO = 65_536, 8_192


def maxima(rows: DataFrame, passed: list[str]) -> DataFrame:
    """The rows of ``(trace_id, idx, score, threshold, far, least, ...)`` that are peaks of ``score``, with ``prominence``.

    Peaks are at least ``threshold`` high; of those closer than ``far`` rows the highest stays; they must be ``least`` prominent,
    for which ``HALO`` rows on either side are looked at.  The last three are the same for all rows of a trace.  Rows without a
    score never are peaks and bound prominences.
    """
    held = with_halo(numbered(rows), HALO, PIECE, "row")

    def run(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        x = np.where(np.isfinite(g["score"]), g["score"], -np.inf)
        at = find_peaks(x, g["threshold"][0], int(g["far"][0]))
        height = prominences(x, at, HALO)
        kept = g["own"][at].astype(bool) & (height >= g["least"][0])
        return at[kept], {"prominence": height[kept]}

    return map_groups(held, ["trace_id", "piece"], "idx", run, ["trace_id", "idx", *passed], {"prominence": "double"}, used=["score", "threshold", "least", "far", "own"])


def threshold_spikes(df: DataFrame, column: str, k: float = 5.0, prominence_k: float = 2.0, distance: int | str = 10, mode: str = "std", baseline: str | None = None, blocked: Column | None = None, lag: int | str = 5) -> DataFrame:
    """``(trace_id, spike_index, spike_time, value, baseline, threshold, amplitude, prominence, noise, snr)`` of the maxima of each trace
    above its threshold.

    The threshold is centre and ``k`` noises (``noise_std``, or ``noise_mad`` with mode ``mad``); with mode ``snr`` the trace is
    first turned into its change over ``lag`` samples in units of its mean step (``lagged_snr``) and ``k`` is the threshold itself.
    Of maxima closer than ``distance`` the highest stays; but for mode ``snr`` peaks must be ``prominence_k`` noises prominent, for which
    ``HALO`` samples on either side are looked at.  ``distance`` and ``lag`` may be columns, as where traces have their own
    rates.  Amplitudes are above ``baseline``, or the centre where none is given; ``noise`` is the mean absolute step and
    ``snr`` the amplitude in units of it.  Blocked samples and missing values never are peaks, bound prominences and count for nothing.
    """
    rows = df.withColumn("value", finite(F.col(column))).withColumn("ok", F.col("value").isNotNull() & ~F.coalesce(blocked if blocked is not None else F.lit(False), F.lit(False)))
    given = [c for c in (baseline, distance, lag) if isinstance(c, str)]
    rows = cut_lineage(rows.select("trace_id", "idx", "t", "value", "ok", *dict.fromkeys(given)))  # read many times below
    free = rows.where("ok")
    scale = (stats.noise_mad if mode == "mad" else stats.noise_std)(free, ["trace_id"], "value")
    steps = lagged(free.select("trace_id", "idx", "value"), "value", 1, "before").groupBy("trace_id").agg(F.greatest(F.coalesce(F.avg(F.abs(F.col("value") - F.col("before"))), F.lit(0.0)), F.lit(1e-9)).alias("step"))
    if mode == "snr":
        rows = lagged_snr(rows, "value", lag, "score")
        limits = steps.withColumn("threshold", F.lit(float(k))).withColumn("least", F.lit(float("-inf"))).join(scale, "trace_id")
    else:
        rows = rows.withColumn("score", F.col("value"))
        limits = scale.join(steps, "trace_id").withColumn("threshold", F.col("centre") + k * F.col("noise")).withColumn("least", prominence_k * F.col("noise"))
    far = F.lit(distance) if isinstance(distance, int) else F.col(distance)
    base = F.coalesce(F.col(baseline), F.col("centre")) if baseline else F.col("centre")
    rows = rows.join(limits, "trace_id").select("trace_id", "idx", "t", "value", base.cast("double").alias("baseline"), F.when(F.col("ok"), F.col("score")).alias("score"), "threshold", "least", "step", far.cast("long").alias("far"))
    out = maxima(cut_lineage(rows), ["t", "value", "baseline", "threshold", "step"])
    amplitude = F.col("value") - F.col("baseline")
    return out.select("trace_id", F.col("idx").alias("spike_index"), F.col("t").alias("spike_time"), "value", "baseline", "threshold", amplitude.alias("amplitude"), "prominence", F.col("step").alias("noise"), (amplitude / F.col("step")).alias("snr"))


def triggered_regions(df: DataFrame, column: str, high: str, low: str, enter: int, leave: int) -> DataFrame:
    """``(trace_id, start, end)`` where a trigger with two thresholds is on; ``high`` and ``low`` are columns.

    It goes on where ``enter`` values in a row begin to be above ``high``, off where ``leave`` in a row begin to be at or below
    ``low``, and stays on to the trace's end otherwise, over any distance.  Missing values and positions end a row of values
    and change nothing else.  Thresholds must not be crossed (``high`` below ``low``).

    Runs of values are found as regions; of the beginnings of runs, in order, those count that change the state: each knows
    the one before by ``bucketed_lag``, so a trace of any length is many groups.
    """
    v, hi, lo = (finite(F.col(c)) for c in (column, high, low))
    on = masks.at_least(masks.regions_of(df, v > hi), enter).select("trace_id", F.col("start").alias("idx"), F.lit(True).alias("on"))
    off = masks.at_least(masks.regions_of(df, v <= lo), leave).select("trace_id", F.col("start").alias("idx"), F.lit(False).alias("on"))
    bucket = F.floor(F.col("idx") / PIECE)
    runs = cut_lineage(on.unionByName(off))  # read twice below
    events = bucketed_lag(runs, ["trace_id"], bucket, ["idx"], "on", "was")
    turns = cut_lineage(events.where("on <> coalesce(was, false)").select("trace_id", "idx", "on"))
    closed = bucketed_lag(turns, ["trace_id"], bucket, ["idx"], "idx", "start").where("not on").select("trace_id", "start", F.col("idx").alias("end"))
    last = turns.groupBy("trace_id").agg(F.max_by("on", "idx").alias("on"), F.max("idx").alias("start")).where("on")
    ends = df.groupBy("trace_id").agg((F.max("idx") + 1).alias("end"))
    return closed.unionByName(last.join(ends, "trace_id").select("trace_id", "start", "end"))


def above_drift(df: DataFrame, column: str, half: int | Column = 50, drift_percentile: float = 20.0, entry_k: float = 5.0, exit_k: float = 2.0, exit_fraction: float = 0.5) -> DataFrame:
    """``(trace_id, idx, above, entry, exit)``: samples above the drift of their trace, and the levels that they are compared with.

    The drift is a rolling percentile.  The entry level is the greater of the Otsu threshold and the median and ``entry_k``
    noises (``low_state_noise``); the exit level lies below.
    """
    flat = rolling_rank(df, column, half, "drift", drift_percentile, "reflect").withColumn("above", F.col(column) - F.col("drift"))
    flat = cut_lineage(flat.select("trace_id", "idx", "above"))  # read many times below
    levels = stats.low_state_noise(flat, ["trace_id"], "above").join(stats.otsu(flat, ["trace_id"], "above"), "trace_id")
    levels = levels.withColumn("entry", F.greatest("threshold", F.col("centre") + entry_k * F.col("noise")))
    leave_at = F.least("entry", F.greatest(F.col("centre") + exit_k * F.col("noise"), F.col("centre") + exit_fraction * (F.col("entry") - F.col("centre"))))
    levels = cut_lineage(levels.withColumn("exit", leave_at).select("trace_id", "entry", "exit"))
    return flat.join(levels, "trace_id")


def long_plateaus(df: DataFrame, column: str, half: int | Column = 50, drift_percentile: float = 20.0, entry_k: float = 5.0, exit_k: float = 2.0, exit_fraction: float = 0.5, enter: int = 10, leave: int = 10, shortest: int = 20) -> DataFrame:
    """Raised stretches of a trace over its drift: those that a trigger between the levels of ``above_drift`` holds for ``shortest`` samples."""
    flat = above_drift(df, column, half, drift_percentile, entry_k, exit_k, exit_fraction)
    return masks.at_least(triggered_regions(flat, "above", "entry", "exit", enter, leave), shortest)


def _dropout_seeds(df: DataFrame, column: str, window: int, low: float, depth: float, fall: float) -> DataFrame:
    """Samples low, well below the median of the last ``window`` samples, and just falling, as regions."""
    held = with_halo(numbered(df), window + 2, PIECE, "row")
    order = Window.partitionBy("trace_id", "piece").orderBy("idx")
    held = held.withColumn("usual", F.percentile(column, F.lit(0.5)).over(order.rowsBetween(1 - window, 0))).withColumn("step", F.col(column) - F.lag(column).over(order))
    falling = F.coalesce(F.col("step") <= -fall, F.lit(False))
    held = held.withColumn("falling", falling).withColumn("fell", F.coalesce(F.lag("falling").over(order), F.lit(False)))
    seed = (F.col(column) <= low) & (F.col("usual") - F.col(column) >= depth) & (F.col("falling") | F.col("fell"))
    return masks.regions_of(held.where("own"), F.coalesce(seed, F.lit(False)))


def dropouts(df: DataFrame, column: str, window: int = 80, low: float = 120.0, depth: float = 8.0, fall: float = 6.0) -> DataFrame:
    """``(trace_id, start, end)`` of the seeds of downward dropouts, those one sample apart put together."""
    return masks.merged(_dropout_seeds(df, column, window, low, depth, fall), 1)


def artifact_regions(df: DataFrame, column: str, window: int = 80, low: float = 120.0, depth: float = 8.0, fall: float = 6.0, recovered: float = 0.9, margin: float = 2.0, most: int = 120, least_fall: float = 0.5, longest: int = 250) -> DataFrame:
    """``(trace_id, start, end)`` of whole downward dropouts, with one sample before and two after.

    A seed grows to the left as long as the trace falls by ``least_fall`` a sample, and to the right until it has come back
    ``recovered`` of the way to the median of the ``window`` samples before, ``most`` samples after its start at the latest.
    Grown seeds that meet are one; those of a single sample or over ``longest`` samples are left out.
    """
    keys = ["trace_id", "start", "end"]
    rows = df.where(F.col(column).isNotNull()).select("trace_id", "idx", F.col(column).alias("x"))
    seeds = cut_lineage(_dropout_seeds(df, column, window, low, depth, fall))

    def near(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        cut = seeds.withColumn("_a", F.greatest(first, F.lit(0))).withColumn("_b", last).where("_b >= _a")
        return rows.join(cut.select(*keys, F.explode(F.sequence("_a", "_b")).alias("idx")), ["trace_id", "idx"])

    before = near(rows, F.col("start") - window, F.col("start") - 1).groupBy(*keys).agg(stats.median("x").alias("usual"))
    inside = near(rows, F.col("start"), F.col("end") - 1).groupBy(*keys).agg(F.min("x").alias("trough"), F.min_by("x", "idx").alias("first"))
    levels = inside.join(before, keys, "left").withColumn("usual", F.coalesce("usual", "first"))
    levels = levels.select(*keys, F.greatest(F.lit(low + margin), F.col("trough") + recovered * (F.col("usual") - F.col("trough"))).alias("target"))
    ends = rows.groupBy("trace_id").agg((F.max("idx") + 1).alias("n"))
    back = near(rows, F.col("end"), F.col("start") + most - 1).join(levels, keys).where("x >= target").groupBy(*keys).agg(F.min("idx").alias("right"))
    drops = lagged(rows, "x", 1, "past").select("trace_id", "idx", (F.col("past") - F.col("x")).alias("x"))
    left = near(drops, F.col("start") - most, F.col("start")).where(f"x is null or x < {least_fall}").groupBy(*keys).agg(F.max("idx").alias("left"))
    grown = seeds.join(back, keys, "left").join(left, keys, "left").join(ends, "trace_id")
    whole = masks.merged(
        grown.select("trace_id", F.coalesce("left", F.greatest(F.col("start") - most, F.lit(0))).alias("start"), F.greatest(F.col("end"), F.coalesce("right", F.least("n", F.col("start") + most))).alias("end")), 1
    )
    kept = whole.where((F.col("end") - F.col("start") >= 2) & (F.col("end") - F.col("start") <= longest)).join(ends, "trace_id")
    return masks.merged(kept.select("trace_id", F.greatest(F.col("start") - 1, F.lit(0)).alias("start"), F.least(F.col("end") + 2, F.col("n")).alias("end")))


def waveforms(df: DataFrame, spikes: DataFrame, column: str, half: int) -> DataFrame:
    """Shape of each spike within ``half`` samples: ``rise``, ``fwhm`` and ``back`` in samples, by crossings of 10, 50 and 90
    percent above the higher shoulder, interpolated; null where a crossing is missing or the window isn't whole.

    The windows are joined by bucket and folded with higher-order functions; nothing leaves Spark.
    """
    near = aligned_windows(df.select("trace_id", "idx", F.col(column).alias("a")), spikes.select("trace_id", F.col("spike_index").alias("onset")), half, half)
    w = near.groupBy("trace_id", "onset").agg(F.sort_array(F.collect_list(F.struct(F.col("offset").cast("int").alias("o"), "a"))).alias("w"), F.count("a").alias("n"))
    left, right = F.filter("w", lambda p: p["o"] <= 0), F.filter("w", lambda p: p["o"] >= 0)
    w = w.where(F.col("n") >= 3).select(
        "*",
        F.filter("w", lambda p: p["o"] == 0)[0]["a"].alias("peak"),
        F.greatest(F.array_min(F.transform(left, lambda p: p["a"])), F.array_min(F.transform(right, lambda p: p["a"]))).alias("shoulder"),
    )
    w = w.where("peak > shoulder")
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i)["o"].alias("o"), F.get("w", i)["a"].alias("a"), F.get("w", i + 1)["a"].alias("b")))
    w = w.withColumn("pairs", pairs)

    def at(share: float):
        return F.col("shoulder") + share * (F.col("peak") - F.col("shoulder"))

    def crossing(share: float, before: bool):
        level = at(share)
        fits = F.filter("pairs", lambda p: ((p["o"] < 0) & (p["a"] <= level) & (level <= p["b"])) if before else ((p["o"] >= 0) & (p["a"] >= level) & (level >= p["b"])))
        p = F.try_element_at(fits, F.lit(-1 if before else 1))
        return F.when(p["b"] != p["a"], p["o"] + (level - p["a"]) / (p["b"] - p["a"]))

    rise, width = crossing(0.9, True) - crossing(0.1, True), crossing(0.5, False) - crossing(0.5, True)
    return w.select("trace_id", F.col("onset").alias("spike_index"), F.when(rise >= 0, rise).alias("rise"), F.when(width >= 0, width).alias("fwhm"), crossing(0.1, False).alias("back"))


def region_stats(df: DataFrame, regions: DataFrame, column: str) -> DataFrame:
    """Of each region: number of samples, onset and last time, mean, deviation and peak, and the peak's position."""
    cut = regions.select("trace_id", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("idx"))
    return df.join(cut, ["trace_id", "idx"]).groupBy("trace_id", "start", "end").agg(
        F.count(column).alias("samples"), F.min("t").alias("onset_time"), F.max("t").alias("last_time"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.max(column).alias("peak"),
        F.max_by("idx", F.struct(column, -F.col("idx"))).alias("peak_index"),
    )


def nearest_sample(df: DataFrame, wanted: DataFrame, piece: int = PIECE) -> DataFrame:
    """``(trace_id, at, idx)``: the sample nearest in time to each wanted time, however far, the earlier of equals.

    Samples and wanted times of a trace stand in one order of time, cut into about as many pieces as it has times ``piece``
    samples; the nearest is the last sample up to the wanted time or the first from it on.  Where either lies in another
    piece, it is found in the piece ends, one row per piece.  Only traces without samples in time get null.
    """
    rows = df.where("t is not null").select("trace_id", F.col("t").cast("double").alias("x"), F.col("idx"))
    spread = rows.groupBy("trace_id").agg(F.ceil(F.count("*") / piece).alias("k"), F.percentile_approx("x", [0.01, 0.99]).alias("q"))
    both = rows.unionByName(wanted.select("trace_id", F.col("at").cast("double").alias("x")).distinct(), allowMissingColumns=True)
    place = F.floor(F.least(F.greatest((F.col("x") - F.col("q")[0]) / (F.col("q")[1] - F.col("q")[0]), F.lit(0.0)), F.lit(1.0)) * F.col("k"))
    cut = both.join(spread, "trace_id").select("trace_id", "x", "idx", F.when((F.col("k") > 1) & (F.col("q")[1] > F.col("q")[0]), place).otherwise(0).alias("piece"))
    past, next_ = F.when(F.col("idx").isNotNull(), F.struct("x", (-F.col("idx")).alias("i"))), F.when(F.col("idx").isNotNull(), F.struct("x", F.col("idx").alias("i")))
    ends = cut.groupBy("trace_id", "piece").agg(F.max(past).alias("hi"), F.min(next_).alias("lo"))
    earlier = Window.partitionBy("trace_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("trace_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    seams = ends.select("trace_id", "piece", F.max("hi").over(earlier).alias("seam_before"), F.min("lo").over(later).alias("seam_after"))
    inside, so_far = Window.partitionBy("trace_id", "piece"), (Window.unboundedPreceding, Window.currentRow)
    met = cut.withColumn("l", F.max(past).over(inside.orderBy("x", F.col("idx").isNull()).rowsBetween(*so_far)))
    met = met.withColumn("r", F.min(next_).over(inside.orderBy(F.desc("x"), F.col("idx").isNull()).rowsBetween(*so_far)))
    met = met.where("idx is null").join(seams, ["trace_id", "piece"]).withColumn("l", F.coalesce("l", "seam_before")).withColumn("r", F.coalesce("r", "seam_after"))
    left = F.col("r").isNull() | (F.col("x") - F.col("l.x") <= F.col("r.x") - F.col("x"))
    best = met.select("trace_id", F.col("x").alias("at"), F.when(F.col("l").isNotNull() & left, -F.col("l.i")).otherwise(F.col("r.i")).alias("idx"))
    return wanted.select("trace_id", "at").distinct().join(best, ["trace_id", "at"], "left")


def nearest_spike(df: DataFrame, spikes: DataFrame, tolerance: int = 8) -> DataFrame:
    """``(trace_id, idx, spike_index)``: the spike nearest to each position within ``tolerance``, the earlier of equals."""
    width = 2 * tolerance + 1
    wide = spikes.select("trace_id", "spike_index", F.explode(F.array_distinct(F.transform(F.array(F.lit(-tolerance), F.lit(0), F.lit(tolerance)), lambda d: F.floor((F.col("spike_index") + d) / width)))).alias("b"))
    met = df.select("trace_id", "idx").withColumn("b", F.floor(F.col("idx") / width)).join(wide, ["trace_id", "b"]).where(F.abs(F.col("idx") - F.col("spike_index")) <= tolerance)
    return met.groupBy("trace_id", "idx").agg(F.min_by("spike_index", F.struct(F.abs(F.col("idx") - F.col("spike_index")), "spike_index")).alias("spike_index"))


def filtered(df: DataFrame, column: str, fs: str, cutoff: float, order: int, highpass: bool, out: str) -> DataFrame:
    """Add ``out``: a zero-phase Butterworth low-pass or high-pass; missing values are bridged linearly first.

    Each piece brings as many rows of its neighbours along as the filter's answer to a single value lasts (``HALO``, or 64
    periods of the cutoff over the order), so where a trace is cut makes no difference; only its own ends are mirrored.  Rows
    at a rate that isn't positive stay as they are.
    """
    last = F.greatest(F.lit(HALO), F.ceil(64.0 * F.col(fs) / cutoff)).cast("long")
    rows = numbered(df.select("trace_id", "idx", F.col(column).cast("double").alias("v"), F.col(fs).cast("double").alias("fs")))
    held = with_halo(rows.withColumn("last", F.coalesce(last, F.lit(HALO))), F.col("last"), PIECE, "row").drop("row", "last")

    def run(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        x, rate, there = g["v"].copy(), float(g["fs"][0]), np.isfinite(g["v"])
        x[~there] = np.interp(np.flatnonzero(~there), np.flatnonzero(there), x[there]) if there.any() else 0.0
        y = zero_phase_butterworth(x, rate, cutoff, order, highpass, int(1.5 * rate)) if rate > 0 else x
        own = np.flatnonzero(g["own"].astype(bool))
        return own, {out: y[own]}

    smooth = map_groups(held, ["trace_id", "piece"], "idx", run, ["trace_id", "idx"], {out: "double"})
    return df.join(smooth, ["trace_id", "idx"])


def local_noise(df: DataFrame, column: str, baseline: str, half: int, out: str) -> DataFrame:
    """Add ``out``: the rolling median of the distance from a baseline, at least 1e-9."""
    rows = df.withColumn("_d", F.abs(F.col(column) - F.col(baseline)))
    return rolling_rank(rows, "_d", half, "_m").withColumn(out, F.greatest("_m", F.lit(1e-9))).drop("_d", "_m")


def steps(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: the change from the row before; null for the first row of a trace."""
    return lagged(df, column, 1, "_before").withColumn(out, F.col(column) - F.col("_before")).drop("_before")
