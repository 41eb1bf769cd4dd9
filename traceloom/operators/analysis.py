"""Plateaus of traces after they are found: impulses taken out, long ones put together again where a short gap parts them, edges
set by slope, shapes on a common grid, and why candidates were turned down; and chains of transforms of a trace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators import detection, masks, signals, stats
from traceloom.operators.ordered import with_numbers
from traceloom.session import cut_lineage

# Regions of at most so many milliseconds whose span is so many noises are spikes; so many samples say what a span is.
IMPULSE_MS, IMPULSE_SPAN, ENOUGH = 80.0, 4.0, 8

# Plateaus of at least so many milliseconds that so short a gap parts are one.
LONG_MS, SPLIT_MS = 140.0, 120.0

# Milliseconds that a slope is taken over, that it must be quiet and then steep for at an onset, that onsets and ends
# are looked for on either side, that a rise may begin after the quiet, and that a trace must be low for at an end.
SLOPE_MS, QUIET_MS, RISE_MS, SEARCH_MS, WAIT_MS, LOW_MS = 2.0, 3.0, 2.0, 50.0, 20.0, 5.0

# Deviations of the slope that are quiet, and deviations above the median that are low.
STEEP, LOW = 3.0, 2.0

# Fixed value: the most milliseconds of a plateau's surroundings on either side that belong to its profile.
FLANK_MS = 60.0


def _deviation(rows: DataFrame, column: str) -> DataFrame:
    """``(trace_id, middle, noise)``: the median of a column and the unscaled median absolute deviation, at least 1e-9."""
    middle = rows.groupBy("trace_id").agg(stats.median(column).alias("middle"))
    away = with_numbers(rows, middle, ["trace_id"]).groupBy("trace_id").agg(F.greatest(stats.median(F.abs(F.col(column) - F.col("middle"))), F.lit(1e-9)).alias("noise"))
    return middle.join(away, "trace_id")


def without_impulses(df: DataFrame, regions: DataFrame, column: str, rates: DataFrame) -> DataFrame:
    """Regions without the short ones that are spikes by their span: the 5th to the 95th percentile, or all of a few samples.

    The noise is the unscaled median absolute deviation of the whole trace, at least 1e-9; ``rates`` has ``(trace_id, fs)``.
    Regions without any present sample stay.
    """
    rows = df.where(F.col(column).isNotNull()).select("trace_id", "idx", F.col(column).alias("v"))
    noise = _deviation(rows, "v").select("trace_id", "noise")
    keys = ["trace_id", "start", "end"]
    short = regions.select(*keys).join(rates, "trace_id").where(F.col("end") - F.col("start") <= signals.samples_of(IMPULSE_MS, "fs", 2)).drop("fs")
    inside = rows.join(short.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("idx")), ["trace_id", "idx"])
    wide = F.when(F.count("*") >= ENOUGH, F.percentile("v", F.lit(0.95)) - F.percentile("v", F.lit(0.05))).otherwise(F.max("v") - F.min("v"))
    spans = inside.groupBy(*keys).agg(wide.alias("span")).join(noise, "trace_id")
    return regions.join(spans.where(F.col("span") >= IMPULSE_SPAN * F.col("noise")).select(*keys), keys, "left_anti")


def rejoined(regions: DataFrame, rates: DataFrame) -> DataFrame:
    """Regions with long neighbours that a short gap parts put together; shorter regions stay and part them too."""
    samples = lambda ms, least: rates.select("trace_id", signals.samples_of(ms, "fs", least).alias("n"))
    long = cut_lineage(masks.at_least(regions, samples(LONG_MS, 2)).select("trace_id", "start", "end"))
    short = regions.select("trace_id", "start", "end").join(long, ["trace_id", "start", "end"], "left_anti")
    met = cut_lineage(masks.merged(long, samples(SPLIT_MS, 1)))
    # where a short region lies in a gap that was closed, the gap opens again
    parted = cut_lineage(masks.best_overlap(met, short, []).where("overlap > 0").select("trace_id", "start", "end"))
    whole = met.join(parted, ["trace_id", "start", "end"], "left_anti")
    kept = masks.best_overlap(long, parted, []).where("overlap > 0").select("trace_id", "start", "end")
    return whole.unionByName(kept).unionByName(short)


def _met(windows: DataFrame, first: Column, end: Column, runs: DataFrame, piece: int = 1024) -> DataFrame:
    """Each window with the runs ``(s, e, ...)`` that share a bucket of positions with ``first`` to ``end``, some of them several times.

    Windows are short.  Runs may be of any length: a run stands once in each bucket, so there are no more rows than positions.
    """
    a = windows.withColumn("_bucket", F.explode(F.sequence(F.floor(first / piece), F.floor(end / piece))))
    b = runs.withColumnsRenamed({"start": "s", "end": "e"})
    return a.join(b.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("s") / piece), F.floor((F.col("e") - 1) / piece)))), ["trace_id", "_bucket"])


def refined_edges(df: DataFrame, regions: DataFrame, column: str, rates: DataFrame, blocked: str | None = None) -> DataFrame:
    """``(trace_id, start, end)``: regions whose onset is where a steep rise follows on a quiet slope, and whose end is where the trace
    stays low again; those that meet are one.

    The slope is the change over 2 ms, quiet up to three deviations of it.  From a region's start the last 3 ms of quiet within
    50 ms before it are looked for, and after them, or from the start, the first rise of 2 ms that begins within 20 ms; without
    one the onset is where the quiet ends.  The end is the first place within 50 ms from which on the trace lies below its
    median and two deviations for 5 ms, else it stays.  ``rates`` has ``(trace_id, fs)``; traces without a rate give no regions.
    Positions in the boolean column ``blocked`` belong to no region and to no run; null counts as false.
    """
    keys = ["trace_id", "start", "end"]
    free = F.lit(True) if blocked is None else ~F.coalesce(F.col(blocked), F.lit(False))
    rows = df.where(F.col(column).isNotNull()).select("trace_id", "idx", F.col(column).cast("double").alias("v"), free.alias("free"))
    rows = with_numbers(rows, rates.select("trace_id", signals.samples_of(SLOPE_MS).alias("lag")), ["trace_id"])
    rows = signals.lagged(rows, "v", "lag", "past").select("trace_id", "idx", "v", "free", F.coalesce(F.col("v") - F.col("past"), F.lit(0.0)).alias("slope"))
    rows = cut_lineage(rows)  # read many times below
    steep = _deviation(rows.where("free"), "slope").select("trace_id", (STEEP * F.col("noise")).alias("steep"))
    low = _deviation(rows.where("free"), "v").select("trace_id", (F.col("middle") + LOW * F.col("noise")).alias("low"))
    rated = with_numbers(rows.where("free"), cut_lineage(steep.join(low, "trace_id")), ["trace_id"])
    kinds = {"quiet": F.abs("slope") <= F.col("steep"), "rise": F.col("slope") > F.col("steep"), "low": F.col("v") <= F.col("low")}
    # the runs of all three kinds in one pass: the key is the trace and the kind
    kind = F.explode(F.array_compact(F.array(*(F.when(holds, name) for name, holds in kinds.items()))))
    every = cut_lineage(masks.regions_of(rated.select("trace_id", "idx", kind.alias("kind")).select(F.struct("trace_id", "kind").alias("trace_id"), "idx"), F.lit(True)))

    def runs(name: str, ms: float, least: int) -> DataFrame:
        found = every.where(F.col("trace_id.kind") == name).select("trace_id.trace_id", "start", "end")
        return masks.at_least(found, rates.select("trace_id", signals.samples_of(ms, "fs", least).alias("n")))

    n = lambda ms, least, name: signals.samples_of(ms, "fs", least).alias(name)
    lengths = rates.select("trace_id", n(QUIET_MS, 2, "quiet"), n(RISE_MS, 1, "rise"), n(SEARCH_MS, 5, "far"), n(WAIT_MS, 10, "wait"), n(LOW_MS, 3, "calm"))
    ends = rows.groupBy("trace_id").agg((F.max("idx") + 1).alias("n"))
    windows = cut_lineage(regions.select(*keys).distinct().join(lengths, "trace_id").join(ends, "trace_id"))
    until = F.least("e", "start")
    before = _met(windows, F.greatest(F.col("start") - F.col("far"), F.lit(0)), F.col("start"), runs("quiet", QUIET_MS, 2))
    quiet = before.where(until - F.col("quiet") >= F.greatest(F.col("s"), F.col("start") - F.col("far"))).groupBy(*keys).agg(F.max(until).alias("after"))
    windows = cut_lineage(windows.join(quiet, keys, "left").withColumn("after", F.coalesce("after", "start")))
    begins, limit = F.greatest("s", "after"), F.col("after") + F.col("wait")
    rising = _met(windows, F.col("after"), limit, runs("rise", RISE_MS, 1))
    onsets = rising.where((begins + F.col("rise") <= F.col("e")) & (begins < limit)).groupBy(*keys).agg(F.min(begins).alias("onset"))
    lowest = F.greatest("s", "end")
    falling = _met(windows, F.col("end"), F.col("end") + F.col("far"), runs("low", LOW_MS, 3))
    offsets = falling.where(lowest + F.col("calm") <= F.least(F.col("e"), F.col("end") + F.col("far"))).groupBy(*keys).agg(F.min(lowest).alias("offset"))
    # where a trace ends while the rise is looked for, the region's own start stays
    cut_off = F.least(F.col("n"), limit) - 1 + F.col("rise") > F.col("n")
    whole = windows.join(onsets, keys, "left").join(offsets, keys, "left")
    whole = whole.withColumn("onset", F.coalesce("onset", F.when(cut_off, F.col("start")).otherwise(F.col("after"))))
    offset = F.greatest(F.col("onset") + 1, F.least(F.coalesce("offset", "end"), F.col("n")))
    spans = masks.merged(whole.select("trace_id", F.col("onset").alias("start"), offset.alias("end")))
    if blocked is None:
        return spans
    return masks.regions_of(masks.covered(rows.where("free"), cut_lineage(spans), "inside"), F.col("inside"))


def profiles(df: DataFrame, regions: DataFrame, column: str, rates: DataFrame, size: int = 96) -> DataFrame:
    """``(trace_id, start, end, profile)``: the shape of each region and its surroundings on a grid of ``size`` points.

    Half of a region's length on either side, 3 samples at least and 60 ms at most, belongs to it as far as the trace goes.  Values are
    less the median of these sides (0 without any) in units of the region's median above it, linear between samples, 0 where they
    are missing.  Regions of under 3 samples, without present values or without a height give nothing.  A region may be of any
    length: each point of the grid is joined to the two samples beside it.
    """
    keys = ["trace_id", "start", "end"]
    rows = df.select("trace_id", "idx", F.col(column).cast("double").alias("v"))
    span = rows.groupBy("trace_id").agg((F.max("idx") + 1).alias("n"))
    length = F.col("end") - F.col("start")
    side = F.least(F.greatest(F.lit(3), F.floor(length / 2)), signals.samples_of(FLANK_MS, "fs", 3))
    cut = regions.select(*keys).distinct().join(span, "trace_id").withColumn("start", F.greatest("start", F.lit(0))).withColumn("end", F.least("end", "n"))
    cut = cut.where(length >= 3).join(rates.select("trace_id", "fs"), "trace_id").withColumn("side", side)
    cut = cut.withColumn("lo", F.greatest(F.lit(0), F.col("start") - F.col("side"))).withColumn("hi", F.least("n", F.col("end") + F.col("side")))
    cut = cut_lineage(cut.where("hi - lo >= 5").select(*keys, "lo", "hi"))
    near = cut.select(*keys, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("idx")).join(rows.where("v is not null"), ["trace_id", "idx"])
    inside = (F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end"))
    levels = near.groupBy(*keys).agg(F.coalesce(stats.median(F.when(~inside, F.col("v"))), F.lit(0.0)).alias("base"), stats.median(F.when(inside, F.col("v"))).alias("level"))
    levels = levels.withColumn("height", F.col("level") - F.col("base")).where("abs(height) > 1e-12")
    grid = cut.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("point"))
    grid = grid.withColumn("at", F.col("point") * (F.col("hi") - F.col("lo") - 1) / (size - 1)).withColumn("left", F.floor("at"))
    two = F.explode(F.array(F.struct(F.lit(0).alias("k"), (1 - F.col("at") + F.col("left")).alias("w")), F.struct(F.lit(1).alias("k"), (F.col("at") - F.col("left")).alias("w"))))
    beside = grid.select(*keys, "lo", "point", "left", two.alias("b")).where("b.w > 0").select(*keys, "point", "b.w", (F.col("lo") + F.col("left") + F.col("b.k")).alias("idx"))
    values = beside.join(rows, ["trace_id", "idx"], "left").groupBy(*keys, "point").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.every(F.col("v").isNotNull()).alias("whole"))
    points = values.join(levels, keys).withColumn("y", F.when(F.col("whole"), (F.col("v") - F.col("base")) / F.col("height")).otherwise(0.0))
    packed = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("point", "y"))).alias("p"))
    return packed.select(*keys, F.col("p.y").alias("profile"))


#: The steps that a candidate for a long plateau goes through.
STEPS = ("entry_threshold", "entry_sustain", "minimum_duration", "edge_refinement", "impulse_suppression", "final_min_duration")


def plateau_audit(df: DataFrame, column: str, rates: DataFrame, half: int | Column = 50, enter: int = 10, leave: int = 10, shortest: int = 20, **levels: float) -> DataFrame:
    """``(trace_id, start, end, samples, duration_ms, median, p25, peak, entry, exit, accepted, stage, near_miss)`` of every candidate.

    Candidates are the stretches above the entry level or held by the trigger, those that meet as one.  ``stage`` is the first of
    ``STEPS`` of whose outcome none overlaps the candidate, or ``accepted``; ``near_miss`` is how far its peak lies above the
    entry level.  Values are those above the drift, as in ``detection.long_plateaus``, with whose parameters it is called.
    """
    flat = cut_lineage(detection.above_drift(df, column, half, **levels))
    above = cut_lineage(masks.regions_of(flat, F.col("above") > F.col("entry")))
    held = cut_lineage(detection.triggered_regions(flat, "above", "entry", "exit", enter, leave))
    long = cut_lineage(masks.at_least(held, shortest))
    edged = cut_lineage(refined_edges(df, long, column, rates))
    plain = cut_lineage(without_impulses(df, edged, column, rates))
    final = cut_lineage(masks.at_least(rejoined(plain, rates), shortest))
    keys = ["trace_id", "start", "end"]
    candidates = cut_lineage(masks.merged(above.unionByName(held).unionByName(final.select(*keys))))
    outcomes = reduce(DataFrame.unionByName, (o.select(*keys, F.lit(name).alias("step")) for name, o in zip(STEPS, (above, held, long, edged, plain, final))))
    met = _met(candidates, F.col("start"), F.col("end") - 1, outcomes).where("s < end and e > start")
    hits = met.groupBy(*keys).agg(*(F.bool_or(F.col("step") == name).alias(name) for name in STEPS))
    out = candidates.join(hits, keys, "left").fillna(False, list(STEPS))
    inside = candidates.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("idx")).join(flat, ["trace_id", "idx"])
    numbers = inside.groupBy(*keys).agg(stats.median("above").alias("median"), F.percentile("above", F.lit(0.25)).alias("p25"), F.max("above").alias("peak"), F.any_value("entry").alias("entry"), F.any_value("exit").alias("exit"))
    stage = F.coalesce(F.when(F.col(STEPS[-1]), "accepted"), *(F.when(~F.col(s), s) for s in STEPS))
    samples = F.col("end") - F.col("start")
    return out.join(numbers, keys).join(rates.select("trace_id", "fs"), "trace_id", "left").select(
        *keys, samples.alias("samples"), (1000 * samples / F.col("fs")).alias("duration_ms"), "median", "p25", "peak", "entry", "exit",
        F.col(STEPS[-1]).alias("accepted"), stage.alias("stage"), F.greatest(F.col("peak") - F.col("entry"), F.lit(0.0)).alias("near_miss"),
    )


def rejected(audit: DataFrame, offsets: DataFrame) -> DataFrame:
    """The candidates of ``plateau_audit`` that were turned down, by position after the first ``offset`` of ``n`` samples are cut off.

    ``offsets`` has ``(trace_id, offset, n)``; what lies in the part cut off is dropped.
    """
    return signals.moved_regions(audit.where("not accepted"), offsets)


def transformed(df: DataFrame, column: str, steps: list[tuple]) -> DataFrame:
    """``(trace_id, idx, t, fs, column)`` after steps in the order given: ``("highpass", hertz, order)``, ``("lowpass", hertz, order)`` and
    ``("downsample", factor)``, which takes means of whole blocks of rows and divides the rate ``fs`` of each trace.

    No steps leave the rows as they are.  After downsampling positions are numbers of blocks.
    """
    rows = df.select("trace_id", "idx", "t", F.col("fs").cast("double").alias("fs"), F.col(column).cast("double").alias(column))
    for kind, *how in steps:
        if kind == "downsample":
            rows = signals.block_means(rows, how[0], ["t", "fs", column]).withColumn("fs", F.col("fs") / how[0])
        elif kind in ("highpass", "lowpass"):
            out = detection.filtered(rows, column, "fs", float(how[0]), int(how[1]), kind == "highpass", "_out")
            rows = out.drop(column).withColumnRenamed("_out", column)
        else:
            raise ValueError(f"unknown step {kind}")
        rows = cut_lineage(rows.select("trace_id", "idx", "t", "fs", column))
    return rows
