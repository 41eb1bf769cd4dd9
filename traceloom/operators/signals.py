"""Operators along traces: cleaning, lags, rolling windows, interpolation and resampling.

Traces are long tables ``(trace_id, idx, ...)``.  A trace may hold any share of all rows, so windows of bounded reach run over
pieces of a trace that bring a halo of their neighbours' rows along; only per-trace numbers (counts, ends, means) are joined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from traceloom.functions.scalars import finite, recording_of, roi_of, seconds_per_unit
from traceloom.operators.grouped import map_groups
from traceloom.operators.ordered import bucketed_lag, carried, with_numbers

#: Positions in a piece of a trace.
PIECE = 16_384

#: Windows that reach further than this to either side are worked on as arrays of a whole piece.
WIDE = 16


def samples(trace_samples: DataFrame) -> DataFrame:
    """``(trace_id, idx, t, raw, corrected)``: each sample once, missing numbers null, ``corrected`` falling back to ``raw``.

    Rows without a trace or position are left out; repeated rows count once.
    """
    rows = trace_samples.where("trace_id is not null and idx is not null").select("trace_id", "idx", finite(F.col("t")).alias("t"), finite(F.col("raw")).alias("raw"), finite(F.col("corrected_source")).alias("c"))
    once = rows.groupBy("trace_id", "idx").agg(F.min("t").alias("t"), F.min("raw").alias("raw"), F.min("c").alias("c"))
    return once.select("trace_id", "idx", "t", "raw", F.coalesce("c", "raw").alias("corrected"))


def with_halo(df: DataFrame, halo: int | Column, piece: int = PIECE, position: str = "idx") -> DataFrame:
    """Rows with ``piece`` and ``own``: each row in its own piece of positions and in every other that begins or ends within
    ``halo`` positions of it.  Windows of rows take ``row`` of ``numbered`` for the position, so that gaps don't matter."""
    halo = F.lit(halo) if isinstance(halo, int) else halo
    at = F.col(position)
    mine = F.floor(at / piece)
    pieces = F.sequence(F.greatest(F.floor((at - halo) / piece), F.least(mine, F.lit(0))), F.floor((at + halo) / piece))
    return df.withColumn("piece", F.explode(pieces)).withColumn("own", F.col("piece") == mine)


def along(*extra: str) -> WindowSpec:
    """The rows of a piece in order."""
    return Window.partitionBy("trace_id", "piece", *extra).orderBy("idx")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("own").drop("piece", "own")


def lagged(df: DataFrame, column: str, lag: int | str, out: str) -> DataFrame:
    """Add ``out``: the value ``lag`` rows before (after, if negative), however far apart their positions are.

    ``lag`` may be a column that is the same for all rows of a trace.
    """
    if lag == 1:
        return bucketed_lag(df, ["trace_id"], F.floor(F.col("idx") / PIECE), ["idx"], column, out)
    rows = numbered(df)
    if isinstance(lag, str):
        past = rows.select(F.col("trace_id").alias("_trace"), (F.col("row") + F.col(lag)).alias("_row"), F.col(column).alias(out))
        return rows.join(past, (F.col("trace_id") == F.col("_trace")) & (F.col("row") == F.col("_row")), "left").drop("_trace", "_row", "row")
    held = with_halo(rows, abs(lag), PIECE, "row")
    return own_rows(held.withColumn(out, F.lag(column, lag).over(along()) if lag >= 0 else F.lead(column, -lag).over(along()))).drop("row")


def sampling_rates(df: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """``(trace_id, fs)`` from the median positive step of ``t``.

    ``headers`` has ``(recording_id, header)``, the headings of the time columns: one that names milliseconds or seconds says
    the unit of ``t``.  Where none does, times below 5 Hz with steps of a thousandth or more are in ms.  A trace without a
    positive step has a rate of 1.
    """
    steps = lagged(df.where("t is not null"), "t", 1, "before").withColumn("dt", F.col("t") - F.col("before")).where("dt > 0")
    middle = steps.groupBy("trace_id").agg(F.percentile("dt", F.lit(0.5)).alias("dt"))
    every = df.select("trace_id").distinct().join(middle, "trace_id", "left").withColumn("unit", F.lit(None).cast("double"))
    if headers is not None:
        units = headers.groupBy("recording_id").agg(F.max(seconds_per_unit(F.col("header"))).alias("unit"))
        every = every.drop("unit").withColumn("recording_id", recording_of(F.col("trace_id"))).join(units, "recording_id", "left")
    direct = F.when((1 / F.col("dt") < 5) & (F.col("dt") >= 0.001), 1000 / F.col("dt")).otherwise(1 / F.col("dt"))
    return every.select("trace_id", F.coalesce(F.when(F.col("unit").isNotNull(), 1 / (F.col("dt") * F.col("unit"))).otherwise(direct), F.lit(1.0)).alias("fs"))


def trace_ends(df: DataFrame, column: str) -> DataFrame:
    """``(trace_id, n, first_idx, last_idx, first, last)`` of each trace."""
    return df.groupBy("trace_id").agg(
        F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min_by(column, "idx").alias("first"), F.max_by(column, "idx").alias("last")
    )


def numbered(df: DataFrame) -> DataFrame:
    """Add ``row``: the number of each row within its trace from 0, counted piece by piece."""
    cut = df.withColumn("_piece", F.floor(F.col("idx") / PIECE))
    before = carried(cut.groupBy("trace_id", "_piece").agg(F.count("*").alias("_rows")), ["trace_id"], "_piece", "_rows", "_base", "sum").drop("_rows")
    within = F.row_number().over(Window.partitionBy("trace_id", "_piece").orderBy("idx")) - 1
    return cut.join(before, ["trace_id", "_piece"]).withColumn("row", (F.col("_base") + within).cast("long")).drop("_piece", "_base")


def rolling_rank(df: DataFrame, column: str, half: int | Column, out: str, percentile: float | None = None, edges: str = "nearest") -> DataFrame:
    """Add ``out``: the value of a given rank in a centred window of ``2 half + 1`` rows, the median if no percentile is given.

    Rank filters don't interpolate: the rank of percentile p in a window of w is ``int(w p / 100)``.  Beyond the ends of a trace
    the window is filled with the end's value (``nearest``) or with the trace mirrored at its end (``reflect``).  Null values
    aren't allowed; fill them first.  Traces shorter than the window keep what the filling gives.  Windows count rows, not
    positions.  ``half`` may be a column that is the same for all rows of a trace, as where each has its own rate.
    """
    if not isinstance(half, int) or half > WIDE:
        return _wide_rolling_rank(df, column, half, out, percentile, edges)
    width = 2 * half + 1
    rank = half if percentile is None else min(int(width * percentile / 100), width - 1)
    held, window = _window_arrays(df, column, half, edges)
    return own_rows(held.withColumn(out, F.get(F.sort_array(window), F.lit(rank)))).drop("row", "n", "first", "last", "w")


def _window_arrays(df: DataFrame, column: str, half: int, edges: str) -> tuple[DataFrame, Column]:
    """Rows of pieces, and the array of each row's window with what stands beyond the trace's ends filled in."""
    rows = numbered(df).join(trace_ends(df, column).select("trace_id", "n", "first", "last"), "trace_id")
    held = with_halo(rows, half, PIECE, "row").withColumn("w", F.collect_list(column).over(along().rowsBetween(-half, half)))
    left, right = F.greatest(F.lit(half) - F.col("row"), F.lit(0)), F.greatest(F.lit(half) - (F.col("n") - 1 - F.col("row")), F.lit(0))
    if edges == "nearest":
        front, back = F.array_repeat("first", left.cast("int")), F.array_repeat("last", right.cast("int"))
    else:
        front = F.when(left > 0, F.reverse(F.slice("w", F.lit(2), left.cast("int")))).otherwise(F.slice("w", 1, 0))
        inner = F.size("w") - right
        back = F.when(right > 0, F.reverse(F.slice("w", F.greatest(inner, F.lit(1)).cast("int"), right.cast("int")))).otherwise(F.slice("w", 1, 0))
    return held, F.concat(front, F.col("w"), back)


def polynomial_smooth(df: DataFrame, column: str, half: int, order: int, out: str) -> DataFrame:
    """Add ``out``: the middle of a least-squares polynomial over each centred window, ends repeated (Savitzky-Golay)."""
    powers = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    weights = F.array(*(F.lit(float(w)) for w in np.linalg.pinv(powers)[0]))
    held, window = _window_arrays(df, column, half, "nearest")
    value = F.aggregate(F.zip_with(window, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return own_rows(held.withColumn(out, value)).drop("row", "n", "first", "last", "w")


def _wide_rolling_rank(df: DataFrame, column: str, half: int | Column, out: str, percentile: float | None, edges: str) -> DataFrame:
    """``rolling_rank`` for windows that are too wide to gather for every row: a partial sort over array views of a piece."""
    reach = F.lit(half) if isinstance(half, int) else half
    ends = df.groupBy("trace_id").agg(F.count("*").alias("_n"))
    rows = numbered(df).join(ends, "trace_id").withColumn("_v", F.col(column).cast("double")).withColumn("_half", reach.cast("long"))
    held = with_halo(rows, F.col("_half"), PIECE, "row")

    def run(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        half = int(g["_half"][0])
        width = 2 * half + 1
        rank = half if percentile is None else min(int(width * percentile / 100), width - 1)
        left, right = half * int(g["row"][0] == 0), half * int(g["row"][-1] == g["_n"][-1] - 1)
        x = np.pad(g["_v"], (left, right), mode="edge" if edges == "nearest" else "reflect")
        if len(x) < width:  # the end of a trace as the halo of a piece behind it
            return np.zeros(0, dtype=np.int64), {out: np.zeros(0)}
        windows = np.lib.stride_tricks.sliding_window_view(x, width)
        block = max(1, 4_000_000 // width)
        y = np.concatenate([np.partition(windows[i : i + block], rank, axis=1)[:, rank] for i in range(0, len(windows), block)])
        at = np.arange(len(y)) + half - left
        own = g["own"][at].astype(bool)
        return at[own], {out: y[own]}

    return map_groups(held, ["trace_id", "piece"], "idx", run, df.columns, {out: "double"}, used=["_v", "row", "_n", "_half", "own"])


def moving_mean(df: DataFrame, column: str, half: int, out: str) -> DataFrame:
    """Add ``out``: the mean of a centred window of ``2 half + 1`` rows with the trace mirrored at its ends."""
    width = 2 * half + 1
    rows = numbered(df).join(trace_ends(df, column).select("trace_id", "n"), "trace_id")
    held = with_halo(rows, half, PIECE, "row").withColumn("w", F.collect_list(column).over(along().rowsBetween(-half, half)))
    left, right = F.greatest(F.lit(half) - F.col("row"), F.lit(0)).cast("int"), F.greatest(F.lit(half) - (F.col("n") - 1 - F.col("row")), F.lit(0)).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mirrored = total(F.slice("w", F.lit(2), left)) + total(F.slice("w", F.greatest(F.size("w") - right, F.lit(1)).cast("int"), right))
    return own_rows(held.withColumn(out, (total(F.col("w")) + mirrored) / width)).drop("row", "n", "w")


def lagged_snr(df: DataFrame, column: str, lag: int | str, out: str) -> DataFrame:
    """Add ``out``: the change over ``lag`` rows in units of the trace's mean absolute step; 0 for the first rows."""
    steps = lagged(df, column, 1, "before").groupBy("trace_id").agg(F.greatest(F.coalesce(F.avg(F.abs(F.col(column) - F.col("before"))), F.lit(0.0)), F.lit(1e-9)).alias("noise"))
    moved = lagged(df, column, lag, "past").join(steps, "trace_id")
    return moved.withColumn(out, F.when(F.col("past").isNull(), 0.0).otherwise((F.col(column) - F.col("past")) / F.col("noise"))).drop("past", "noise")


def interpolated(df: DataFrame, column: str, masked: Column, x: str, out: str) -> DataFrame:
    """Add ``out``: ``column`` with masked or missing values on the line between their neighbours over ``x``, flat at the ends.

    A trace without any value to go by gives 0.  Where a gap is longer than a piece, its ends are found in the piece ends
    that travel between pieces: one row per piece.
    """
    anchor = F.when(~masked & F.col(column).isNotNull() & F.col(x).isNotNull(), F.struct(F.col(x).alias("x"), F.col(column).alias("y")).cast("struct<x: double, y: double>"))
    cut = df.withColumn("_piece", F.floor(F.col("idx") / PIECE)).withColumn("_a", anchor)
    inside = Window.partitionBy("trace_id", "_piece").orderBy("idx")
    found = F.when(F.col("_a").isNotNull(), F.col("idx"))
    ends = cut.groupBy("trace_id", "_piece").agg(F.min_by("_a", found).alias("_first_known"), F.max_by("_a", found).alias("_last_known"))
    seams = carried(ends, ["trace_id"], "_piece", "_last_known", "_before")
    seams = carried(seams, ["trace_id"], "_piece", "_first_known", "_after", later=True).drop("_first_known", "_last_known")
    rows = cut.join(seams, ["trace_id", "_piece"])
    rows = rows.withColumn("_l", F.coalesce(F.last("_a", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_before"))
    backwards = Window.partitionBy("trace_id", "_piece").orderBy(F.desc("idx"))
    rows = rows.withColumn("_r", F.coalesce(F.last("_a", True).over(backwards.rowsBetween(Window.unboundedPreceding, 0)), "_after"))
    lerp = F.col("_l.y") + (F.col("_r.y") - F.col("_l.y")) * (F.col(x) - F.col("_l.x")) / (F.col("_r.x") - F.col("_l.x"))
    value = (
        F.when(F.col("_a").isNotNull(), F.col("_a.y"))
        .when(F.col("_l").isNull() & F.col("_r").isNull(), 0.0)
        .when(F.col("_l").isNull(), F.col("_r.y"))
        .when(F.col("_r").isNull(), F.col("_l.y"))
        .otherwise(lerp)
    )
    return rows.withColumn(out, value).drop("_piece", "_a", "_before", "_after", "_l", "_r")


def block_means(df: DataFrame, factor: int, means: list[str], flags: list[str] | None = None) -> DataFrame:
    """Tumbling blocks of ``factor`` rows: means of the present values, any of the flags; an unfinished last block is dropped."""
    if not 2 <= factor <= 100:
        raise ValueError("a block has 2 to 100 rows")
    blocks = numbered(df).withColumn("block", F.floor(F.col("row") / factor))
    out = blocks.groupBy("trace_id", "block").agg(F.count("*").alias("rows"), *(F.avg(c).alias(c) for c in means), *(F.bool_or(c).alias(c) for c in flags or []))
    return out.where(F.col("rows") == factor).drop("rows").withColumnRenamed("block", "idx")


def after_startup(df: DataFrame, startup_ms: float) -> DataFrame:
    """Rows from the first time on that lies ``startup_ms`` after the trace's first; all rows if none does.  ``t`` is in ms."""
    from_t = df.where("t is not null").groupBy("trace_id").agg((F.min("t") + startup_ms).alias("from_t"), F.max("t").alias("last_t"))
    return df.join(from_t, "trace_id").where("last_t < from_t or t >= from_t").drop("from_t", "last_t")


def cropped(df: DataFrame, start: float, end: float) -> DataFrame:
    """Rows with ``t`` in a closed window; a reversed window is turned round."""
    return df.where(F.col("t").between(min(start, end), max(start, end)))


def f0_of(df: DataFrame, sources: list[str]) -> DataFrame:
    """``(trace_id, f0, f0_source)``: the median of the first of the columns ``sources`` in which a trace has one that isn't 0;
    1 and ``unit_fallback`` where none has."""
    medians = df.groupBy("trace_id").agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in sources))
    usable = [F.abs(c) > 1e-12 for c in sources]
    f0 = F.coalesce(*(F.when(ok, F.col(c)) for c, ok in zip(sources, usable)), F.lit(1.0))
    name = F.coalesce(*(F.when(ok, F.lit(c)) for c, ok in zip(sources, usable)), F.lit("unit_fallback"))
    return medians.select("trace_id", f0.alias("f0"), name.alias("f0_source"))


def percent_dff(df: DataFrame, column: str, out: str, sources: list[str]) -> DataFrame:
    """Add ``out``: percent of the trace's ``f0_of``, null for missing values."""
    return df.join(f0_of(df, sources).select("trace_id", "f0"), "trace_id").withColumn(out, finite(100 * F.col(column) / F.col("f0"))).drop("f0")


def rolling_dff(df: DataFrame, column: str, baseline: str, half: int | Column, out: str) -> DataFrame:
    """Add ``out``: the change over the rolling median of a baseline, in parts of it, and ``f0``, that median."""
    rows = rolling_rank(df, baseline, half, "f0")
    return rows.withColumn(out, (F.col(column) - F.col("f0")) / F.greatest(F.abs("f0"), F.lit(1e-9)))


def samples_of(ms: float, fs: str = "fs", least: int = 1) -> Column:
    """Milliseconds as a number of samples at each row's own rate."""
    return F.greatest(F.lit(least), F.rint(ms / 1000 * F.col(fs)).cast("long"))


def time_axes(df: DataFrame, rates: DataFrame) -> DataFrame:
    """``(trace_id, is_ms, ms_scale, period_ms)``: whether a trace's times span more than 1,000 and so are in ms, the factor from its
    times to ms by its sampling period, and that period.  A trace without a positive step has a factor of 1."""
    steps = lagged(df.where("t is not null"), "t", 1, "before").withColumn("dt", F.col("t") - F.col("before")).where("dt > 0").groupBy("trace_id").agg(F.percentile("dt", F.lit(0.5)).alias("dt"))
    ends = df.where("t is not null").groupBy("trace_id").agg((F.max_by("t", "idx") - F.min_by("t", "idx")).alias("span"))
    period = 1000 / F.col("fs")
    return ends.join(rates, "trace_id").join(steps, "trace_id", "left").select("trace_id", (F.col("span") > 1000).alias("is_ms"), F.coalesce(period / F.col("dt"), F.lit(1.0)).alias("ms_scale"), period.alias("period_ms"))


def moved_regions(regions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Regions after the first ``offset`` of a trace's ``n`` samples are cut off: moved, cut to what is left, those outside dropped.

    ``offsets`` has ``(trace_id, offset, n)``."""
    moved = regions.join(offsets, "trace_id").withColumn("start", F.col("start") - F.col("offset")).withColumn("end", F.col("end") - F.col("offset"))
    left = F.col("n") - F.col("offset")
    kept = moved.where((F.col("end") > 0) & (F.col("start") < left))
    return kept.withColumn("start", F.greatest("start", F.lit(0))).withColumn("end", F.least("end", left)).drop("offset", "n")


def moved_spikes(spikes: DataFrame, offsets: DataFrame) -> DataFrame:
    """Spikes ``(trace_id, spike_index, candidate_index, ...)`` after the first ``offset`` of ``n`` samples are cut off; those cut off are dropped."""
    met = spikes.join(offsets, "trace_id").where((F.col("offset") <= 0) | ((F.col("spike_index") >= F.col("offset")) & (F.col("spike_index") < F.col("n"))))
    cut = F.greatest("offset", F.lit(0))
    return met.withColumn("spike_index", F.col("spike_index") - cut).withColumn("candidate_index", F.greatest(F.col("candidate_index") - cut, F.lit(0))).drop("offset", "n")


def aligned_windows(df: DataFrame, onsets: DataFrame, before: int, after: int) -> DataFrame:
    """``(trace_id, onset, offset, ...)``: the samples from ``before`` positions before each onset to ``after`` after it.

    Joined by bucket of position, so a trace with many onsets is many join keys.
    """
    width = before + after + 1
    wanted = onsets.select("trace_id", "onset", F.explode(F.sequence(F.floor((F.col("onset") - before) / width), F.floor((F.col("onset") + after) / width))).alias("bucket"))
    rows = df.withColumn("bucket", F.floor(F.col("idx") / width))
    near = rows.join(wanted, ["trace_id", "bucket"]).where((F.col("idx") >= F.col("onset") - before) & (F.col("idx") <= F.col("onset") + after))
    return near.withColumn("offset", F.col("idx") - F.col("onset")).drop("bucket")


def aligned_panel(df: DataFrame, column: str) -> DataFrame:
    """``(recording_id, row_no, regions)``: the values of all regions of a recording by row number, as a map by region.

    A panel is as long as the shortest region; of traces with the same recording and region the highest value counts.
    """
    rows = numbered(df).select(recording_of(F.col("trace_id")).alias("recording_id"), roi_of(F.col("trace_id")).alias("roi"), F.col("row").alias("row_no"), F.col(column).alias("v"))
    ends = rows.groupBy("recording_id", "roi").agg((F.max("row_no") + 1).alias("n")).groupBy("recording_id").agg(F.min("n").alias("n"))
    held = rows.join(ends, "recording_id").where("row_no < n").groupBy("recording_id", "row_no", "roi").agg(F.max("v").alias("v"))
    return held.groupBy("recording_id", "row_no").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("roi", "v")))).alias("regions"))


def corrected_units(df: DataFrame, column: str, reference: str, baseline: str, out: str) -> DataFrame:
    """Add ``out``: ``column``, or what it is above ``baseline`` for traces in which that is nearer to ``reference``.

    The difference is taken where its median is nearer to the reference's and the median of its size is smaller than without; traces
    without a present value keep theirs.
    """
    x, less = F.col(column), F.col(column) - F.col(baseline)
    mid = lambda c: F.percentile(c, F.lit(0.5))
    fits = (F.abs(mid(less) - mid(F.col(reference))) < F.abs(mid(x) - mid(F.col(reference)))) & (mid(F.abs(less)) < mid(F.abs(x)))
    choice = df.groupBy("trace_id").agg(F.coalesce(fits, F.lit(False)).alias("_less"))
    return with_numbers(df, choice, ["trace_id"]).withColumn(out, F.when(F.col("_less"), less).otherwise(x)).drop("_less")


def panel_channel(df: DataFrame, channels: list[str]) -> DataFrame:
    """Add ``channel``, the first of the columns ``channels`` in which a trace has a value, and ``value``; null where none has."""
    there = df.groupBy("trace_id").agg(F.coalesce(*(F.when(F.count(c) > 0, F.lit(c)) for c in channels)).alias("channel"))
    return with_numbers(df, there, ["trace_id"]).withColumn("value", F.coalesce(*(F.when(F.col("channel") == c, F.col(c)) for c in channels)))
