"""Per-trace and pooled statistics, noise scales, thresholds, outlier flags and the summary tables built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.scalars import finite, nice_floor, recording_of, roi_of
from traceloom.operators.ordered import bucketed_lag
from traceloom.session import cut_lineage

#: A modified z-score above this is an outlier.
OUTLIER = 4.5

#: Positions of a trace of which regions are ranked together first.
PART = 1_048_576

#: Events are put in order within stretches of so much time.
ONSETS_MS = 60_000

#: Metrics of a spike that summaries average.
SPIKE_METRICS = ("amplitude", "delta_f_over_f0", "snr", "rise_time_ms", "fwhm_ms", "return_to_baseline_time_ms", "post_spike_level", "isi_ms", "instantaneous_firing_rate_hz")


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def described(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Count, mean, median, population deviation and extremes of the present values."""
    x = finite(F.col(column))
    return df.withColumn("x", x).where("x is not null").groupBy(*keys).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), median("x").alias("median"), F.stddev_pop("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most")
    )


def noise_mad(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Median as centre; noise is the median absolute deviation, over 0.6745, of the values strictly below it."""
    rows = df.where(F.col(column).isNotNull())
    rows = rows.join(rows.groupBy(*keys).agg(median(column).alias("centre")), keys)
    below = rows.groupBy(*keys).agg(F.first("centre").alias("centre"), F.coalesce(median(F.when(F.col(column) < F.col("centre"), F.col(column))), F.first("centre")).alias("low"))
    joined = rows.drop("centre").join(below, keys)
    source = (F.col(column) < F.col("centre")) | (F.col("low") == F.col("centre"))
    return joined.groupBy(*keys).agg(F.first("centre").alias("centre"), F.greatest(median(F.when(source, F.abs(F.col(column) - F.col("low")))) / 0.6745, F.lit(1e-9)).alias("noise"))


def noise_std(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean as centre; noise is the population deviation of the values strictly below it, or of all where none is."""
    rows = df.where(F.col(column).isNotNull())
    rows = rows.join(rows.groupBy(*keys).agg(F.avg(column).alias("centre")), keys)
    below = F.when(F.col(column) < F.col("centre"), F.col(column))
    return rows.groupBy(*keys).agg(F.first("centre").alias("centre"), F.greatest(F.coalesce(F.stddev_pop(below), F.stddev_pop(column)), F.lit(1e-9)).alias("noise"))


def mad_or_sd(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Unscaled median absolute deviation, the population deviation where that is 0, at least 1e-9."""
    rows = df.where(F.col(column).isNotNull())
    rows = rows.join(rows.groupBy(*keys).agg(median(column).alias("m")), keys)
    spread = rows.groupBy(*keys).agg(median(F.abs(F.col(column) - F.col("m"))).alias("mad"), F.stddev_pop(column).alias("sd"))
    return spread.select(*keys, F.greatest(F.when(F.col("mad") > 1e-12, F.col("mad")).otherwise(F.col("sd")), F.lit(1e-9)).alias("mad"))


def step_noise(df: DataFrame, column: str) -> DataFrame:
    """Noise of each trace from its steps: 1.4826 times their median absolute deviation over the root of two."""
    from traceloom.operators.signals import lagged

    steps = lagged(df, column, 1, "before").select("trace_id", (F.col(column) - F.col("before")).alias("step")).where("step is not null")
    steps = steps.join(steps.groupBy("trace_id").agg(median("step").alias("m")), "trace_id")
    return steps.groupBy("trace_id").agg((1.4826 * median(F.abs(F.col("step") - F.col("m"))) / F.sqrt(F.lit(2.0))).alias("noise"))


def otsu(df: DataFrame, keys: list[str], column: str, bins: int = 256) -> DataFrame:
    """The threshold that splits a histogram into the two most different classes: ``(*keys, threshold)``, a bin's centre.

    Histograms are summed by bin before anything is gathered; a group has at most ``bins`` rows from there on.  Where all
    values are equal, that value is the threshold.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("v"))
    ends = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = rows.join(ends, keys).where("hi > lo").withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"))
    p = F.col("c") / F.col("n")
    centre = F.col("lo") + (F.col("bin") + 0.5) * width
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    stepped = counts.select(*keys, "bin", centre.alias("centre"), F.sum(p).over(upto).alias("w"), F.sum(p * centre).over(upto).alias("mu"), F.sum(p * centre).over(Window.partitionBy(*keys)).alias("total"))
    between = F.when(F.col("w") * (1 - F.col("w")) > 1e-12, F.pow(F.col("total") * F.col("w") - F.col("mu"), 2) / (F.col("w") * (1 - F.col("w")))).otherwise(0.0)
    best = stepped.withColumn("b", F.round(between, 9)).groupBy(*keys).agg(F.max_by("centre", F.struct("b", -F.col("bin"))).alias("threshold"))
    return best.unionByName(ends.where("hi <= lo").select(*keys, F.col("lo").alias("threshold")))


def low_state_noise(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``(*keys, centre, noise)``: the median, and the greater of ``mad_or_sd`` of all values and of those up to the median, of
    which eight are needed."""
    rows = df.where(F.col(column).isNotNull())
    middle = rows.groupBy(*keys).agg(median(column).alias("centre"))
    low = rows.join(middle, keys).where(F.col(column) <= F.col("centre")).drop("centre")
    enough = low.groupBy(*keys).agg(F.count("*").alias("_n"))
    below = mad_or_sd(low, keys, column).withColumnRenamed("mad", "_low").join(enough, keys)
    return mad_or_sd(rows, keys, column).join(below, keys).join(middle, keys).select(*keys, "centre", F.when(F.col("_n") >= 8, F.greatest("mad", "_low")).otherwise(F.col("mad")).alias("noise"))


def robust_scale(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Polarity and a round scale from the 5th and 95th percentile: the side of zero that reaches further, positive of equals."""
    ends = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.percentile(column, F.lit(0.05)).alias("p5"), F.percentile(column, F.lit(0.95)).alias("p95"))
    up, down = F.greatest("p95", F.lit(0.0)), F.greatest(-F.col("p5"), F.lit(0.0))
    return ends.select(*keys, "p5", "p95", F.when(down > up, "negative").otherwise("positive").alias("polarity"), nice_floor(F.greatest(up, down, F.lit(1e-9))).alias("scale"))


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at ``ranks``, from 0, of all present values of a table, exactly, without bringing these together.

    Each rank is bracketed by approximate percentiles of what lies in its last bracket, all ranks in one pass, until few
    values are left, which are looked at; a bracket shrinks some thousandfold in a pass, so the passes are few at any size.
    """
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("x"))
    accuracy, margin, few = 10_000, 3e-4, 2_000
    found: dict[int, float] = {}
    brackets = {r: (float("-inf"), float("inf")) for r in ranks}
    while brackets:
        inside = {r: F.col("x").between(lo, hi) for r, (lo, hi) in brackets.items()}
        counts = rows.agg(*(F.count_if(F.col("x") < lo).alias(f"b{r}") for r, (lo, _) in brackets.items()), *(F.count_if(i).alias(f"n{r}") for r, i in inside.items())).first()
        small = [r for r in brackets if counts[f"n{r}"] <= few]
        for r in small:
            lo, hi = brackets.pop(r)
            values = sorted(v["x"] for v in rows.where(F.col("x").between(lo, hi)).collect())
            found[r] = values[r - counts[f"b{r}"]]
        if not brackets:
            break
        share = {r: (r - counts[f"b{r}"]) / counts[f"n{r}"] for r in brackets}
        ends = {r: F.percentile_approx(F.when(inside[r], F.col("x")), F.array(F.lit(max(share[r] - margin, 0.0)), F.lit(min(share[r] + margin, 1.0))), F.lit(accuracy)) for r in brackets}
        narrowed = rows.agg(*(e.alias(f"e{r}") for r, e in ends.items())).first()
        for r in list(brackets):
            lo, hi = narrowed[f"e{r}"]
            if (lo, hi) == brackets[r] or lo == hi:
                # a single value fills the bracket, or nothing is gained: the value at the bracket's end is counted through
                found[r] = lo if lo == hi else _counted_through(rows, lo, hi, r - counts[f"b{r}"])
                del brackets[r]
            else:
                brackets[r] = (lo, hi)
    return [found[r] for r in ranks]


def _counted_through(rows: DataFrame, lo: float, hi: float, rank: int) -> float:
    """The value at a rank within a bracket of few but often repeated values."""
    for v in rows.where(F.col("x").between(lo, hi)).groupBy("x").count().orderBy("x").toLocalIterator():
        if rank < v["count"]:
            return v["x"]
        rank -= v["count"]
    raise ValueError("no such rank")


def whole_percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Interpolated percentiles of all present values of a table, as ``percentile`` gives, by ``order_statistics``."""
    n = df.agg(F.count(column).alias("n")).first()["n"]
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * q for q in shares]
    ranks = sorted({int(k) for a in at for k in (a, min(int(a) + 1, n - 1))})
    value = dict(zip(ranks, order_statistics(df, column, ranks)))
    return [value[int(a)] + (a - int(a)) * (value[min(int(a) + 1, n - 1)] - value[int(a)]) for a in at]


def high_outliers(df: DataFrame, keys: list[str], column: str, flag: str) -> DataFrame:
    """Add ``flag``: whether a value is an unusually high one of its group; null keys of ``keys`` = [] means all rows.

    Modified z-score by the median absolute deviation; where that is 0, three interquartile ranges above the third quartile;
    where those are 0, the greatest value if it is above the median.  Groups of under four values have none.
    """
    rows = df.withColumn("_x", finite(F.col(column)))
    if keys:
        a = rows.groupBy(*keys).agg(F.count("_x").alias("_n"), F.percentile("_x", F.lit(0.25)).alias("_q1"), median("_x").alias("_m"), F.percentile("_x", F.lit(0.75)).alias("_q3"), F.max("_x").alias("_top"))
        rows = rows.join(a, keys)
        rows = rows.join(rows.groupBy(*keys).agg(median(F.abs(F.col("_x") - F.col("_m"))).alias("_mad")), keys)
    else:
        values = cut_lineage(rows.where("_x is not null").select("_x"))
        ends = values.agg(F.count("_x").alias("n"), F.max("_x").alias("top")).first()
        q1, m, q3 = whole_percentiles(values, "_x", [0.25, 0.5, 0.75])
        mad = whole_percentiles(values.select(F.abs(F.col("_x") - F.lit(m)).alias("_x")), "_x", [0.5])[0] if m is not None else None
        for name, value in (("_n", float(ends["n"])), ("_q1", q1), ("_m", m), ("_q3", q3), ("_top", ends["top"]), ("_mad", mad)):
            rows = rows.withColumn(name, F.lit(value).cast("double"))
    high = (
        F.when(F.col("_mad") > 0, 0.6745 * (F.col("_x") - F.col("_m")) / F.col("_mad") > OUTLIER)
        .when(F.col("_q3") > F.col("_q1"), F.col("_x") > F.col("_q3") + 3 * (F.col("_q3") - F.col("_q1")))
        .when(F.col("_top") > F.col("_m"), F.col("_x") == F.col("_top"))
        .otherwise(F.lit(False))
    )
    return rows.withColumn(flag, F.coalesce(high & (F.col("_n") >= 4), F.lit(False))).drop("_x", "_n", "_q1", "_m", "_q3", "_top", "_mad")


def spike_events(spikes: DataFrame, periods: DataFrame) -> DataFrame:
    """The table of spike events: ids, intervals and rates along each trace.

    ``periods`` has ``(recording_id, period_ms)``.  A spike's interval is its distance in samples from the one before times
    the sampling period.  Repeated rows count once.  The spikes before and after are found by bucketed look-behind.
    """
    once = spikes.where("trace_name is not null and spike_index is not null and coalesce(status, '') <> 'deleted'").groupBy("trace_name", "spike_index").agg(
        F.min(finite(F.col("amplitude_above_baseline"))).alias("amplitude"),
        F.min(finite(F.col("delta_f_over_f0"))).alias("cached"),
        F.min(finite(F.col("baseline_at_spike"))).alias("f0"),
        *(F.min(finite(F.col(c))).alias(c) for c in ("snr", "rise_time_ms", "fwhm_ms", "return_to_baseline_time_ms", "post_spike_level")),
        F.min("source").alias("source"),
    )
    from traceloom.operators.signals import lagged, numbered

    rows = once.select(F.col("trace_name").alias("trace_id"), F.col("spike_index").alias("idx"), *[c for c in once.columns if c not in ("trace_name", "spike_index")])
    rows = numbered(rows)
    before = rows.select("trace_id", (F.col("row") + 1).alias("row"), F.col("idx").alias("before"))
    rows = rows.join(before, ["trace_id", "row"], "left").withColumn("recording_id", recording_of(F.col("trace_id"))).join(periods, "recording_id", "left")
    isi = (F.col("idx") - F.col("before")) * F.col("period_ms")
    return rows.select(
        "trace_id",
        "recording_id",
        roi_of(F.col("trace_id")).alias("roi_id"),
        F.format_string("%04d", F.col("row") + 1).alias("spike_id"),
        F.col("idx").alias("peak_index"),
        "amplitude",
        F.coalesce("cached", F.when(F.col("f0") != 0, F.col("amplitude") / F.col("f0"))).alias("delta_f_over_f0"),
        "snr",
        "rise_time_ms",
        "fwhm_ms",
        "return_to_baseline_time_ms",
        "post_spike_level",
        isi.alias("isi_ms"),
        F.when(isi > 0, 1000 / isi).alias("instantaneous_firing_rate_hz"),
        "source",
    )


def spike_summary(events: DataFrame, traces: DataFrame) -> DataFrame:
    """Per trace: number of spikes, mean and median of nine metrics; traces without spikes are kept."""
    measures = [m for c in SPIKE_METRICS for m in (F.avg(c).alias(f"mean_{c}"), median(c).alias(f"median_{c}"))]
    per = events.groupBy("trace_id").agg(F.count("*").alias("spike_count"), *measures)
    return traces.select("trace_id").distinct().join(per, "trace_id", "left").withColumn("spike_count", F.coalesce("spike_count", F.lit(0)).cast("bigint"))


def event_table(bursts: DataFrame) -> DataFrame:
    """Events of ``bursts`` with the columns that summaries use, each once; only finite numbers count."""
    return bursts.where("trace_name is not null and burst_index is not null").groupBy(F.col("trace_name").alias("trace_id"), F.col("burst_index").alias("event_id")).agg(
        F.min(finite(F.col("start_time"))).alias("onset_time_ms"),
        F.min(finite(F.col("duration_ms"))).alias("duration_ms"),
        F.min(finite(F.col("amplitude_above_baseline"))).alias("peak_amp_above_baseline"),
        F.min(finite(F.col("mean_snr"))).alias("mean_snr"),
        F.min(finite(F.col("local_noise_estimate"))).alias("noise"),
    )


def trace_summary(events: DataFrame, totals: DataFrame) -> DataFrame:
    """Per trace: count, first onset, means and medians, total and share of time, gaps between onsets; and a row ``ALL``.

    ``totals`` has ``(trace_id, total_ms)`` of every trace.  Gaps are taken within traces, also for ``ALL``.  Traces without
    events are kept.
    """
    at = events.where("onset_time_ms is not null").select("trace_id", "onset_time_ms", "event_id")
    at = bucketed_lag(at, ["trace_id"], F.floor(F.col("onset_time_ms") / ONSETS_MS), ["onset_time_ms", "event_id"], "onset_time_ms", "past")
    gaps = at.select("trace_id", (F.col("onset_time_ms") - F.col("past")).alias("gap")).where("gap > 0")

    own = events.groupBy("trace_id").agg(
        F.count("*").alias("event_count"),
        F.min("onset_time_ms").alias("first_onset_ms"),
        F.avg("duration_ms").alias("mean_duration_ms"),
        median("duration_ms").alias("median_duration_ms"),
        F.avg("peak_amp_above_baseline").alias("mean_peak_amp"),
        median("peak_amp_above_baseline").alias("median_peak_amp"),
        F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("total_event_time_ms"),
    )
    apart = gaps.groupBy("trace_id").agg(F.avg("gap").alias("mean_interval_ms"), median("gap").alias("median_interval_ms"))
    every = totals.join(own.join(apart, "trace_id", "left"), "trace_id", "left").select(
        "trace_id",
        F.coalesce("event_count", F.lit(0)).cast("bigint").alias("event_count"),
        "first_onset_ms",
        "mean_duration_ms",
        "median_duration_ms",
        "mean_peak_amp",
        "median_peak_amp",
        F.coalesce("total_event_time_ms", F.lit(0.0)).alias("total_event_time_ms"),
        F.when(F.col("total_ms") > 0, F.coalesce("total_event_time_ms", F.lit(0.0)) / F.col("total_ms")).alias("event_time_fraction"),
        "mean_interval_ms",
        "median_interval_ms",
    )
    # all events together: sums are aggregated in place, medians found by rank
    rows, between = cut_lineage(events.select("duration_ms", "peak_amp_above_baseline")), cut_lineage(gaps.select("gap"))
    middle = {name: F.lit(whole_percentiles(df, c, [0.5])[0]).cast("double") for name, df, c in (("duration", rows, "duration_ms"), ("peak", rows, "peak_amp_above_baseline"), ("gap", between, "gap"))}
    pooled = rows.agg(F.count("*").alias("event_count"), F.avg("duration_ms").alias("mean_duration_ms"), F.avg("peak_amp_above_baseline").alias("mean_peak_amp"), F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("total_event_time_ms"))
    none = F.lit(None).cast("double")
    pooled = pooled.where("event_count > 0").select(
        F.lit("ALL").alias("trace_id"),
        "event_count",
        none.alias("first_onset_ms"),
        "mean_duration_ms",
        middle["duration"].alias("median_duration_ms"),
        "mean_peak_amp",
        middle["peak"].alias("median_peak_amp"),
        "total_event_time_ms",
        none.alias("event_time_fraction"),
        F.lit(between.agg(F.avg("gap")).first()[0]).cast("double").alias("mean_interval_ms"),
        middle["gap"].alias("median_interval_ms"),
    )
    return every.unionByName(pooled)


def trace_qc(summary: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Summary rows with ``qc_status`` and ``qc_notes``; outliers are judged with the row ``ALL`` among the others."""
    out = summary
    for column, note in metrics.items():
        out = high_outliers(out, [], column, f"_{note}")
    notes = F.concat_ws("; ", F.when(F.col("event_count") <= 0, "no_events"), *(F.when(F.col(f"_{n}"), f"high_{n}") for n in metrics.values()))
    return out.withColumn("qc_notes", notes).withColumn("qc_status", F.when(F.col("qc_notes") == "", "ok").otherwise("review")).drop(*(f"_{n}" for n in metrics.values()))


def strongest_regions(df: DataFrame, regions: DataFrame, column: str, most: int = 3) -> DataFrame:
    """The ``most`` regions of a trace by lift times root of length, of those lifted well above the rest of the trace."""
    from traceloom.operators.masks import covered

    cut = regions.select("trace_id", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("idx"))
    inside = df.join(cut, ["trace_id", "idx"])
    rest = covered(df, regions, "inside").where("not inside").groupBy("trace_id").agg(median(column).alias("floor"), F.stddev_pop(column).alias("spread"))
    scored = inside.groupBy("trace_id", "start", "end").agg(median(column).alias("level"), F.count("*").alias("n")).join(rest, "trace_id")
    lift = (F.col("level") - F.col("floor")) / F.greatest(F.col("spread"), F.lit(1e-9))
    ranked = scored.withColumn("lift", lift).where("lift >= 1.8").withColumn("score", F.col("lift") * F.sqrt("n"))
    # the strongest of each part of a trace first: what is ranked at last is a few rows a part
    part = Window.partitionBy("trace_id", F.floor(F.col("start") / PART)).orderBy(F.desc("score"), "start")
    few = ranked.withColumn("place", F.row_number().over(part)).where(F.col("place") <= most)
    best = few.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("score"), "start")))
    return best.where(F.col("place") <= most).select("trace_id", "start", "end", "place")
