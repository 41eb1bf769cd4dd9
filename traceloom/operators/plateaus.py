"""Short plateaus that raise a trace's floor, and what a plateau's signal is made of.

Everything about a plateau comes from windows joined to its edges and aggregated natively; sample windows are given in
milliseconds at each trace's own rate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.scalars import finite, unit_interval
from traceloom.operators import masks, stats
from traceloom.operators.detection import maxima
from traceloom.operators.grouped import map_groups
from traceloom.operators.signals import interpolated, lagged, rolling_rank, samples_of
from traceloom.session import cut_lineage

# What a short plateau must show, in units of the trace's noise (steps, levels), shares and milliseconds.
STEP, ELEVATED, LOSS, MEDIAN, QUIET, AFTER, SPREAD, PEAK = 3.5, 3.0, 1.25, 4.0, 1.75, 1.5, 4.0, 5.0
SUPPORT, SURE, CONFIDENT = 0.75, 0.85, 0.65
SHORTEST_MS, SUPPORTED_MS = 25.0, 15.0


def _between(rows: DataFrame, regions: DataFrame, first: Column, last: Column) -> DataFrame:
    """The rows of each region's window from ``first`` to ``last``, with the region's columns."""
    cut = regions.withColumn("_first", first).withColumn("_last", last).where("_last >= _first")
    return rows.join(cut.withColumn("idx", F.explode(F.sequence(F.greatest("_first", F.lit(0)), "_last"))).drop("_first", "_last"), ["trace_id", "idx"])


def short_plateaus(df: DataFrame, column: str) -> DataFrame:
    """``(trace_id, start, end, duration_ms, level, support, confidence)`` of the short raised floors of each trace.

    ``df`` has each trace's rate as ``fs``, by which windows in milliseconds become samples.  The trace is centred by its 20th
    percentile over 300 ms and then by its median; noise is its median absolute deviation.  A
    plateau is a stretch in which the 20th percentile over 12 ms
    stays up; it must rise out of quiet, be long and steady enough and end in quiet again, and bursts of single peaks don't
    raise the floor.  Its edges are where the trace crosses half of its level.  Spans that the trace ends in don't count.
    """
    rates = df.groupBy("trace_id").agg(F.max("fs").alias("fs"))
    n = lambda ms, least=1: samples_of(ms, "fs", least)
    # each rolling window reads its input more than once, so what goes into the next is written first
    y = cut_lineage(rolling_rank(df.select("trace_id", "idx", "fs", F.col(column).alias("x")), "x", n(150, 2), "base", 20.0, "reflect").select("trace_id", "idx", "fs", (F.col("x") - F.col("base")).alias("y")))
    y = cut_lineage(y.join(y.groupBy("trace_id").agg(stats.median("y").alias("c")), "trace_id").select("trace_id", "idx", "fs", (F.col("y") - F.col("c")).alias("y")))
    noise = stats.mad_or_sd(y, ["trace_id"], "y").withColumnRenamed("mad", "noise")
    y = cut_lineage(rolling_rank(y, "y", F.greatest(F.lit(2), F.floor(n(12) / 2)), "floor", 20.0, "reflect"))
    y = rolling_rank(y, "y", F.greatest(F.lit(1), F.floor(n(7) / 2)), "med", None, "reflect")
    rows = cut_lineage(y.join(noise, "trace_id")).drop("fs")
    candidates = masks.at_least(masks.regions_of(rows, F.col("floor") > LOSS * F.col("noise")), rates.select("trace_id", n(SUPPORTED_MS, 2).alias("n")))
    inside = _between(rows, candidates, F.col("start"), F.col("end") - 1).groupBy("trace_id", "start", "end", "noise").agg(
        stats.median("med").alias("level"),
        F.avg((F.col("floor") > ELEVATED * F.col("noise")).cast("double")).alias("support"),
        F.max("y").alias("peak"),
        (F.percentile("y", F.lit(0.75)) - F.percentile("y", F.lit(0.25))).alias("spread"),
    )
    keys = ["trace_id", "start", "end"]
    regions = candidates.join(inside, keys).join(rates, "trace_id").where((F.col("level") >= MEDIAN * F.col("noise")) & (F.col("support") >= SUPPORT))
    reach = _between(rows.drop("noise"), regions, F.col("start") - n(15), F.col("end") + n(15)).where("y > level / 2")
    edges = reach.groupBy(*keys).agg(F.min("idx").alias("onset"), (F.max("idx") + 1).alias("offset"))
    regions = cut_lineage(regions.join(edges, keys))
    bare = rows.select("trace_id", "idx", "y", "med")
    before = _between(bare, regions, F.col("onset") - n(12, 3), F.col("onset") - 1).groupBy(*keys).agg(
        stats.median(F.abs("y")).alias("quiet"), stats.median(F.when(F.col("idx") >= F.col("onset") - n(8, 2), F.col("y"))).alias("pre")
    )
    after = _between(bare, regions, F.col("offset"), F.col("offset") + n(20, 3) - 1).groupBy(*keys).agg(stats.median("med").alias("post"), F.count("*").alias("post_n"))
    first = _between(bare, regions, F.col("onset"), F.col("onset") + n(10, 2) - 1).groupBy(*keys).agg(stats.median("y").alias("rise"))
    full = regions.join(before, keys).join(first, keys).join(after, keys, "left").withColumn("duration_ms", (F.col("offset") - F.col("onset")) * 1000.0 / F.col("fs"))
    step = F.col("rise") - F.col("pre")
    ends = F.when(F.col("post_n") >= F.floor(n(20, 3) / 2), F.col("post") <= AFTER * F.col("noise")).otherwise(F.lit(False))
    steady = (F.col("spread") <= SPREAD * F.col("noise")) & ((F.col("peak") - F.col("level") <= PEAK * F.col("noise")) | (F.col("support") >= SURE))
    kept = full.where((F.col("quiet") <= QUIET * F.col("noise")) & (step > STEP * F.col("noise")) & ends & steady & (F.col("duration_ms") >= SHORTEST_MS))
    confidence = (
        0.30 * unit_interval((step / F.col("noise") - STEP) / 6)
        + 0.30 * unit_interval((F.col("level") / F.col("noise") - MEDIAN) / 6)
        + 0.25 * unit_interval((F.col("support") - SUPPORT) / (1 - SUPPORT))
        + 0.15 * unit_interval((F.col("duration_ms") - SHORTEST_MS) / 75)
    )
    out = kept.select("trace_id", F.col("onset").alias("start"), F.col("offset").alias("end"), "duration_ms", "level", "support", confidence.alias("confidence"))
    return out.where(F.col("confidence") >= CONFIDENT)


def _paired(peaks: DataFrame, tolerance: str) -> DataFrame:
    """``(trace_id, pairs)``: how many peaks of the first kind (``first``) find a partner of the other kind within ``tolerance``
    positions, each partner once.  Both kinds stand in one order, in which the nearest free ones are put together; only the
    peaks of a region are brought together, not its samples."""

    def run(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        near = int(g[tolerance][0])
        one, two = g["idx"][g["first"] == 1], g["idx"][g["first"] == 0]
        pairs = i = j = 0
        while i < len(one) and j < len(two):
            if abs(one[i] - two[j]) <= near:
                pairs, i, j = pairs + 1, i + 1, j + 1
            elif one[i] < two[j]:
                i += 1
            else:
                j += 1
        return np.array([0]), {"pairs": np.array([pairs])}

    return map_groups(peaks, ["trace_id"], "idx", run, ["trace_id"], {"pairs": "bigint"}, used=["idx", "first", tolerance])


def _robust_sigma(df: DataFrame, column: str) -> DataFrame:
    """``(trace_id, sigma)``: 1.4826 median absolute deviations."""
    middle = df.groupBy("trace_id").agg(stats.median(column).alias("_m"))
    return df.join(middle, "trace_id").groupBy("trace_id").agg((1.4826 * stats.median(F.abs(F.col(column) - F.col("_m")))).alias("sigma"))


def trace_noise(df: DataFrame, regions: DataFrame, column: str) -> DataFrame:
    """``(trace_id, usual)``: noise of each trace outside of its regions, from the steps between what is left, or if that shows
    none, of the whole trace."""
    rows = df.where(F.col(column).isNotNull()).select("trace_id", "idx", F.col(column).alias("v"))
    bare = rows.join(masks.covered(rows.select("trace_id", "idx"), regions, "inside").where("not inside").select("trace_id", "idx"), ["trace_id", "idx"])
    steps = lagged(bare, "v", 1, "past").where("past is not null").select("trace_id", (F.col("v") - F.col("past")).alias("step"))
    outside = _robust_sigma(steps, "step").select("trace_id", (F.col("sigma") / F.sqrt(F.lit(2.0))).alias("outside"))
    return _robust_sigma(rows, "v").join(outside, "trace_id", "left").select("trace_id", F.when(F.col("outside") > 0, F.col("outside")).otherwise(F.greatest("sigma", F.lit(1e-9))).alias("usual"))


def signal_metrics(df: DataFrame, regions: DataFrame, raw: str, smooth: str, noise: str) -> DataFrame:
    """Of each region of a trace: high-frequency content before and after smoothing, what smoothing took, and peaks that it kept.

    Columns ``hf_raw``, ``hf_smooth`` and ``residual`` (root mean squares), ``density_raw``, ``density_smooth`` (peaks a second),
    ``kept`` (share of peaks that have a partner after smoothing) and ``usual_noise``; all null for regions of under three
    samples and where nothing is smoothed.  ``df`` has each trace's rate as ``fs``.

    Each region is worked on as a trace of its own, so that regions of any length are many groups: gaps are bridged, the
    trend, a median over 100 ms, comes from rolling windows, peaks from pieces with a halo, the rest from aggregates.
    """
    keys = ["trace_id", "start", "end"]
    cut = regions.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("idx"))
    name = F.concat_ws("\n", "trace_id", F.col("start").cast("string"), F.col("end").cast("string"))
    named = lambda d: d.withColumn("_region", name)
    rows = df.join(cut, ["trace_id", "idx"]).select(*keys, "idx", "fs", *(finite(F.col(c)).alias(a) for c, a in ((raw, "raw"), (smooth, "smooth"), (noise, "noise"))))
    rows = named(rows).drop(*keys).withColumnRenamed("_region", "trace_id")
    filled = interpolated(interpolated(rows, "raw", F.lit(False), "idx", "a"), "smooth", F.lit(False), "idx", "b")
    sizes = rows.groupBy("trace_id").agg(F.count("*").alias("n"), F.count("smooth").alias("smoothed"), F.max("fs").alias("fs"), stats.median(F.when(F.col("noise") > 0, F.col("noise"))).alias("own_noise"))
    filled = cut_lineage(filled.select("trace_id", "idx", "a", "b").join(sizes.where("n >= 3 and smoothed > 0").select("trace_id", "n", "fs"), "trace_id"))
    half = F.floor((F.least(F.greatest(F.lit(3), F.rint(0.1 * F.col("fs"))), F.col("n") - 1 + F.col("n") % 2) - 1) / 2)
    trends = rolling_rank(rolling_rank(filled, "a", half, "a_trend"), "b", half, "b_trend")
    high = cut_lineage(trends.select("trace_id", "idx", "n", "fs", "a", "b", (F.col("a") - F.col("a_trend")).alias("ha"), (F.col("b") - F.col("b_trend")).alias("hb")))
    rms = lambda c: F.sqrt(F.avg(c * c))
    sums = high.groupBy("trace_id").agg(rms(F.col("ha")).alias("hf_raw"), rms(F.col("hb")).alias("hf_smooth"), rms(F.col("a") - F.col("b")).alias("residual"))
    spread = _robust_sigma(high, "ha").withColumnRenamed("sigma", "spread_a").join(_robust_sigma(high, "hb").withColumnRenamed("sigma", "spread_b"), "trace_id")
    usual = named(regions.select(*keys).join(trace_noise(df, regions, raw), "trace_id")).select(F.col("_region").alias("trace_id"), "usual")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    levels = sizes.join(spread, "trace_id").join(usual, "trace_id", "left").select("trace_id", "n", "fs", "spread_a", "spread_b", F.coalesce(positive("own_noise"), positive("usual"), positive("spread_a"), F.lit(1e-9)).alias("level"))
    levels = cut_lineage(levels.withColumn("far", F.greatest(F.lit(1), F.rint(0.002 * F.col("fs")).cast("long"))))

    def peaks(score: str, spread: str) -> DataFrame:
        limit = levels.select("trace_id", "far", F.greatest(3 * F.col("level"), F.col(spread), F.lit(1e-12)).alias("threshold"), F.lit(float("-inf")).alias("least"))
        return maxima(high.select("trace_id", "idx", F.col(score).alias("score")).join(limit, "trace_id"), ["far"])

    both = cut_lineage(peaks("ha", "spread_a").withColumn("first", F.lit(1)).unionByName(peaks("hb", "spread_b").withColumn("first", F.lit(0))).select("trace_id", "idx", "far", "first"))
    counts = both.groupBy("trace_id").agg(F.count_if(F.col("first") == 1).alias("one"), F.count_if(F.col("first") == 0).alias("two")).join(_paired(both, "far"), "trace_id")
    seconds = F.col("n") / F.col("fs")
    none = F.lit(0)
    out = sums.join(levels, "trace_id").join(counts, "trace_id", "left").select(
        F.col("trace_id").alias("_region"),
        "hf_raw",
        "hf_smooth",
        "residual",
        (F.coalesce("one", none) / seconds).alias("density_raw"),
        (F.coalesce("two", none) / seconds).alias("density_smooth"),
        F.when(F.col("one") > 0, F.col("pairs") / F.col("one")).otherwise(0.0).alias("kept"),
        F.col("level").alias("usual_noise"),
    )
    return named(regions.select(*keys)).join(out, "_region", "left").drop("_region")


# How much speaks for each kind of signal, the mean of shares that grow from the first to the second value of a
# measure (or shrink, where the first is the greater).  Of measures in one line the greater share counts.
EVIDENCE = {
    "clean": ((("over", 4.0, 1.5),), (("share", 0.45, 0.0),), (("density_raw", 25.0, 0.0),)),
    "spike_like": ((("density_raw", 0.0, 35.0),), (("density_smooth", 0.0, 25.0),), (("kept", 0.0, 1.0),), (("less", 0.85, 0.0),)),
    "noise_like": ((("over", 2.0, 8.0),), (("less", 0.0, 0.70),), (("kept", 1.0, 0.0),), (("density_smooth", 20.0, 0.0),)),
    "mixed": ((("over", 0.0, 6.0),), (("share", 0.0, 0.70),), (("kept", 0.0, 1.0), ("density_smooth", 0.0, 25.0)), (("less", 0.0, 0.70),)),
}

# The kinds in the order in which they are tried, the conditions that a kind needs, all of them, and the least
# confidence that it is given.
KINDS = (
    ("clean", ("over < 2.0", "share < 0.30", "density_raw < 10.0"), 0.0),
    ("mixed", ("mixed >= 0.45", "share >= 0.25", "less >= 0.20", "kept >= 0.25 or density_smooth >= 10.0"), 0.0),
    ("spike_like", ("kept >= 0.45", "density_raw >= 10.0", "spike_like >= noise_like"), 0.0),
    ("noise_like", ("noise_like >= 0.45", "less >= 0.35", "kept <= 0.35"), 0.0),
    ("clean", ("over < 2.5", "share < 0.35"), 0.0),
    ("mixed", ("kept >= 0.30 or density_smooth >= 10.0", "share >= 0.25", "less >= 0.15"), 0.45),
    ("spike_like", ("kept >= 0.30 or density_smooth >= 10.0",), 0.45),
    ("noise_like", ("less >= 0.25",), 0.45),
    ("mixed", (), 0.35),
)


def signal_types(metrics: DataFrame) -> DataFrame:
    """Regions with ``signal_type`` and ``confidence``: the first of ``KINDS`` whose conditions hold, with the ``EVIDENCE`` for it.

    Regions without metrics are ``unknown``, without a confidence.
    """
    floor = lambda *c: F.greatest(*c, F.lit(1e-12))
    known = metrics.select(
        "*",
        (F.col("hf_raw") / floor(F.col("usual_noise"))).alias("over"),
        (F.col("residual") / floor(F.col("hf_raw"), F.col("usual_noise"))).alias("share"),
        F.when(F.col("hf_raw") > 1e-12, F.greatest(1 - F.col("hf_smooth") / F.col("hf_raw"), F.lit(0.0))).otherwise(0.0).alias("less"),
    )
    shares = lambda line: [unit_interval((F.col(m) - a) / (b - a)) for m, a, b in line]
    best = lambda s: s[0] if len(s) == 1 else F.greatest(*s)
    for kind, lines in EVIDENCE.items():
        known = known.withColumn(kind, sum((best(shares(line)) for line in lines), F.lit(0.0)) / len(lines))
    tried = F.coalesce(*(F.when(F.expr(" and ".join(f"({c})" for c in needs) or "true"), F.struct(F.lit(kind).alias("k"), F.greatest(F.col(kind), F.lit(least)).alias("c"))) for kind, needs, least in KINDS))
    there = F.col("hf_raw").isNotNull()
    known = known.withColumn("_t", F.when(there, tried)).drop(*EVIDENCE, "over")
    return known.withColumn("signal_type", F.coalesce("_t.k", F.lit("unknown"))).withColumn("confidence", F.col("_t.c")).withColumn("residual_fraction", F.when(there, F.col("share"))).withColumn("noise_reduction", F.when(there, F.col("less"))).drop("_t", "share", "less")
