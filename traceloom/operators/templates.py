"""Spikes that look like chosen examples: a likelihood ratio of each window of a trace between the examples' shape and noise.

The shape is a mean and a deviation for each sample around an example, aggregated natively; so is the histogram from which the
noise is told apart from events.  What is fitted for a trace is a few dozen rows; it travels as rows of their own in front of
the samples of each piece of the trace, so no array is copied to every sample.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.scalars import finite
from traceloom.operators import detection, masks, stats
from traceloom.operators.grouped import map_groups
from traceloom.operators.signals import PIECE, numbered, samples_of, with_halo
from traceloom.session import cut_lineage

#: Bins of a trace's histogram for the noise, and rounds of fitting two normal distributions to it.
BINS, ROUNDS = 256, 200

# The high-pass before matching, the window around an example, how far from the best match the peak may lie and how
# far apart spikes are, in milliseconds; false alarms in a trace of noise; examples from which a deviation is taken.
CUTOFF_HZ, BEFORE_MS, AFTER_MS, NEAR_MS, APART_MS, ALARMS, ENOUGH = 20.0, 5.0, 12.0, 10.0, 25.0, 0.05, 10

# Coefficients of a Chebyshev fit of the complementary error function (relative error below 1.2e-7 anywhere).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def log_normal_cdf(z: np.ndarray) -> np.ndarray:
    """Logarithm of the standard normal distribution, exact in the far tails too."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    log_tail = np.log(0.5 * t) - x * x + np.polynomial.polynomial.polyval(t, _ERFC)
    return np.where(z < 0, log_tail, np.log1p(-np.exp(np.minimum(log_tail, 0.0))))


def _ratios(v: np.ndarray, mean: np.ndarray, spread: np.ndarray, noise: float) -> np.ndarray:
    """How much more each value speaks for the shape at its place than for noise: above where the shape is, below elsewhere."""
    side = np.where(mean > 0, 1.0, -1.0)
    least = float(np.log(np.nextafter(0.0, 1.0)))
    return np.maximum(log_normal_cdf(side * (v - mean) / spread), least) - np.maximum(log_normal_cdf(-side * v / noise), least)


def _quietest(centre: np.ndarray, count: np.ndarray, whole: float, polarity: float) -> float:
    """Deviation of the one of two normal distributions in a histogram that lies away from the events; ``whole`` if unusable."""
    n = count.sum()
    middle = (centre * count).sum() / n
    low, high = centre[np.searchsorted(np.cumsum(count), 0.25 * n)], centre[min(np.searchsorted(np.cumsum(count), 0.95 * n), len(centre) - 1)]
    place, spread, weight = np.array([low, high if high > low else low + whole]), np.array([whole, whole]), np.array([0.5, 0.5])
    for _ in range(ROUNDS):
        log = np.log(weight) - np.log(spread) - (centre[:, None] - place) ** 2 / (2 * spread**2)
        share = np.exp(log - log.max(axis=1, keepdims=True))
        share *= (count / share.sum(axis=1))[:, None]
        mass = np.maximum(share.sum(axis=0), 1e-9)
        new = (share * centre[:, None]).sum(axis=0) / mass
        spread = np.sqrt((share * (centre[:, None] - new) ** 2).sum(axis=0) / mass + 1e-6 * whole**2)
        weight, moved = mass / n, np.abs(new - place).max()
        place = new
        if moved < 1e-6 * whole:
            break
    quiet = float(spread[int(np.argmin(polarity * place))])
    return quiet if 0 < quiet <= whole and np.isfinite(middle) else whole


def _shapes(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """``(trace_id, offset, mean, sd, examples)`` from the whole, free windows around the examples, each less the median of what
    comes before."""
    cut = picks.select("trace_id", F.col("idx").alias("pick"), "before", F.explode(F.sequence(F.col("idx") - F.col("before"), F.col("idx") + F.col("after"))).alias("idx"), (F.col("before") + F.col("after") + 1).alias("wide"))
    near = rows.where("free").select("trace_id", "idx", "y").join(cut, ["trace_id", "idx"]).withColumn("offset", F.col("idx") - F.col("pick"))
    whole = near.groupBy("trace_id", "pick").agg(F.count("*").alias("n"), F.max("wide").alias("wide"), stats.median(F.when(F.col("offset") < 0, F.col("y"))).alias("base"))
    kept = near.drop("wide").join(whole.where("n = wide").select("trace_id", "pick", "base"), ["trace_id", "pick"])
    x = F.col("y") - F.col("base")
    return kept.groupBy("trace_id", "offset").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count("*").alias("examples"))


def _models(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """``shapes`` with ``spread``, ``noise``, ``polarity`` and ``threshold`` of each trace."""
    first = shapes.groupBy("trace_id").agg(F.min_by("mean", "offset").alias("start"), F.count("*").alias("wide"), F.max("examples").alias("examples"))
    far = shapes.join(first, "trace_id").groupBy("trace_id").agg(F.max_by(F.when(F.col("mean") < F.col("start"), -1.0).otherwise(1.0), F.struct(F.abs(F.col("mean") - F.col("start")), -F.col("offset"))).alias("polarity"))
    free = rows.where("free")
    ends = free.groupBy("trace_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.stddev_pop("y").alias("whole"), F.count("*").alias("n"))
    binned = free.select("trace_id", "y").join(ends, "trace_id").withColumn("idx", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("y") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(0))
    counts = binned.groupBy("trace_id", "idx").agg(F.count("*").alias("count"), F.avg("y").alias("centre"), F.max("whole").alias("whole")).join(far, "trace_id")

    def quiet(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        whole = max(float(g["whole"][0]), 1e-9)
        return np.array([0]), {"noise": np.array([max(_quietest(g["centre"], g["count"].astype(float), whole, g["polarity"][0]), 1e-9) if g["count"].sum() >= 8 else whole])}

    noise = map_groups(counts, ["trace_id"], "idx", quiet, ["trace_id", "polarity"], {"noise": "double"})
    rows_of = rows.groupBy("trace_id").agg(F.count("*").alias("length"))
    model = shapes.drop("examples").join(first.select("trace_id", "wide", "examples"), "trace_id").join(noise, "trace_id").join(rows_of, "trace_id")
    spread = F.when(F.col("examples") >= ENOUGH, F.col("sd")).otherwise(F.col("noise"))
    model = model.withColumn("spread", F.greatest(spread, F.col("noise") / 100, F.lit(1e-12)))

    def limit(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        # mean and deviation of the ratio in windows of pure noise, by quadrature: its values are independent
        at, weight = np.polynomial.hermite_e.hermegauss(64)
        weight = weight / weight.sum()
        value = _ratios(at[:, None] * g["noise"][0], g["mean"], g["spread"], g["noise"][0])
        mean = weight @ value
        sd = np.sqrt(max(float((weight @ (value - mean) ** 2).sum()), 1e-18))
        wide = len(mean)
        pieces = max(1, int(np.ceil(max(1, max(g["length"][0], wide + 1) - wide + 1) / wide)))
        alarms = min(max(ALARMS / pieces, 1e-12), 0.5)
        return np.array([0]), {"threshold": np.array([float(mean.sum()) - sd * NormalDist().inv_cdf(alarms)])}

    thresholds = map_groups(model, ["trace_id"], "offset", limit, ["trace_id"], {"threshold": "double"})
    return model.join(thresholds, "trace_id").select("trace_id", "offset", "mean", "spread", "noise", "polarity", "threshold")


def likelihood_ratios(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``(trace_id, idx, ratio, threshold)`` of each sample whose whole window is free; windows are of rows around it."""
    reach = models.groupBy("trace_id").agg(F.max(F.abs("offset")).alias("reach"))
    held = with_halo(numbered(rows.select("trace_id", "idx", F.when(F.col("free"), F.col("y")).alias("y")).join(reach, "trace_id")), F.col("reach"), PIECE, "row")
    samples = held.select("trace_id", "piece", "own", F.col("idx").cast("long").alias("idx"), "y", F.col("row").alias("place"), F.lit(None).cast("double").alias("spread"), F.lit(None).cast("double").alias("noise"), F.lit(None).cast("double").alias("threshold"))
    shape = samples.select("trace_id", "piece").distinct().join(models, "trace_id")
    shape = shape.select("trace_id", "piece", F.lit(False).alias("own"), F.col("offset").alias("idx"), F.col("mean").alias("y"), (F.col("offset") - 1_000_000_000).alias("place"), "spread", "noise", "threshold")

    def run(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        m = int(np.isfinite(g["spread"]).sum())
        mean, spread, noise, offset, y = g["y"][:m], g["spread"][:m], g["noise"][0], g["idx"][:m].astype(int), g["y"][m:]
        if len(y) < m:
            return np.zeros(0, dtype=np.int64), {"ratio": np.zeros(0), "limit": np.zeros(0)}
        total = np.zeros(len(y) - m + 1)
        for i in range(m):
            total += _ratios(y[i : i + len(total)], mean[i], spread[i], noise)
        at = np.arange(len(total)) - offset[0]
        keep = np.isfinite(total) & g["own"][m:][at].astype(bool)
        return at[keep] + m, {"ratio": total[keep], "limit": np.full(keep.sum(), g["threshold"][0])}

    out = map_groups(samples.unionByName(shape), ["trace_id", "piece"], "place", run, ["trace_id", "idx"], {"ratio": "double", "limit": "double"}, used=["own", "idx", "y", "spread", "noise", "threshold"])
    return out.withColumnRenamed("limit", "threshold")


def template_spikes(df: DataFrame, column: str, picks: DataFrame, baseline: str | None = None, blocked: Column | None = None, autopick: bool = False) -> DataFrame:
    """``(trace_id, spike_index, match_index, score, threshold, value, baseline, amplitude, noise, snr)`` of the spikes of each trace
    that look like its examples.

    ``picks`` has ``(trace_id, idx)``; with ``autopick`` traces without any take what stands twelve noises out
    (``threshold_spikes``).  ``df`` has each trace's rate as ``fs``.  The trace is high-passed and centred; a match is the best
    place of a stretch of ratios above the threshold, which noise alone passes in ``ALARMS`` of traces; the spike is the highest
    sample near it, or the lowest for examples that go down.  Of spikes closer than ``APART_MS`` the better match stays.
    Blocked and missing samples are in no window.  Traces without a whole example have no spikes.
    """
    flag = F.coalesce(blocked if blocked is not None else F.lit(False), F.lit(False))
    base = F.col(baseline) if baseline else F.lit(None)
    rows = df.select("trace_id", "idx", "t", "fs", finite(F.col(column)).alias("value"), base.cast("double").alias("baseline"), flag.alias("blocked"))
    rows = detection.filtered(cut_lineage(rows), "value", "fs", CUTOFF_HZ, 2, True, "y").withColumn("free", F.col("value").isNotNull() & ~F.col("blocked") & F.col("y").isNotNull())
    middle = rows.where("free").groupBy("trace_id").agg(stats.median("y").alias("c"), stats.median("value").alias("m"))
    rows = cut_lineage(rows.join(middle, "trace_id").withColumn("y", F.col("y") - F.col("c")).withColumn("baseline", F.coalesce("baseline", "m")).drop("c"))
    chosen = picks.select("trace_id", F.col("idx").cast("long").alias("idx")).distinct()
    if autopick:
        bare = rows.join(chosen.select("trace_id").distinct(), "trace_id", "left_anti").withColumn("far", samples_of(APART_MS))
        found = detection.threshold_spikes(bare, "value", 12.0, 3.0, "far", "std", "baseline", F.col("blocked"))
        chosen = chosen.unionByName(found.select("trace_id", F.col("spike_index").cast("long").alias("idx")))
    rates = rows.groupBy("trace_id").agg(F.max("fs").alias("fs"))
    picked = chosen.join(rates, "trace_id").withColumn("before", samples_of(BEFORE_MS)).withColumn("after", samples_of(AFTER_MS))
    models = cut_lineage(_models(rows, cut_lineage(_shapes(rows, picked))))
    ratios = cut_lineage(likelihood_ratios(rows.join(models.select("trace_id").distinct(), "trace_id"), models))
    above = ratios.where(F.col("ratio") > F.col("threshold"))
    stretches = masks.regions_of(above, F.lit(True))
    inside = above.join(stretches.select("trace_id", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("idx")), ["trace_id", "idx"])
    best = inside.groupBy("trace_id", "start").agg(F.max_by("idx", F.struct("ratio", -F.col("idx"))).alias("match"), F.max("ratio").alias("score"), F.max("threshold").alias("threshold"))
    near = best.join(rates, "trace_id").withColumn("reach", samples_of(NEAR_MS))
    near = near.select("trace_id", "match", "score", "threshold", F.explode(F.sequence(F.col("match") - F.col("reach"), F.col("match") + F.col("reach"))).alias("idx"))
    signs = models.groupBy("trace_id").agg(F.max("polarity").alias("polarity"))
    height = F.col("polarity") * (F.col("value") - F.col("baseline"))
    peaks = rows.where("free").select("trace_id", "idx", "value", "baseline").join(near, ["trace_id", "idx"]).join(signs, "trace_id").groupBy("trace_id", "match").agg(
        F.max_by(F.struct("idx", "value", "baseline"), F.struct(height, -F.col("idx"))).alias("p"), F.max("score").alias("score"), F.max("threshold").alias("threshold")
    )
    events = peaks.join(rates, "trace_id").select("trace_id", F.col("p.idx").alias("idx"), "match", "score", "threshold", F.col("p.value").alias("value"), F.col("p.baseline").alias("baseline"), samples_of(APART_MS).alias("apart"))

    def spaced(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        at, apart, free = g["idx"], g["apart"][0], np.ones(len(g["idx"]), dtype=bool)
        kept = []
        for i in np.argsort(-g["score"], kind="stable"):
            if free[i]:
                kept.append(i)
                free[np.searchsorted(at, at[i] - apart, "left") : np.searchsorted(at, at[i] + apart, "right")] = False
        kept = np.sort(np.array(kept, dtype=np.int64))
        return kept[g["own"][kept].astype(bool)], {}

    passed = ["trace_id", "idx", "match", "score", "threshold", "value", "baseline"]
    spikes = map_groups(with_halo(events, detection.HALO, detection.PIECE), ["trace_id", "piece"], "idx", spaced, passed, {}, used=["idx", "apart", "score", "own"])
    noise = rows.where("free").join(rows.where("free").groupBy("trace_id").agg(stats.median("value").alias("c")), "trace_id").groupBy("trace_id").agg(
        F.coalesce(F.nullif(stats.median(F.abs(F.col("value") - F.col("c"))) / 0.6745, F.lit(0.0)), F.stddev_pop("value")).alias("noise")
    )
    amplitude = F.col("value") - F.col("baseline")
    level = F.greatest("noise", F.lit(1e-9))
    return spikes.join(noise, "trace_id").select("trace_id", F.col("idx").alias("spike_index"), F.col("match").alias("match_index"), "score", "threshold", "value", "baseline", amplitude.alias("amplitude"), level.alias("noise"), (F.abs(amplitude) / level).alias("snr"))
