"""Registered queries of the training-data problems, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import leakage, quantiles, reading, runs, tokenize
from traceloom.sources.tables import table

#: Values in a buffer where the bound itself is put to the test.
SMALL_K = 16

#: The percentiles that p5 reports.
AT = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of at least two rows of a mask with the same state and label."""
    return runs.track_runs(table(spark, folder, "frame_tracks")).where("n_rows >= 2").select("source_tiff", "mask_index", "first_frame", "last_frame")


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run, of one row too, with its state, duration in frames and count."""
    return runs.track_runs(table(spark, folder, "frame_tracks")).select("source_tiff", "mask_index", "track_state", "first_frame", "last_frame", "frames", "n_rows")


def _daily(spark: SparkSession, folder: str, k: int = quantiles.K) -> DataFrame:
    return quantiles.summarise(quantiles.spike_rows(table(spark, folder, "spikes")), ["trace_name", "day"], list(quantiles.METRICS), k)


def _percentiles(spark: SparkSession, folder: str, k: int = quantiles.K) -> DataFrame:
    keys = ["trace_name", "metric"]
    return quantiles.read_off(quantiles.combine(_daily(spark, folder, k), keys, k), keys, AT)


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of each trace and metric from its combined daily summaries, with the bound of their rank error."""
    return _percentiles(spark, folder)


def p5_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Median of each trace, day and metric from the daily summary."""
    return quantiles.read_off(_daily(spark, folder), ["trace_name", "day", "metric"], [0.5]).withColumn("day", F.col("day").cast("string"))


def p5_within_bound(spark: SparkSession, folder: str) -> DataFrame:
    """For each trace and metric: count of values and whether every percentile's true rank is within the stated bound.

    Buffers are small here, so that most traces are collapsed, many times over.
    """
    asked = _percentiles(spark, folder, SMALL_K)
    values = quantiles.spike_values(table(spark, folder, "spikes")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    counted = values.select("trace_name", "metric", F.col("value").alias("v")).join(
        asked.groupBy("trace_name", "metric").agg(F.max("n").alias("n"), F.max("rank_error").alias("bound"), F.collect_list(F.struct("q", "value")).alias("at")), ["trace_name", "metric"]
    )
    ranks = counted.select("trace_name", "metric", "n", "bound", "v", F.explode("at").alias("a")).groupBy("trace_name", "metric", "n", "bound", F.col("a.q").alias("q")).agg(
        F.count_if(F.col("v") < F.col("a.value")).alias("below"), F.count_if(F.col("v") <= F.col("a.value")).alias("upto")
    )
    target = F.greatest(F.ceil(F.col("q") * F.col("n")), F.lit(1))
    inside = (F.col("below") - F.col("bound") < target) & (target <= F.col("upto") + F.col("bound"))
    return ranks.groupBy("trace_name", "metric").agg(F.max("n").alias("n"), F.every(inside).alias("within"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.token_ids(table(spark, folder, "documents"))


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of token ids of every document."""
    return p7_ids(spark, folder).select("doc_id", F.size("ids").cast("bigint").alias("tokens"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an evaluation item's text, whole or in part."""
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents hold each leaked item, how many of these its right answer too, and the most words of it in one."""
    held = leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return held.groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if("answered").alias("with_answer"), F.max("held").alias("most_words"))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "graded_passages"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reading band of every page with an English article."""
    return _levels(spark, folder).select("doc_id", "band")


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The band with the measures that it comes from."""
    return _levels(spark, folder)


QUERIES = {f.__name__: f for f in (p4_found, p4_runs, p5_percentiles, p5_daily, p5_within_bound, p7_ids, p7_counts, p8_found, p8_items, p9_found, p9_levels)}

_RUNS = r"""
with l as (
  select source_tiff, mask_index, frame, track_state is not null known, regexp_replace(regexp_replace(lower(track_state), '^\s*(track[ _]?)?state\s*[:=]', ''), '[^a-z]', '', 'g') s,
    regexp_replace(regexp_replace(lower(trim(coalesce(label, ''))), '[^a-z0-9]', '', 'g'), '(^|[^0-9])0+([0-9])', '\1\2', 'g') label
  from frame_tracks where source_tiff is not null and mask_index is not null and frame is not null),
c as (
  select distinct source_tiff, mask_index, frame, label, case when not known then null
    when levenshtein(s, 'accepted') <= 2 then 'accepted' when levenshtein(s, 'rescued') <= 2 then 'rescued' when levenshtein(s, 'held') <= 2 then 'held' when levenshtein(s, 'invalid') <= 2 then 'invalid' end state
  from l),
n as (select *, lag(frame) over w pf, lag(state) over w ps, lag(label) over w pl from c window w as (partition by source_tiff, mask_index order by frame, state, label)),
g as (select *, sum(case when state is not null and ps = state and pl = label and frame - pf <= 1 then 0 else 1 end) over (partition by source_tiff, mask_index order by frame, state, label rows unbounded preceding) r from n),
runs as (select source_tiff, mask_index, r, any_value(state) track_state, min(frame) first_frame, max(frame) last_frame, count(*) n_rows from g where state is not null group by all)
"""

_VALUES = """
with o as (
  select trace_name, spike_index, cast(min(detected_at) as date) as "day", case when trace_name is null or spike_index is null then hash(amplitude_above_baseline, snr, fwhm_ms) end h, min(amplitude_above_baseline) amplitude_above_baseline, min(snr) snr, min(fwhm_ms) fwhm_ms
  from spikes group by all),
v as (
  select trace_name, day, 'amplitude_above_baseline' metric, amplitude_above_baseline v from o union all select trace_name, day, 'snr', snr from o union all select trace_name, day, 'fwhm_ms', fwhm_ms from o)
"""

_RANKED = """, r as (select {keys}, metric, v, row_number() over (partition by {keys}, metric order by v) k, count(*) over (partition by {keys}, metric) n from v where v is not null and isfinite(v))
select {keys}, metric, n, 0.0::double rank_error, q, v as "value" from r join (select unnest([{at}]::double[]) q) on k = greatest(ceil(q * n), 1)"""

SQL = {
    "p4_found": _RUNS + "select source_tiff, mask_index, first_frame, last_frame from runs where n_rows >= 2",
    "p4_runs": _RUNS + "select source_tiff, mask_index, track_state, first_frame, last_frame, last_frame - first_frame + 1 frames, n_rows from runs",
    # up to K values a summary is exact, as all are at scale 0.01; p5_within_bound checks what lies above
    "p5_percentiles": _VALUES + _RANKED.format(keys="trace_name", at=", ".join(map(str, AT))),
    "p5_daily": _VALUES + _RANKED.format(keys="trace_name, day", at="0.5").replace("select trace_name, day, metric, n", "select trace_name, cast(day as varchar) as \"day\", metric, n"),
    "p5_within_bound": _VALUES + "select trace_name, metric, count(*) n, true as \"within\" from v where v is not null and isfinite(v) group by 1, 2",
}
