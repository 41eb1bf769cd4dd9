"""Registered queries over traces, events and masks, with the same in SQL.

Floating-point results come out as ``float``: sums depend on the order of the rows in their last digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import scalars
from traceloom.operators import detection, masks, signals, stats
from traceloom.session import cut_lineage
from traceloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _f(name: str | Column, alias: str | None = None) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return c.cast("float").alias(alias or name)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return signals.samples(table(spark, d, "trace_samples"))


def _present(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).where("raw is not null")


def _high(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Samples with their trace's median, and the regions above it."""
    rows = _present(spark, d)
    rows = rows.join(rows.groupBy("trace_id").agg(stats.median("raw").alias("m")), "trace_id")
    return rows, masks.regions_of(rows, F.col("raw") > F.col("m"))


def _rates(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """``(trace_id, fs)``: the rate of each trace's recording, or by its own times where that isn't known."""
    from traceloom.operators.clocks import sampling_rates as rates

    known = rates(table(spark, d, "recordings")).select("recording_id", F.col("rate").alias("fs"))
    traces = rows.select("trace_id").distinct().withColumn("recording_id", scalars.recording_of(F.col("trace_id"))).join(known, "recording_id", "left")
    unknown = signals.sampling_rates(rows.join(traces.where("fs is null").select("trace_id"), "trace_id", "left_semi"))
    return cut_lineage(traces.where("fs is not null").select("trace_id", "fs").unionByName(unknown))


def _rated(spark: SparkSession, d: str) -> DataFrame:
    """Present samples with ``fs``, the rate of their trace."""
    rows = _present(spark, d)
    return rows.join(_rates(spark, d, rows), "trace_id")


def _rec_sql(c: str) -> str:
    """The recording in a trace name."""
    return f"case when contains({c}, ' | ') and trim(split_part({c}, ' | ', 1)) <> '' then trim(split_part({c}, ' | ', 1)) else 'Ungrouped' end"


def _roi_sql(c: str) -> str:
    """The region in a trace name."""
    return f"case when contains({c}, ' | ') and trim(substr({c}, instr({c}, ' | ') + 3)) <> '' then trim(substr({c}, instr({c}, ' | ') + 3)) else {c} end"


_REC = """rec as (
  select recording_id, max(1000 / coalesce(case when sampling_rate_hz > 0 and isfinite(sampling_rate_hz) then sampling_rate_hz end,
    try_cast(regexp_extract(comment, '(?i)(\\d+(?:\\.\\d+)?)\\s*k?hz', 1) as double) * case when regexp_matches(comment, '(?i)\\d\\s*khz') then 1000 else 1 end)) period from recordings group by 1)"""

_X = """with s as (
  select trace_id, idx, min(case when isfinite(t) then t end) t, min(case when isfinite(raw) then raw end) raw, min(case when isfinite(corrected_source) then corrected_source end) c
  from trace_samples where trace_id is not null and idx is not null group by 1, 2),
x as (select trace_id, idx, t, raw, coalesce(c, raw) corrected from s),
p as (select * from x where raw is not null),
n as (select *, row_number() over (partition by trace_id order by idx) - 1 as row, count(*) over (partition by trace_id) as len from p),
m as (select p.*, m from p join (select trace_id, median(raw) m from p group by 1) using (trace_id)),
g as (select trace_id, idx, idx - row_number() over (partition by trace_id order by idx) i from m where raw > m),
r as (select trace_id, min(idx) s, max(idx) + 1 e from g group by trace_id, i),
q as (select *, max(e) over (partition by trace_id order by s rows between unbounded preceding and 1 preceding) pe from r),
"""


def _merge_sql(name: str, source: str, gap: int) -> str:
    """Regions of ``source`` (trace_id, s, e) at most ``gap`` apart put together as ``name``."""
    return f"""{name}_a as (select *, max(e) over (partition by trace_id order by s, e rows between unbounded preceding and 1 preceding) pe from {source}),
{name}_b as (select *, sum(case when pe is null or s > pe + {gap} then 1 else 0 end) over (partition by trace_id order by s, e rows unbounded preceding) i from {name}_a),
{name} as (select trace_id, min(s) s, max(e) e from {name}_b group by trace_id, i)"""


@query(_X[:-2].rsplit(",\np as", 1)[0] + " select trace_id, idx, t, raw, corrected from x")
def samples_long(spark, d):
    """Cleaned samples: repeated rows once, missing numbers null."""
    return _samples(spark, d)


@query("select distinct trace_id, " + _rec_sql("trace_id") + " recording_id, " + _roi_sql("trace_id") + " roi_id from trace_samples where trace_id is not null")
def trace_names(spark, d):
    """Traces with the recording and region in their names."""
    names = table(spark, d, "trace_samples").select("trace_id").where("trace_id is not null").distinct()
    return names.select("trace_id", scalars.recording_of(F.col("trace_id")).alias("recording_id"), scalars.roi_of(F.col("trace_id")).alias("roi_id"))


@query(
    """with f as (select source_tiff, frame, any_value(signals) signals from signal_frames group by 1, 2),
u as (select source_tiff, frame, unnest(signals) v, unnest(range(1, len(signals) + 1)) roi from f)
select source_tiff, frame, roi, case when isfinite(v) then v end as "value" from u"""
)
def signals_long(spark, d):
    """Wide signals of frames as one row per region."""
    once = table(spark, d, "signal_frames").groupBy("source_tiff", "frame").agg(F.any_value("signals").alias("signals"))
    out = once.select("source_tiff", "frame", F.posexplode("signals").alias("i", "v"))
    return out.select("source_tiff", "frame", (F.col("i") + 1).cast("bigint").alias("roi"), scalars.finite(F.col("v")).alias("value"))


@query(
    _X
    + """l as (select trace_id, t - lag(t) over (partition by trace_id order by idx) dt from x where t is not null),
k as (select trace_id, quantile_cont(dt, 0.5) dt from l where dt > 0 group by 1), hd as (select recording_id, replace(lower(time_header), ' ', '') h from recordings),
un as (select recording_id, max(case when contains(h, '(ms)') or ends_with(h, '_ms') or h = 'ms' or contains(h, 'millisecond') then 0.001 when contains(h, '(s)') or ends_with(h, '_s') or h in ('s', 'sec', 'secs', 'second', 'seconds') then 1.0 end) unit from hd group by 1)
select trace_id, cast(coalesce(case when unit is not null then 1 / (dt * unit) when 1 / dt < 5 and dt >= 0.001 then 1000 / dt else 1 / dt end, 1) as float) fs
from (select distinct trace_id from x) t left join k using (trace_id) left join un on recording_id = """ + _rec_sql("t.trace_id")
)
def sampling_rate(spark, d):
    """Sampling rate of each trace from its own times and the heading of its time column."""
    headers = table(spark, d, "recordings").select("recording_id", F.col("time_header").alias("header"))
    return signals.sampling_rates(_samples(spark, d), headers).select("trace_id", _f("fs"))


@query(_X + "k as (select trace_id, min(t) + 20 f, max(t) l from x where t is not null group by 1) select x.trace_id, idx, t from x join k using (trace_id) where l < f or t >= f")
def startup_filter(spark, d):
    """Samples after the first 20 units of time of each trace."""
    return signals.after_startup(_samples(spark, d), 20.0).select("trace_id", "idx", "t")


@query(_X + "z as (select 1) select trace_id, idx, t, raw from x where t between 10 and 60")
def time_window(spark, d):
    """Samples in a closed time window."""
    return signals.cropped(_samples(spark, d), 60.0, 10.0).select("trace_id", "idx", "t", "raw")


@query(_X + "z as (select trace_id, row // 4 as idx, avg(raw) raw, avg(t) t, count(*) c from n group by 1, 2) select trace_id, idx, cast(raw as float) raw, cast(t as float) t from z where c = 4")
def block_mean(spark, d):
    """Means of blocks of four samples."""
    return signals.block_means(_present(spark, d), 4, ["raw", "t"]).select("trace_id", "idx", _f("raw"), _f("t"))


@query(_X + "z as (select n.trace_id, row // 4 as idx, bool_or(n.raw > m.m) high, count(*) c from n join m using (trace_id, idx) group by 1, 2) select trace_id, idx, high from z where c = 4")
def block_any(spark, d):
    """Whether any of a block of four samples is above its trace's median."""
    rows, _ = _high(spark, d)
    return signals.block_means(rows.withColumn("high", F.col("raw") > F.col("m")), 4, [], ["high"])


@query(
    _X
    + """a as (select *, case when raw is not null and raw <= 2 * md then {'x': idx::double, 'y': raw} end a from x join (select trace_id, median(raw) md from p group by 1) using (trace_id)),
b as (select *, last_value(a ignore nulls) over (partition by trace_id order by idx rows between unbounded preceding and current row) l, first_value(a ignore nulls) over (partition by trace_id order by idx rows between current row and unbounded following) r from a)
select trace_id, idx, cast(case when a is not null then a.y when l is null and r is null then 0 when l is null then r.y when r is null then l.y else l.y + (r.y - l.y) * (idx - l.x) / (r.x - l.x) end as float) filled from b"""
)
def masked_interpolation(spark, d):
    """Samples above twice their trace's median, and missing ones, replaced along the line between their neighbours."""
    rows = _samples(spark, d)
    rows = rows.join(rows.groupBy("trace_id").agg(stats.median("raw").alias("md")), "trace_id")
    return signals.interpolated(rows, "raw", F.coalesce(F.col("raw") > 2 * F.col("md"), F.lit(False)), "idx", "filled").select("trace_id", "idx", _f("filled"))


def _rank_sql(half: int, rank: int, edges: str, what: str = "raw", source: str = "n") -> str:
    mapped = "least(greatest(k, 0), o.len - 1)" if edges == "nearest" else "case when k < 0 then -k when k > o.len - 1 then 2 * (o.len - 1) - k else k end"
    return f"""o as (select trace_id, idx, row, len, row + unnest(range({-half}, {half + 1})) k from {source}),
w as (select o.trace_id, o.idx, list_sort(list(v.{what}))[{rank + 1}] y from o join {source} v on v.trace_id = o.trace_id and v.row = {mapped} group by 1, 2)"""


@query(_X + _rank_sql(3, 3, "nearest") + " select trace_id, idx, y as smooth from w")
def rolling_median(spark, d):
    """Median of seven samples, ends repeated."""
    return signals.rolling_rank(_present(spark, d), "raw", 3, "smooth").select("trace_id", "idx", "smooth")


@query(_X + _rank_sql(5, 2, "reflect") + " select trace_id, idx, y as baseline from w")
def rolling_percentile(spark, d):
    """The rank of the 20th percentile in eleven samples, ends mirrored."""
    return signals.rolling_rank(_present(spark, d), "raw", 5, "baseline", 20.0, "reflect").select("trace_id", "idx", "baseline")


@query(_X + _rank_sql(3, 3, "nearest") + ", h as (select n.trace_id, n.idx, n.row, n.len, abs(n.raw - w.y) e from n join w using (trace_id, idx)), " + _rank_sql(2, 2, "nearest", "e", "h").replace("o as", "o2 as").replace("w as", "w2 as").replace("from o join", "from o2 o join") + " select trace_id, idx, cast(greatest(y, 1e-9) as float) noise from w2")
def local_noise(spark, d):
    """Rolling median of the distance from the rolling median."""
    smooth = signals.rolling_rank(_present(spark, d), "raw", 3, "smooth")
    return detection.local_noise(smooth, "raw", "smooth", 2, "noise").select("trace_id", "idx", _f("noise"))


@query(_X + _rank_sql(3, 3, "nearest") + " select n.trace_id, n.idx, cast(n.raw - w.y as float) high from n join w using (trace_id, idx)")
def high_frequency(spark, d):
    """What a sample has over the rolling median."""
    return signals.rolling_rank(_present(spark, d), "raw", 3, "smooth").select("trace_id", "idx", _f(F.col("raw") - F.col("smooth"), "high"))


@query(
    _X
    + """o as (select trace_id, idx, row, len, row + unnest(range(-2, 3)) k from n),
w as (select o.trace_id, o.idx, sum(v.raw) / 5 y from o join n v on v.trace_id = o.trace_id and v.row = case when k < 0 then -k when k > o.len - 1 then 2 * (o.len - 1) - k else k end group by 1, 2)
select trace_id, idx, cast(y as float) smooth from w"""
)
def moving_mean(spark, d):
    """Mean of five samples, ends mirrored."""
    return signals.moving_mean(_present(spark, d), "raw", 2, "smooth").select("trace_id", "idx", _f("smooth"))


@query(
    _X
    + """l as (select *, raw - lag(raw) over w d1, lag(raw, 5) over w past from p window w as (partition by trace_id order by idx)),
k as (select trace_id, greatest(coalesce(avg(abs(d1)), 0), 1e-9) noise from l group by 1)
select trace_id, idx, cast(case when past is null then 0 else (raw - past) / noise end as float) snr from l join k using (trace_id)"""
)
def snr_trace(spark, d):
    """Change over five samples in units of the mean step."""
    return signals.lagged_snr(_present(spark, d), "raw", 5, "snr").select("trace_id", "idx", _f("snr"))


@query(_X + "z as (select *, raw - lag(raw) over (partition by trace_id order by idx) step from p) select trace_id, idx, cast(step as float) step from z")
def sample_steps(spark, d):
    """Change from the sample before."""
    return detection.steps(_present(spark, d), "raw", "step").select("trace_id", "idx", _f("step"))


_F0 = """f as (select trace_id, median(raw) a, median(corrected) b from x group by 1),
ff as (select trace_id, case when abs(a) > 1e-12 then a when abs(b) > 1e-12 then b else 1 end f0, case when abs(a) > 1e-12 then 'raw' when abs(b) > 1e-12 then 'corrected' else 'unit_fallback' end f0_source from f)
"""


@query(_X + _F0 + "select trace_id, idx, cast(100 * corrected / f0 as float) dff from x join ff using (trace_id)")
def percent_dff(spark, d):
    """Samples in percent of their trace's F0: the median of what was recorded, or of what was corrected, or 1."""
    return signals.percent_dff(_samples(spark, d), "corrected", "dff", ["raw", "corrected"]).select("trace_id", "idx", _f("dff"))


@query(_X + _F0 + "select trace_id, " + _rec_sql("trace_id") + " recording_id, " + _roi_sql("trace_id") + " roi_id, f0_source, cast(f0 as float) f0 from ff")
def trace_normalization(spark, d):
    """What each trace is divided by when it is shown in percent, and where that comes from."""
    out = signals.f0_of(_samples(spark, d), ["raw", "corrected"])
    return out.select("trace_id", scalars.recording_of(F.col("trace_id")).alias("recording_id"), scalars.roi_of(F.col("trace_id")).alias("roi_id"), "f0_source", _f("f0"))


@query(
    _X
    + _rank_sql(3, 3, "nearest")
    + ", "
    + _REC
    + """, h as (select n.*, w.y from n join w using (trace_id, idx)), ra as (select trace_id, greatest(2, cast(round_even(20 / period, 0) as bigint) // 2) hf from (select distinct trace_id from n) join rec on recording_id = """
    + _rec_sql("trace_id")
    + """),
o3 as (select trace_id, idx, row, len, raw, row + unnest(range(-hf, hf + 1)) k, hf from h join ra using (trace_id)),
w3 as (select o3.trace_id, o3.idx, any_value(o3.raw) raw, list_sort(list(v.y))[any_value(hf) + 1] f0 from o3 join h v on v.trace_id = o3.trace_id and v.row = least(greatest(o3.k, 0), o3.len - 1) group by 1, 2)
select trace_id, idx, cast(f0 as float) f0, cast((raw - f0) / greatest(abs(f0), 1e-9) as float) dff from w3"""
)
def rolling_dff(spark, d):
    """Change over a rolling median of the smoothed trace, 20 ms at each trace's own rate."""
    rows = signals.rolling_rank(_rated(spark, d), "raw", 3, "smooth")
    out = signals.rolling_dff(rows, "raw", "smooth", F.greatest(F.lit(2), F.floor(signals.samples_of(20.0) / 2)), "dff")
    return out.select("trace_id", "idx", _f("f0"), _f("dff"))


@query(_X + "z as (select 1) select trace_id, s as start, e as \"end\" from r")
def mask_regions(spark, d):
    """Stretches above the median."""
    return _high(spark, d)[1]


@query(_X + _merge_sql("z", "r", 3) + " select trace_id, s as start, e as \"end\" from z")
def merged_regions(spark, d):
    """Stretches above the median, those at most three samples apart as one."""
    return masks.merged(_high(spark, d)[1], 3)


@query(_X + "w as (select trace_id, greatest(s - 4, 0) s, least(e + 4, top) e from r join (select trace_id, max(idx) + 1 top from p group by 1) using (trace_id)), " + _merge_sql("z", "w", 0) + " select trace_id, s as start, e as \"end\" from z")
def dilated_regions(spark, d):
    """Stretches above the median, widened by four samples."""
    rows, regions = _high(spark, d)
    return masks.dilated(regions, 4, rows.groupBy("trace_id").agg((F.max("idx") + 1).alias("n")))


@query(_X + "z as (select 1) select trace_id, s as start, e as \"end\" from r where e - s >= 6")
def long_regions(spark, d):
    """Stretches above the median of at least six samples."""
    return masks.at_least(_high(spark, d)[1], 6)


@query(_X + "z as (select *, row_number() over (partition by trace_id order by e - s desc, s) k from r) select trace_id, s as start, e as \"end\" from z where k = 1")
def longest_region(spark, d):
    """The longest stretch of each trace above its median."""
    return masks.longest(_high(spark, d)[1])


@query(_X + "z as (select trace_id, unnest(range(s, e - 4)) idx from r where e - s >= 5) select trace_id, idx from z")
def run_start_samples(spark, d):
    """Samples from which five in a row are above the median."""
    return masks.run_starts(_high(spark, d)[1], 5)


_GAPS = (
    _REC
    + """, gs as (select trace_id, greatest(1, round_even(180 / period, 0)) g1, greatest(1, round_even(45 / period, 0)) g2, greatest(1, round_even(90 / period, 0)) g3 from (select distinct trace_id from p) join rec on recording_id = """
    + _rec_sql("trace_id")
    + "), "
)
_SPACED = (
    _merge_sql("a1", "(select trace_id, s, e + g1 e from r join gs using (trace_id))", 0)
    + ", a2 as (select trace_id, greatest(s - g2, 0) s, e - g1 + g2 e from a1 join gs using (trace_id)), "
    + _merge_sql("a3", "a2", 0)
    + ", "
    + _merge_sql("a4", "(select trace_id, s, e + g3 e from a3 join gs using (trace_id))", 0)
)


@query(_X + _GAPS + _SPACED + " select trace_id, cast(s as bigint) as start, cast(e - g3 as bigint) as \"end\" from a4 join gs using (trace_id)")
def blocked_spans(spark, d):
    """Stretches above the median as blocked spans at each trace's rate: gaps closed, widened, gaps closed again."""
    rows, regions = _high(spark, d)
    return masks.artifact_blocks(regions, _rates(spark, d, rows))


@query(_X + _merge_sql("z", "r", 3) + " select p.trace_id, p.idx, exists(select 1 from z where z.trace_id = p.trace_id and p.idx >= z.s and p.idx < z.e) inside from p")
def mask_of_regions(spark, d):
    """Regions back as a mask over the samples."""
    rows, regions = _high(spark, d)
    return masks.covered(rows.select("trace_id", "idx"), masks.merged(regions, 3), "inside")


_BURSTS = "b as (select trace_name trace_id, burst_index, min(start_index) s2, min(end_index) e2 from bursts where trace_name is not null and start_index is not null and end_index > start_index group by 1, 2)"


def _burst_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bursts").where("trace_name is not null and start_index is not null and end_index > start_index")
    return rows.groupBy(F.col("trace_name").alias("trace_id"), "burst_index").agg(F.min("start_index").alias("start"), F.min("end_index").alias("end"))


@query(
    _X
    + _BURSTS
    + """, o as (select r.trace_id, s, e, burst_index, least(e, e2) - greatest(s, s2) ov, row_number() over (partition by r.trace_id, s, e order by least(e, e2) - greatest(s, s2) desc, s2, e2, burst_index) k
  from r join b on r.trace_id = b.trace_id and s < e2 and s2 < e)
select r.trace_id, r.s as start, r.e as "end", cast(coalesce(ov, 0) as bigint) overlap from r left join (select * from o where k = 1) o on r.trace_id = o.trace_id and r.s = o.s and r.e = o.e"""
)
def region_overlap_join(spark, d):
    """Each stretch above the median with its greatest overlap with a burst."""
    return masks.best_overlap(_high(spark, d)[1], _burst_regions(spark, d), [])


@query(
    _X
    + _BURSTS
    + """, l as (select * from r where e - s >= 6)
select r.trace_id, r.s as start, r.e as "end", case when r.e - r.s >= 6 then 'long' when exists(select 1 from b where b.trace_id = r.trace_id and s2 < r.e and r.s < e2) then 'burst' else 'unknown' end source from r"""
)
def source_priority(spark, d):
    """Where a stretch comes from: a long one first, else a burst, else unknown."""
    regions = _high(spark, d)[1]
    return masks.labelled_by_priority(regions, [("long", masks.at_least(regions, 6)), ("burst", _burst_regions(spark, d))])


@query(_X + "z as (select 1) select trace_id, count(*) n, cast(avg(raw) as float) mean, cast(median(raw) as float) median, cast(stddev_pop(raw) as float) sd, cast(min(raw) as float) least, cast(max(raw) as float) most from p group by 1")
def described(spark, d):
    """Count, mean, median, deviation and extremes of each trace."""
    return stats.described(_samples(spark, d), ["trace_id"], "raw").select("trace_id", "n", *(_f(c) for c in ("mean", "median", "sd", "least", "most")))


@query(
    _X
    + """a as (select trace_id, any_value(m) c, coalesce(median(raw) filter (raw < m), any_value(m)) lo from m group by 1)
select trace_id, cast(any_value(c) as float) centre, cast(greatest(median(abs(raw - lo)) filter (raw < c or lo = c) / 0.6745, 1e-9) as float) noise from p join a using (trace_id) group by 1"""
)
def noise_mad(spark, d):
    """Centre and noise by the lower median absolute deviation."""
    return stats.noise_mad(_present(spark, d), ["trace_id"], "raw").select("trace_id", _f("centre"), _f("noise"))


@query(
    _X
    + """a as (select trace_id, avg(raw) c, stddev_pop(raw) s from p group by 1)
select trace_id, cast(any_value(c) as float) centre, cast(greatest(coalesce(stddev_pop(raw) filter (raw < c), any_value(s)), 1e-9) as float) noise from p join a using (trace_id) group by 1"""
)
def noise_std(spark, d):
    """Centre and noise by the deviation below the mean."""
    return stats.noise_std(_present(spark, d), ["trace_id"], "raw").select("trace_id", _f("centre"), _f("noise"))


@query(_X + "a as (select trace_id, median(abs(raw - m)) d, stddev_pop(raw) s from m group by 1) select trace_id, cast(greatest(case when d > 1e-12 then d else s end, 1e-9) as float) mad from a")
def mad_or_sd(spark, d):
    """Median absolute deviation, or the deviation where that is 0."""
    return stats.mad_or_sd(_present(spark, d), ["trace_id"], "raw").select("trace_id", _f("mad"))


@query(
    _X
    + """l as (select trace_id, raw - lag(raw) over (partition by trace_id order by idx) v from p), k as (select l.*, md from l join (select trace_id, median(v) md from l group by 1) using (trace_id) where v is not null)
select trace_id, cast(1.4826 * median(abs(v - md)) / sqrt(2.0) as float) noise from k group by 1"""
)
def step_noise(spark, d):
    """Noise of each trace from its steps."""
    return stats.step_noise(_present(spark, d), "raw").select("trace_id", _f("noise"))


@query(
    _X
    + """v as (select trace_id, raw v from m where raw < 2 * m and raw > 0), a as (select trace_id, min(v) lo, max(v) hi, count(*) n from v group by 1),
h as (select trace_id, least(floor((v - lo) / ((hi - lo) / 64)), 63) bin, count(*) c, any_value(lo) lo, any_value(hi) hi, any_value(n) n from v join a using (trace_id) where hi > lo group by 1, 2),
k as (select trace_id, bin, lo + (bin + 0.5) * ((hi - lo) / 64) centre, c / n pr from h),
z as (select *, sum(pr) over w om, sum(pr * centre) over w mu, sum(pr * centre) over (partition by trace_id) tot from k window w as (partition by trace_id order by bin rows unbounded preceding)),
y as (select *, round(case when om * (1 - om) > 1e-12 then pow(tot * om - mu, 2) / (om * (1 - om)) else 0 end, 9) b from z),
t as (select trace_id, centre, row_number() over (partition by trace_id order by b desc, bin) k from y)
select trace_id, cast(centre as float) threshold from t where k = 1 union all select trace_id, cast(lo as float) from a where hi <= lo"""
)
def otsu_threshold(spark, d):
    """Otsu threshold of each trace's ordinary values in 64 bins."""
    rows, _ = _high(spark, d)
    return stats.otsu(rows.where("raw < 2 * m and raw > 0"), ["trace_id"], "raw", 64).select("trace_id", _f("threshold"))


@query(
    _X
    + """a as (select trace_id, quantile_cont(raw, 0.05) p5, quantile_cont(raw, 0.95) p95 from p group by 1), b as (select *, greatest(p95, -p5, 1e-9) v from a),
c as (select *, case when v > 0 then pow(10.0, floor(log10(v))) end pw from b)
select trace_id, cast(p5 as float) p5, cast(p95 as float) p95, case when greatest(-p5, 0) > greatest(p95, 0) then 'negative' else 'positive' end polarity,
  cast(case when v > 0 then pw * case when v / pw >= 5 then 5 when v / pw >= 2 then 2 else 1 end else 1 end as float) scale from c"""
)
def robust_scale(spark, d):
    """Polarity and a round scale of each trace."""
    return stats.robust_scale(_present(spark, d), ["trace_id"], "raw").select("trace_id", _f("p5"), _f("p95"), "polarity", _f("scale"))


_SPIKES = (
    "with " + _REC + """,
o as (
  select trace_name trace_id, spike_index, min(case when isfinite(amplitude_above_baseline) then amplitude_above_baseline end) amplitude, min(case when isfinite(delta_f_over_f0) then delta_f_over_f0 end) dff,
    min(case when isfinite(baseline_at_spike) then baseline_at_spike end) f0, min(case when isfinite(snr) then snr end) snr, min(case when isfinite(rise_time_ms) then rise_time_ms end) rise_time_ms,
    min(case when isfinite(fwhm_ms) then fwhm_ms end) fwhm_ms, min(case when isfinite(return_to_baseline_time_ms) then return_to_baseline_time_ms end) return_to_baseline_time_ms,
    min(case when isfinite(post_spike_level) then post_spike_level end) post_spike_level, min(source) source
  from spikes where trace_name is not null and spike_index is not null and coalesce(status, '') <> 'deleted' group by 1, 2),
l as (select o.*, row_number() over w k, (spike_index - lag(spike_index) over w) * period isi from o left join rec on recording_id = """ + _rec_sql("trace_id") + """ window w as (partition by trace_id order by spike_index)),
ev as (select trace_id, """ + _rec_sql("trace_id") + " recording_id, " + _roi_sql("trace_id") + """ roi_id, printf('%04d', k) spike_id, spike_index peak_index, amplitude,
  coalesce(dff, case when f0 <> 0 then amplitude / f0 end) delta_f_over_f0, snr, rise_time_ms, fwhm_ms, return_to_baseline_time_ms, post_spike_level, isi isi_ms, case when isi > 0 then 1000 / isi end instantaneous_firing_rate_hz, source from l)
"""
)


def _events(spark: SparkSession, d: str) -> DataFrame:
    from traceloom.operators.clocks import sampling_rates as rates

    periods = rates(table(spark, d, "recordings")).select("recording_id", (1000 / F.col("rate")).alias("period_ms"))
    return stats.spike_events(table(spark, d, "spikes"), periods)


@query(_SPIKES + "select trace_id, recording_id, roi_id, spike_id, peak_index, source, " + ", ".join(f"cast({c} as float) {c}" for c in stats.SPIKE_METRICS) + " from ev")
def spike_events(spark, d):
    """Spike events with ids, intervals and rates."""
    return _events(spark, d).select("trace_id", "recording_id", "roi_id", "spike_id", "peak_index", "source", *(_f(c) for c in stats.SPIKE_METRICS))


@query(
    _SPIKES
    + "select t.trace_id, count(peak_index) spike_count, "
    + ", ".join(f"cast(round(avg({c}), 9) + 0.0 as float) mean_{c}, cast(round(median({c}), 9) + 0.0 as float) median_{c}" for c in stats.SPIKE_METRICS)
    + " from (select distinct trace_id from trace_samples where trace_id is not null) t left join ev using (trace_id) group by 1"
)
def spike_summary(spark, d):
    """Per trace: spikes, means and medians of their metrics."""
    out = stats.spike_summary(_events(spark, d), table(spark, d, "trace_samples").where("trace_id is not null"))
    return out.select("trace_id", "spike_count", *(_f(F.round(c, 9) + 0.0, c) for c in out.columns if c not in ("trace_id", "spike_count")))


_EVENTS = """with e as (
  select trace_name trace_id, burst_index event_id, min(case when isfinite(start_time) then start_time end) onset, min(case when isfinite(duration_ms) then duration_ms end) dur,
    min(case when isfinite(amplitude_above_baseline) then amplitude_above_baseline end) peak, min(case when isfinite(mean_snr) then mean_snr end) snr, min(case when isfinite(local_noise_estimate) then local_noise_estimate end) noise
  from bursts where trace_name is not null and burst_index is not null group by 1, 2)"""

_SUMMARY = (
    _EVENTS
    + """,
gp as (select trace_id, onset - lag(onset) over (partition by trace_id order by onset) gap from e where onset is not null),
""" + _REC + """, tt as (select trace_id, case when c >= 2 then c * period end total from (
  select trace_id, count(*) filter (ok) c from (select trace_id, idx, bool_or(t is not null and isfinite(t)) ok from trace_samples where trace_id is not null and idx is not null group by 1, 2) group by 1) left join rec on recording_id = """ + _rec_sql("trace_id") + """),
a as (select trace_id, count(*) c, min(onset) fo, avg(dur) md, median(dur) nd, avg(peak) mp, median(peak) np, coalesce(sum(dur), 0) td from e group by 1),
b as (select trace_id, avg(gap) mi, median(gap) ni from gp where gap > 0 group by 1),
z as (select tt.trace_id, coalesce(c, 0) event_count, fo first_onset_ms, md mean_duration_ms, nd median_duration_ms, mp mean_peak_amp, np median_peak_amp, coalesce(td, 0) total_event_time_ms, case when total > 0 then coalesce(td, 0) / total end event_time_fraction, mi mean_interval_ms, ni median_interval_ms
    from tt left join a using (trace_id) left join b using (trace_id)
  union all select 'ALL', count(*), null, avg(dur), median(dur), avg(peak), median(peak), coalesce(sum(dur), 0), null, (select avg(gap) from gp where gap > 0), (select median(gap) from gp where gap > 0) from e having count(*) > 0)
"""
)

_SUMMARY_COLUMNS = ("first_onset_ms", "mean_duration_ms", "median_duration_ms", "mean_peak_amp", "median_peak_amp", "total_event_time_ms", "event_time_fraction", "mean_interval_ms", "median_interval_ms")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d)
    timed = rows.groupBy("trace_id").agg(F.count("t").alias("n")).join(_rates(spark, d, rows), "trace_id")
    totals = timed.select("trace_id", F.when(F.col("n") >= 2, F.col("n") * (1000 / F.col("fs"))).alias("total_ms"))
    return stats.trace_summary(stats.event_table(table(spark, d, "bursts")), totals)


@query(_SUMMARY + "select trace_id, event_count, " + ", ".join(f"cast({c} as float) {c}" for c in _SUMMARY_COLUMNS) + " from z")
def trace_summary(spark, d):
    """Summary of the events of each trace, and of all."""
    return _summary(spark, d).select("trace_id", "event_count", *(_f(c) for c in _SUMMARY_COLUMNS))


def _outlier_sql(source: str, column: str, name: str) -> str:
    return f"""{name}_s as (select count({column}) n, quantile_cont({column}, 0.25) q1, median({column}) m, quantile_cont({column}, 0.75) q3, max({column}) top from {source}),
{name}_d as (select median(abs({column} - m)) d from {source}, {name}_s),
{name} as (select *, coalesce(n >= 4 and case when d > 0 then 0.6745 * ({column} - m) / d > 4.5 when q3 > q1 then {column} > q3 + 3 * (q3 - q1) when top > m then {column} = top else false end, false) {name}_flag from {source}, {name}_s, {name}_d)"""


@query(
    _SUMMARY.rstrip()
    + ", "
    + _outlier_sql("z", "event_count", "c1")
    + ", c1b as (select * exclude (n, q1, m, q3, top, d) from c1), "
    + _outlier_sql("c1b", "mean_duration_ms", "c2")
    + ", q as (select trace_id, event_count, concat_ws('; ', case when event_count <= 0 then 'no_events' end, case when c1_flag then 'high_event_count' end, case when c2_flag then 'high_duration' end) qc_notes from c2) select *, case when qc_notes = '' then 'ok' else 'review' end qc_status from q"
)
def trace_qc(spark, d):
    """Summary rows with what is to be reviewed."""
    return stats.trace_qc(_summary(spark, d), {"event_count": "event_count", "mean_duration_ms": "duration"}).select("trace_id", "event_count", "qc_notes", "qc_status")


@query(_EVENTS + ", " + _outlier_sql("e", "dur", "c1") + ", c1b as (select * exclude (n, q1, m, q3, top, d) from c1), " + _outlier_sql("c1b", "peak", "c2") + " select trace_id, event_id, c1_flag duration_outlier, c2_flag amplitude_outlier from c2")
def event_qc(spark, d):
    """Events of unusual duration or amplitude among all."""
    out = stats.high_outliers(stats.event_table(table(spark, d, "bursts")), [], "duration_ms", "duration_outlier")
    return stats.high_outliers(out, [], "peak_amp_above_baseline", "amplitude_outlier").select("trace_id", "event_id", "duration_outlier", "amplitude_outlier")


@query(_SUMMARY + ", k as (select trace_id, event_count, row_number() over (order by event_count desc, trace_id) place from z where trace_id <> 'ALL') select * from k where place <= 18")
def report_top(spark, d):
    """The 18 traces with most events."""
    from pyspark.sql import Window

    top = _summary(spark, d).where("trace_id <> 'ALL'").select("trace_id", "event_count").orderBy(F.desc("event_count"), "trace_id").limit(18)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("event_count"), "trace_id")).cast("bigint"))


@query(
    _X
    + _merge_sql("z", "r", 3)
    + """, i as (select z.*, median(raw) lv, count(*) n from z join p on p.trace_id = z.trace_id and idx >= s and idx < e group by all),
f as (select trace_id, median(raw) fl, stddev_pop(raw) sp from p where not exists(select 1 from z where z.trace_id = p.trace_id and idx >= s and idx < e) group by 1),
c as (select *, (lv - fl) / greatest(sp, 1e-9) lift from i join f using (trace_id)), k as (select *, row_number() over (partition by trace_id order by lift * sqrt(n) desc, s) place from c where lift >= 1.8)
select trace_id, s as start, e as "end", place from k where place <= 3"""
)
def strongest_regions(spark, d):
    """The three strongest stretches of each trace."""
    rows, regions = _high(spark, d)
    return stats.strongest_regions(rows, masks.merged(regions, 3), "raw").withColumn("place", F.col("place").cast("bigint"))


@query(_X + _merge_sql("z", "r", 3) + " select z.trace_id, s as start, e as \"end\", count(raw) samples, cast(min(t) as float) onset_time, cast(max(t) as float) last_time, cast(avg(raw) as float) mean, cast(stddev_pop(raw) as float) sd, max(raw) peak, arg_min(idx, {'a': -raw, 'b': idx}) peak_index from z join p on p.trace_id = z.trace_id and idx >= s and idx < e group by all")
def region_statistics(spark, d):
    """Samples, times, mean, deviation and peak of each stretch."""
    rows, regions = _high(spark, d)
    out = detection.region_stats(rows, masks.merged(regions, 3), "raw")
    return out.select("trace_id", "start", "end", "samples", _f("onset_time"), _f("last_time"), _f("mean"), _f("sd"), "peak", "peak_index")


@query(
    _X
    + """w as (select trace_id, s onset from r where e - s >= 6)
select w.trace_id, onset, idx - onset as "offset", raw from w join p on p.trace_id = w.trace_id and idx between onset - 5 and onset + 10"""
)
def aligned_windows(spark, d):
    """Samples around the onset of each long stretch."""
    rows, regions = _high(spark, d)
    onsets = masks.at_least(regions, 6).select("trace_id", F.col("start").alias("onset"))
    return signals.aligned_windows(rows.select("trace_id", "idx", "raw"), onsets, 5, 10).select("trace_id", "onset", "offset", "raw")


_WANTED = "wt as (select distinct trace_name trace_id, start_time wanted_t from bursts where isfinite(start_time) and trace_name is not null)"


@query(
    _X
    + _WANTED
    + """, c as (select wt.trace_id, wanted_t, idx, row_number() over (partition by wt.trace_id, wanted_t order by abs(t - wanted_t), t, idx) k from wt join x on x.trace_id = wt.trace_id where t is not null)
select wt.trace_id, wt.wanted_t, coalesce(idx, -1) idx from wt left join (select * from c where k = 1) c on c.trace_id = wt.trace_id and c.wanted_t = wt.wanted_t"""
)
def nearest_sample(spark, d):
    """The sample nearest in time to the start of each burst, -1 where the trace has no samples in time."""
    wanted = table(spark, d, "bursts").where("trace_name is not null").select(F.col("trace_name").alias("trace_id"), scalars.finite(F.col("start_time")).alias("at")).where("at is not null").distinct()
    return detection.nearest_sample(_samples(spark, d), wanted).select("trace_id", F.col("at").alias("wanted_t"), F.coalesce("idx", F.lit(-1)).cast("bigint").alias("idx"))


@query(
    _X
    + """sp as (select distinct trace_name trace_id, spike_index from spikes where trace_name is not null and spike_index is not null),
c as (select x.trace_id, idx, spike_index, row_number() over (partition by x.trace_id, idx order by abs(idx - spike_index), spike_index) k from x join sp on sp.trace_id = x.trace_id and abs(idx - spike_index) <= 8)
select trace_id, idx, spike_index from c where k = 1"""
)
def nearest_spike(spark, d):
    """The spike nearest to each sample, within eight samples."""
    spikes = table(spark, d, "spikes").where("trace_name is not null and spike_index is not null").select(F.col("trace_name").alias("trace_id"), "spike_index").distinct()
    return detection.nearest_spike(_samples(spark, d), spikes)


@query(
    _X
    + """l as (select *, raw - lag(raw) over w st, quantile_cont(raw, 0.5) over (partition by trace_id order by idx rows between 79 preceding and current row) us from p window w as (partition by trace_id order by idx)),
f as (select *, coalesce(st <= -6, false) fa from l), h as (select *, coalesce(lag(fa) over (partition by trace_id order by idx), false) fb from f),
sd as (select trace_id, idx, idx - row_number() over (partition by trace_id order by idx) i from h where raw <= 120 and us - raw >= 8 and (fa or fb)),
rr as (select trace_id, min(idx) s, max(idx) + 1 e from sd group by trace_id, i), """
    + _merge_sql("z", "rr", 1)
    + ' select trace_id, s as start, e as "end" from z'
)
def dropout_seeds(spark, d):
    """Seeds of downward dropouts."""
    return detection.dropouts(_present(spark, d), "raw")


def _spikes(spark: SparkSession, d: str, mode: str = "std") -> DataFrame:
    """Spikes over a rolling baseline, 25 ms apart and with lags of 12.5 ms at each trace's own rate."""
    rows = _rated(spark, d).withColumn("far", signals.samples_of(25.0)).withColumn("lag", signals.samples_of(12.5))
    rows = signals.rolling_rank(rows, "raw", 20, "base", 20.0, "reflect")
    return detection.threshold_spikes(rows, "raw", distance="far", mode=mode, baseline="base", lag="lag")


@query()
def threshold_spikes(spark, d):
    """Maxima well above the mean, apart and prominent, with their height over a rolling baseline."""
    return _spikes(spark, d)


@query()
def threshold_spikes_mad(spark, d):
    """The same over the median by the lower median absolute deviation."""
    return _spikes(spark, d, "mad")


@query()
def threshold_spikes_snr(spark, d):
    """Maxima of the change over 12.5 ms in units of the mean step."""
    return _spikes(spark, d, "snr")


_PLATEAU = (
    _X
    + _rank_sql(20, 8, "reflect")
    + """, ab as (select n.trace_id, n.idx, n.raw - w.y v from n join w using (trace_id, idx)), ce as (select trace_id, median(v) c from ab group by 1),
d1 as (select trace_id, median(abs(v - c)) mad, stddev_pop(v) sd, any_value(c) c from ab join ce using (trace_id) group by 1),
lo as (select ab.* from ab join ce using (trace_id) where v <= c), lc as (select trace_id, median(v) c2, count(*) k from lo group by 1),
d2 as (select trace_id, median(abs(v - c2)) mad, stddev_pop(v) sd, any_value(k) k from lo join lc using (trace_id) group by 1),
ns as (select trace_id, d1.c, greatest(case when d1.mad > 1e-12 then d1.mad else d1.sd end, 1e-9) m1, greatest(case when d2.mad > 1e-12 then d2.mad else d2.sd end, 1e-9) m2, d2.k from d1 join d2 using (trace_id)),
nz as (select trace_id, c, case when k >= 8 then greatest(m1, m2) else m1 end z from ns),
a0 as (select trace_id, min(v) lo, max(v) hi, count(*) n from ab group by 1),
hb as (select trace_id, least(floor((v - lo) / ((hi - lo) / 256)), 255) bin, count(*) c, any_value(lo) lo, any_value(hi) hi, any_value(n) n from ab join a0 using (trace_id) where hi > lo group by 1, 2),
kb as (select trace_id, bin, lo + (bin + 0.5) * ((hi - lo) / 256) centre, c / n pr from hb),
zb as (select *, sum(pr) over w om, sum(pr * centre) over w mu, sum(pr * centre) over (partition by trace_id) tot from kb window w as (partition by trace_id order by bin rows unbounded preceding)),
yb as (select *, round(case when om * (1 - om) > 1e-12 then pow(tot * om - mu, 2) / (om * (1 - om)) else 0 end, 9) b from zb),
ot as (select trace_id, arg_max(centre, {'b': b, 'bin': -bin}) th from yb group by 1 union all select trace_id, lo from a0 where hi <= lo),
en as (select trace_id, c, z, greatest(th, c + 5.0 * z) hi from ot join nz using (trace_id)),
lv as (select trace_id, hi, least(hi, greatest(c + 2.0 * z, c + 0.5 * (hi - c))) low from en),
sc as (select trace_id, idx, v > hi up, v <= low dn from ab join lv using (trace_id)),
ru as (select trace_id, min(idx) idx, true up, count(*) c from (select *, idx - row_number() over (partition by trace_id order by idx) i from sc where up) group by trace_id, i),
rd as (select trace_id, min(idx) idx, false up, count(*) c from (select *, idx - row_number() over (partition by trace_id order by idx) i from sc where dn) group by trace_id, i),
ev as (select trace_id, idx, up from ru where c >= 4 union all select trace_id, idx, up from rd where c >= 4),
tu as (select *, lag(up) over (partition by trace_id order by idx) was from ev), tt as (select * from tu where up <> coalesce(was, false)),
en2 as (select trace_id, idx, up, lead(idx) over (partition by trace_id order by idx) e from tt)
select en2.trace_id, idx as start, coalesce(e, top) as "end" from en2 join (select trace_id, max(idx) + 1 top from ab group by 1) using (trace_id) where up and coalesce(e, top) - idx >= 6"""
)


@query(_PLATEAU)
def long_plateaus(spark, d):
    """Raised stretches over the drift of each trace."""
    return detection.long_plateaus(_present(spark, d), "raw", half=20, enter=4, leave=4, shortest=6)


@query()
def spike_waveforms(spark, d):
    """Rise, width and return of each detected spike in milliseconds at its trace's own rate."""
    rows = _present(spark, d)
    shapes = detection.waveforms(rows, detection.threshold_spikes(rows, "raw"), "raw", 6).join(_rates(spark, d, rows), "trace_id")
    ms = lambda c: (F.col(c) * 1000 / F.col("fs")).alias(f"{c}_ms")
    return shapes.select("trace_id", "spike_index", ms("rise"), ms("fwhm"), ms("back"))


@query()
def lowpass(spark, d):
    """Samples after a zero-phase low-pass at 40 Hz, by each trace's own rate."""
    rows = _rated(spark, d)
    return detection.filtered(rows, "raw", "fs", 40.0, 5, False, "low").select("trace_id", "idx", "low")


@query()
def highpass(spark, d):
    """Samples after a zero-phase high-pass at 5 Hz, by each trace's own rate."""
    rows = _rated(spark, d)
    return detection.filtered(rows, "raw", "fs", 5.0, 3, True, "high").select("trace_id", "idx", "high")


@query(
    """with t as (select distinct trace_id from trace_samples where trace_id is not null),
s as (select trace_id, regexp_replace(regexp_replace(trace_id, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') s from t),
k as (select trace_id, case when s = '' then 'trace' else s end s from s)
select trace_id, case when n = 1 then s else s || '_' || n end file_name, name, label from (
  select k.*, row_number() over (partition by s order by trace_id) n, regexp_replace(lower(trace_id), '[^a-z0-9]', '', 'g') name, case when length(trace_id) <= 16 then trace_id else substring(trace_id, 1, 15) || '...' end label from k)"""
)
def trace_file_names(spark, d):
    """Names of traces for files, clashes numbered in order; canonical names and short labels."""
    from pyspark.sql import Window

    names = table(spark, d, "trace_samples").select("trace_id").where("trace_id is not null").distinct()
    rows = names.withColumn("s", scalars.slug(F.col("trace_id"))).withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("trace_id")))
    return rows.select(
        "trace_id",
        F.when(F.col("n") == 1, F.col("s")).otherwise(F.concat_ws("_", "s", F.col("n").cast("string"))).alias("file_name"),
        scalars.canonical_name(F.col("trace_id")).alias("name"),
        scalars.short_label(F.col("trace_id"), 16).alias("label"),
    )


@query()
def short_plateaus(spark, d):
    """Short raised floors of each trace, with windows at its own rate."""
    from traceloom.operators import plateaus

    return plateaus.short_plateaus(_rated(spark, d), "raw")


@query()
def plateau_signal_types(spark, d):
    """What the signal of each long stretch above the median is made of."""
    from traceloom.operators import plateaus

    rows, regions = _high(spark, d)
    smooth = signals.rolling_rank(rows.select("trace_id", "idx", "raw"), "raw", 2, "smooth").withColumn("noise", F.lit(None).cast("double")).join(_rates(spark, d, rows), "trace_id")
    return plateaus.signal_types(plateaus.signal_metrics(cut_lineage(smooth), cut_lineage(masks.at_least(masks.merged(regions, 3), 12)), "raw", "smooth", "noise"))


@query(
    _X
    + "k as (select " + _rec_sql("trace_id") + " recording_id, " + _roi_sql("trace_id")
    + """ roi, row, raw from n), en as (select recording_id, min(c) c from (select recording_id, roi, max(row) + 1 c from k group by 1, 2) group by 1),
u as (select recording_id, row row_no, roi, max(raw) v from k join en using (recording_id) where row < c group by 1, 2, 3)
select recording_id, row_no, list(roi order by roi) rois, list(v order by roi) readings from u group by 1, 2"""
)
def aligned_panel(spark, d):
    """All regions of each recording side by side by row number, up to the end of the shortest."""
    out = signals.aligned_panel(_present(spark, d), "raw")
    return out.select("recording_id", "row_no", F.map_keys("regions").alias("rois"), F.map_values("regions").alias("readings"))


@query(
    """with s as (select trace_name, spike_index, any_value(status) status, any_value(source) source from spikes where trace_name is not null and spike_index is not null group by 1, 2)
select trace_name trace_id, list_sort(list(spike_index) filter (status in ('accepted', 'manual') or source = 'manual')) as templates, count(*) filter (status = 'deleted') deleted from s group by 1"""
)
def template_spikes(spark, d):
    """Positions of the spikes of each trace that a person accepted or set, and the number of deleted ones."""
    once = table(spark, d, "spikes").where("trace_name is not null and spike_index is not null").groupBy("trace_name", "spike_index").agg(F.any_value("status").alias("status"), F.any_value("source").alias("source"))
    chosen = F.when(F.col("status").isin("accepted", "manual") | (F.col("source") == "manual"), F.col("spike_index"))
    out = once.groupBy(F.col("trace_name").alias("trace_id")).agg(F.sort_array(F.collect_list(chosen)).alias("templates"), F.count_if(F.col("status") == "deleted").alias("deleted"))
    return out.withColumn("templates", F.when(F.size("templates") > 0, F.col("templates")))


@query()
def artifact_regions(spark, d):
    """Whole downward dropouts."""
    return detection.artifact_regions(_present(spark, d), "raw")


@query()
def without_artifacts(spark, d):
    """Samples with dropouts replaced along the line in time between their neighbours."""
    rows = _samples(spark, d)
    marked = masks.covered(rows, detection.artifact_regions(rows.where("raw is not null"), "raw"), "artifact")
    return signals.interpolated(marked, "raw", F.col("artifact"), "t", "clean").select("trace_id", "idx", "artifact", "clean")


@query(
    _X
    + "k as (select " + _rec_sql("trace_id") + """ recording_id, (max(t) - min(t)) / 4 q from x where t is not null group by 1), l as (select *, case when q > 0 then pow(10.0, floor(log10(q))) end pw from k)
select recording_id, cast(case when q > 0 then pw * case when q / pw >= 5 then 5 when q / pw >= 2 then 2 else 1 end else 1 end as float) bar from l"""
)
def time_scale(spark, d):
    """A round length of a quarter of each recording's time at most."""
    rows = _samples(spark, d).where("t is not null").groupBy(scalars.recording_of(F.col("trace_id")).alias("recording_id")).agg(((F.max("t") - F.min("t")) / 4).alias("q"))
    return rows.select("recording_id", _f(scalars.nice_floor(F.col("q")), "bar"))


@query(
    _X
    + "k as (select " + _rec_sql("trace_id") + """ recording_id, quantile_cont(raw, 0.005) lo, quantile_cont(raw, 0.995) hi from p group by 1)
select recording_id, cast(lo - 0.15 * (hi - lo) as float) least, cast(hi + 0.15 * (hi - lo) as float) most from k"""
)
def panel_range(spark, d):
    """Range of a recording's panel: percentiles of all its samples with a margin."""
    rows = _present(spark, d).groupBy(scalars.recording_of(F.col("trace_id")).alias("recording_id")).agg(F.percentile("raw", F.lit(0.005)).alias("lo"), F.percentile("raw", F.lit(0.995)).alias("hi"))
    wide = 0.15 * (F.col("hi") - F.col("lo"))
    return rows.select("recording_id", _f(F.col("lo") - wide, "least"), _f(F.col("hi") + wide, "most"))


@query(
    _X
    + """o as (select trace_id, idx, row, len, unnest(range(-2, 3)) k from n),
w as (select o.trace_id, o.idx, sum(v.raw * case abs(k) when 0 then 17.0 when 1 then 12.0 else -3.0 end / 35.0) y from o join n v on v.trace_id = o.trace_id and v.row = least(greatest(o.row + k, 0), o.len - 1) group by 1, 2)
select trace_id, idx, cast(round(y, 6) as float) smooth from w"""
)
def polynomial_smooth(spark, d):
    """Quadratic least squares over five samples, ends repeated."""
    return signals.polynomial_smooth(_present(spark, d), "raw", 2, 2, "smooth").select("trace_id", "idx", _f(F.round("smooth", 6), "smooth"))


@query()
def template_matches(spark, d):
    """Spikes that look like those that a person accepted or set, or where there are none like what stands out most."""
    from traceloom.operators import templates

    chosen = table(spark, d, "spikes").where("trace_name is not null and spike_index is not null and (status in ('accepted', 'manual') or source = 'manual')")
    return templates.template_spikes(_rated(spark, d), "raw", chosen.select(F.col("trace_name").alias("trace_id"), F.col("spike_index").alias("idx")), autopick=True)


@query(
    _X
    + _REC
    + """, l as (select trace_id, t - lag(t) over (partition by trace_id order by idx) dt from x where t is not null), k as (select trace_id, quantile_cont(dt, 0.5) dt from l where dt > 0 group by 1),
e as (select trace_id, arg_max(t, idx) - arg_min(t, idx) span from x where t is not null group by 1)
select trace_id, span > 1000 is_ms, cast(coalesce(period / dt, 1) as float) ms_scale, cast(period as float) period_ms, cast(case when span > 1000 then 5.0 else 0.005 end as float) half_window
from e join rec on recording_id = """
    + _rec_sql("trace_id")
    + " left join k using (trace_id)"
)
def time_axes(spark, d):
    """Whether each trace's times are in ms, the factor to ms, its period, and 5 ms in units of its times."""
    rows = _samples(spark, d)
    out = signals.time_axes(rows, _rates(spark, d, rows))
    return out.select("trace_id", "is_ms", _f("ms_scale"), _f("period_ms"), _f(F.when(F.col("is_ms"), 5.0).otherwise(0.005), "half_window"))


_CUT = """of_ as (select trace_id, min(idx) filter (t >= f) o, max(idx) + 1 n from x join (select trace_id, min(t) + 20 f from x where t is not null group by 1) using (trace_id) group by 1),
os as (select trace_id, coalesce(o, 0) o, n from of_)"""


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    """``(trace_id, offset, n)``: the first sample 20 units of time after a trace's first, or 0, and the trace's length."""
    rows = _samples(spark, d)
    starts = rows.where("t is not null").groupBy("trace_id").agg((F.min("t") + 20).alias("f"))
    return rows.join(starts, "trace_id").groupBy("trace_id").agg(F.coalesce(F.min(F.when(F.col("t") >= F.col("f"), F.col("idx"))), F.lit(0)).alias("offset"), (F.max("idx") + 1).alias("n"))


@query(
    _X
    + _CUT
    + ", "
    + _BURSTS
    + """, mb as (select trace_id, burst_index, s2 - o s, e2 - o e, n - o l from b join os using (trace_id))
select trace_id, burst_index, greatest(s, 0) as start, least(e, l) as "end" from mb where e > 0 and s < l"""
)
def events_after_startup(spark, d):
    """Bursts by position after the startup of each trace is cut off."""
    rows = table(spark, d, "bursts").where("trace_name is not null and start_index is not null and end_index > start_index")
    bursts = rows.groupBy(F.col("trace_name").alias("trace_id"), "burst_index").agg(F.min("start_index").alias("start"), F.min("end_index").alias("end"))
    return signals.moved_regions(bursts, _offsets(spark, d)).select("trace_id", "burst_index", "start", "end")


@query(
    _X
    + _CUT
    + """, sp as (select trace_name trace_id, spike_index, min(candidate_index) c from spikes where trace_name is not null and spike_index is not null group by 1, 2)
select trace_id, spike_index - greatest(o, 0) spike_index, greatest(c - greatest(o, 0), 0) candidate_index from sp join os using (trace_id) where o <= 0 or (spike_index >= o and spike_index < n)"""
)
def spikes_after_startup(spark, d):
    """Spikes by position after the startup of each trace is cut off."""
    once = table(spark, d, "spikes").where("trace_name is not null and spike_index is not null").groupBy(F.col("trace_name").alias("trace_id"), "spike_index").agg(F.min("candidate_index").alias("candidate_index"))
    return signals.moved_spikes(once, _offsets(spark, d)).select("trace_id", "spike_index", "candidate_index")


@query(
    """with r as (select trace_name trace_id, avg(snr) m from (select distinct trace_name, spike_index, snr from spikes where trace_name is not null and isfinite(snr)) group by 1),
v as (select trace_id, m, round(m, 6) q from r)
select trace_id, case when abs(q) >= 1000 then printf('%.0f', q) when abs(q) >= 100 then printf('%.1f', q) else printf('%.2f', q) end mean_snr from v"""
)
def report_values(spark, d):
    """Mean signal-to-noise ratio of each trace's spikes as reports show it."""
    once = table(spark, d, "spikes").where("trace_name is not null").select("trace_name", "spike_index", scalars.finite(F.col("snr")).alias("snr")).where("snr is not null").distinct()
    return once.groupBy(F.col("trace_name").alias("trace_id")).agg(F.avg("snr").alias("m")).select("trace_id", scalars.report_number(F.round("m", 6)).alias("mean_snr"))


@query(
    "with " + _REC + """, w as (select recording_id, greatest(1, cast(round_even(25 / period, 0) as int)) spacing, greatest(5, cast(round_even(100 / period, 0) as int)) n from rec where period is not null)
select recording_id, spacing, n + case when n % 2 = 0 then 1 else 0 end "window" from w"""
)
def window_samples(spark, d):
    """Samples in 25 ms, and an odd window of 100 ms, at each recording's rate."""
    from traceloom.operators.clocks import sampling_rates as rates

    known = rates(table(spark, d, "recordings"))
    return known.select("recording_id", scalars.to_samples(F.lit(25.0), F.col("rate")).alias("spacing"), scalars.odd_at_least(scalars.to_samples(F.lit(100.0), F.col("rate"))).alias("window"))


@query(
    """with t as (select distinct trace_id from trace_samples where trace_id is not null), k as (select trace_id, trim(regexp_replace(trace_id, '[\\[\\]:*?/\\\\]', '_', 'g')) c from t)
select trace_id, substring(case when c = '' then 'trace' else c end, 1, 31) sheet from k"""
)
def sheet_names(spark, d):
    """Names of traces for the sheets of a workbook."""
    return table(spark, d, "trace_samples").select("trace_id").where("trace_id is not null").distinct().select("trace_id", scalars.sheet_name(F.col("trace_id")).alias("sheet"))


@query()
def time_scale_labels(spark, d):
    """The length of each recording's time scale as it is written beside it."""
    bars = time_scale(spark, d).where("bar > 0")
    return bars.select("recording_id", scalars.time_label(F.col("bar").cast("double")).alias("label"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints, which all executors reach."""
    import uuid

    cut_lineage(spark.range(1))  # sees to it that there is a checkpoint folder
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(_SPIKES + "select trace_id, spike_id, peak_index, source, cast(amplitude as float) amplitude from ev")
def package_round_trip(spark, d):
    """Spike events written as an analysis package and read again."""
    from traceloom.sources import packages

    folder = _scratch(spark, "package")
    packages.write_package({"events": _events(spark, d)}, folder, {"made_by": "package_round_trip"})
    _, tables = packages.read_package(spark, folder)
    return tables["events"].select("trace_id", "spike_id", "peak_index", "source", _f("amplitude"))


@query(_X + "z as (select 1) select trace_id, idx, cast(t as float) t, cast(raw as float) raw from x")
def csv_round_trip(spark, d):
    """Samples exported as CSV and read again; missing numbers are blank cells."""
    from traceloom.sources import packages

    folder = _scratch(spark, "csv")
    packages.export_csv(_samples(spark, d), folder, ["trace_id", "idx", "t", "raw"])
    back = spark.read.option("header", "true").schema("trace_id string, idx bigint, t double, raw double, corrected double").csv(folder)
    return back.select("trace_id", "idx", _f("t"), _f("raw"))


@query(
    _X
    + _REC
    + """, no as (select trace_id, greatest(median(abs(raw - m)), 1e-9) z from m group by 1),
sr as (select r.*, greatest(2, cast(round_even(80 / period, 0) as bigint)) n from r join rec on recording_id = """
    + _rec_sql("trace_id")
    + """), sg as (select sr.trace_id, s, e, case when count(*) >= 8 then quantile_cont(raw, 0.95) - quantile_cont(raw, 0.05) else max(raw) - min(raw) end span from sr join p on p.trace_id = sr.trace_id and idx >= s and idx < e where e - s <= n group by 1, 2, 3),
bad as (select sg.trace_id, s, e from sg join no using (trace_id) where span >= 4 * z)
select trace_id, s as start, e as "end" from r where not exists(select 1 from bad where bad.trace_id = r.trace_id and bad.s = r.s and bad.e = r.e)"""
)
def regions_without_impulses(spark, d):
    """Stretches above the median without short ones that are spikes."""
    from traceloom.operators import analysis

    rows, regions = _high(spark, d)
    return analysis.without_impulses(rows, regions, "raw", _rates(spark, d, rows)).select("trace_id", "start", "end")


_CORE = (
    _X
    + _REC
    + ", "
    + _merge_sql("z", "r", 3)
    + ", tn as (select trace_id, max(idx) + 1 n from p group by 1), fr as (select trace_id, n, 1000 / period fs from tn join rec on recording_id = "
    + _rec_sql("trace_id")
    + """ where period is not null), co as (select z.trace_id, s, e, n, fs from z join fr using (trace_id) where e - s >= 12)"""
)


def _long_stretches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Samples, and the long stretches above the median of their trace."""
    rows, regions = _high(spark, d)
    return rows, masks.at_least(masks.merged(regions, 3), 12)


@query(
    _CORE
    + """, k as (select trace_id, n, greatest(1, cast(round_even(2 * fs / 1000, 0) as bigint)) g, greatest(2, cast(round_even(3 * fs / 1000, 0) as bigint)) q, greatest(5, cast(round_even(50 * fs / 1000, 0) as bigint)) f,
  greatest(10, cast(round_even(20 * fs / 1000, 0) as bigint)) wa, greatest(3, cast(round_even(5 * fs / 1000, 0) as bigint)) a from fr),
dv as (select a.trace_id, a.idx, a.raw, coalesce(a.raw - b.raw, 0) d from n a join k on k.trace_id = a.trace_id left join n b on b.trace_id = a.trace_id and b.row = a.row - g),
d1 as (select trace_id, median(d) m, median(raw) b from dv group by 1),
d2 as (select trace_id, 3 * greatest(median(abs(d - m)), 1e-9) st, any_value(b) + 2 * greatest(median(abs(raw - b)), 1e-9) lo from dv join d1 using (trace_id) group by 1),
fl as (select trace_id, idx, abs(d) <= st qt, d > st up, raw <= lo lw, q, g, a from dv join d2 using (trace_id) join k using (trace_id)),
st as (select trace_id, idx, sum(qt::int) over (partition by trace_id order by idx range between current row and q - 1 following) = q qs,
  sum(up::int) over (partition by trace_id order by idx range between current row and g - 1 following) = g us, sum(lw::int) over (partition by trace_id order by idx range between current row and a - 1 following) = a ls from fl),
c1 as (select c.trace_id, s, e, any_value(k.n) n, any_value(g) g, any_value(wa) wa, any_value(f) f, any_value(a) a, coalesce(max(idx + q), s) c from co c join k on k.trace_id = c.trace_id
  left join st on st.trace_id = c.trace_id and qs and idx between s - f and s - q group by 1, 2, 3),
c2 as (select c1.trace_id, s, e, any_value(n) n, any_value(f) f, any_value(a) a, coalesce(min(idx), any_value(case when least(n, c + wa) - 1 + g > n then s else c end)) o from c1
  left join st on st.trace_id = c1.trace_id and us and idx >= c and idx < c + wa group by 1, 2, 3),
c3 as (select c2.trace_id, s0.s, s0.e, any_value(o) o, any_value(n) n, coalesce(min(idx), s0.e) t from c2 join (select trace_id, s, e from c2) s0 using (trace_id, s, e)
  left join st on st.trace_id = c2.trace_id and ls and idx >= c2.e and idx <= least(n, c2.e + f) - a group by 1, 2, 3),
ed as (select trace_id, o s, greatest(o + 1, least(t, n)) e from c3), """
    + _merge_sql("y", "ed", 0)
    + ' select trace_id, s as start, e as "end" from y'
)
def slope_edges(spark, d):
    """Long stretches above the median with edges by the slope of the trace."""
    from traceloom.operators import analysis

    rows, regions = _long_stretches(spark, d)
    return analysis.refined_edges(rows, regions, "raw", _rates(spark, d, rows)).select("trace_id", "start", "end")


@query(
    _CORE
    + """, sd as (select *, least(greatest(3, (e - s) // 2), greatest(3, cast(round_even(60 * fs / 1000, 0) as bigint))) w from co),
cx as (select trace_id, s, e, greatest(0, s - w) lo, least(n, e + w) hi from sd),
lv as (select cx.trace_id, s, e, any_value(lo) lo, any_value(hi) hi, coalesce(median(raw) filter (idx < s or idx >= e), 0) b, median(raw) filter (idx >= s and idx < e) l from cx join p on p.trace_id = cx.trace_id and idx >= lo and idx < hi where hi - lo >= 5 group by 1, 2, 3),
gr as (select *, j * (hi - lo - 1) / 15.0::double x from lv, range(0, 16) t(j) where abs(l - b) > 1e-12),
vl as (select gr.trace_id, s, e, j, case when x = floor(x) then u.raw else u.raw * (1 - x + floor(x)) + v.raw * (x - floor(x)) end r, l, b from gr
  left join p u on u.trace_id = gr.trace_id and u.idx = lo + floor(x)::bigint left join p v on v.trace_id = gr.trace_id and v.idx = lo + floor(x)::bigint + 1)
select trace_id, s as start, e as "end", j as point, cast(round(coalesce((r - b) / (l - b), 0), 6) + 0.0::double as float) as "value" from vl"""
)
def plateau_profiles(spark, d):
    """Shape of each long stretch and its surroundings at 16 points."""
    from traceloom.operators import analysis

    rows, regions = _long_stretches(spark, d)
    out = analysis.profiles(rows, regions, "raw", _rates(spark, d, rows), 16)
    points = out.select("trace_id", "start", "end", F.posexplode("profile").alias("point", "v"))
    return points.select("trace_id", "start", "end", F.col("point").cast("bigint").alias("point"), _f(F.round("v", 6), "value"))


@query()
def plateau_audit(spark, d):
    """Every candidate for a long plateau, and the step at which it was turned down."""
    from traceloom.operators import analysis

    rows = _present(spark, d)
    return analysis.plateau_audit(rows, "raw", _rates(spark, d, rows), half=20, enter=4, leave=4, shortest=6)


@query()
def rejected_plateaus(spark, d):
    """The candidates turned down, by position after the startup of each trace is cut off."""
    from traceloom.operators import analysis

    out = analysis.rejected(plateau_audit(spark, d), _offsets(spark, d))
    return out.select("trace_id", "start", "end", "stage", _f("near_miss"))


@query()
def transform_steps(spark, d):
    """Samples after a high-pass, means of blocks of two, and a low-pass, in this order."""
    from traceloom.operators import analysis

    steps = [("highpass", 1.0, 3), ("downsample", 2), ("lowpass", 40.0, 5)]
    return analysis.transformed(_rated(spark, d), "raw", steps).select("trace_id", "idx", "t", "fs", _f("raw"))


@query(
    _X
    + _rank_sql(5, 2, "reflect")
    + """, j as (select x.trace_id, x.idx, x.raw v, x.corrected c, x.raw - y l from p x join w using (trace_id, idx)),
ch as (select trace_id, abs(median(l) - median(c)) < abs(median(v) - median(c)) and median(abs(l)) < median(abs(v)) ok from j group by 1)
select trace_id, idx, cast(case when ok then l else v end as float) as "value" from j join ch using (trace_id)"""
)
def corrected_units(spark, d):
    """Samples in the units of the corrected trace: above their baseline where that is nearer to it."""
    rows = signals.rolling_rank(_present(spark, d), "raw", 5, "base", 20.0, "reflect")
    return signals.corrected_units(rows, "raw", "corrected", "base", "out").select("trace_id", "idx", _f("out", "value"))


@query(
    """with s as (select trace_id, idx, min(case when isfinite(raw) then raw end) raw, min(case when isfinite(corrected_source) then corrected_source end) c from trace_samples where trace_id is not null and idx is not null group by 1, 2),
ch as (select trace_id, case when count(c) > 0 then 'corrected_source' when count(raw) > 0 then 'raw' end channel from s group by 1)
select trace_id, idx, channel, cast(case when channel = 'raw' then raw else c end as float) as "value" from s join ch using (trace_id)"""
)
def panel_channels(spark, d):
    """Samples of the channel that a panel shows of each trace: what was corrected, or what was recorded where nothing was."""
    number = lambda c: F.min(scalars.finite(F.col(c))).alias(c)
    once = table(spark, d, "trace_samples").where("trace_id is not null and idx is not null").groupBy("trace_id", "idx").agg(number("raw"), number("corrected_source"))
    return signals.panel_channel(once, ["corrected_source", "raw"]).select("trace_id", "idx", "channel", _f("value"))


@query(
    _CORE
    + """, lo as (select trace_id, idx, idx - row_number() over (partition by trace_id order by idx) i from p join (select trace_id, quantile_cont(raw, 0.9) q from p group by 1) using (trace_id) where raw >= q),
tp as (select trace_id, min(idx) s, max(idx) + 1 e from lo group by trace_id, i), un as (select trace_id, s, e from co union all select trace_id, s, e from tp),
gp as (select un.*, greatest(1, cast(round_even(5 * fs / 1000, 0) as bigint)) g from un join fr using (trace_id)),
y_a as (select *, max(e) over (partition by trace_id order by s, e rows between unbounded preceding and 1 preceding) pe from gp), y_b as (select *, sum(case when pe is null or s > pe + g then 1 else 0 end) over (partition by trace_id order by s, e rows unbounded preceding) i from y_a)
select trace_id, min(s) as start, max(e) as "end" from y_b group by trace_id, i"""
)
def merged_plateaus(spark, d):
    """Long stretches above the median and stretches of the highest tenth of each trace together, gaps of up to 5 ms closed."""
    rows, regions = _long_stretches(spark, d)
    tops = rows.groupBy("trace_id").agg(F.percentile("raw", F.lit(0.9)).alias("q"))
    top = masks.regions_of(rows.join(tops, "trace_id"), F.col("raw") >= F.col("q"))
    rates = _rates(spark, d, rows)
    return masks.merged(regions.unionByName(top), rates.select("trace_id", signals.samples_of(5.0).alias("n"))).select("trace_id", "start", "end")
