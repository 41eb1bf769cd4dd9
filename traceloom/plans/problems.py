"""Registered queries of the general data-processing problems, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators import clocks, drift, implausible, intervals
from traceloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Active periods of each trace and the gaps between them."""
    spans = intervals.spans_from_ms(table(spark, folder, "bursts"), "trace_name", "start_time", "end_time")
    return intervals.periods_and_gaps(spans).withColumnRenamed("entity", "trace_name")


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per trace: number of periods, active and idle time in microseconds."""
    found = p1_found(spark, folder)
    period = F.col("kind") == "period"
    length = F.col("end_us") - F.col("start_us")
    return found.groupBy("trace_name").agg(
        F.count_if(period).alias("periods"), F.coalesce(F.sum(F.when(period, length)), F.lit(0)).alias("active_us"), F.coalesce(F.sum(F.when(~period, length)), F.lit(0)).alias("idle_us")
    )


def _converted(spark: SparkSession, folder: str) -> DataFrame:
    records = clocks.clock_records(*(table(spark, folder, t) for t in ("trace_samples", "spikes", "signal_frames")))
    return clocks.in_one_unit(records, clocks.sampling_rates(table(spark, folder, "recordings")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose number isn't their time in milliseconds, with their true time."""
    return clocks.off_milliseconds(_converted(spark, folder))


def p2_times(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's time in microseconds with the unit it was recorded in and whether that is uncertain."""
    return _converted(spark, folder).select("table_name", "series_key", "pos", "unit", F.round("posterior", 3).alias("posterior"), "uncertain", "time_us")


def _streams(spark: SparkSession, folder: str) -> DataFrame:
    return drift.json_streams(table(spark, folder, "sessions"), table(spark, folder, "analysis_packages"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of a field between successive files of a station."""
    return drift.changes(_streams(spark, folder)).where("change <> 'followed'").select("file_id", "stream", "change", "field", "new_field")


def p3_table(spark: SparkSession, folder: str) -> DataFrame:
    """All files in one table under the first name of each field."""
    streams = _streams(spark, folder)
    return drift.one_table(drift.parse(streams), drift.changes(streams))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return implausible.score_readings(implausible.readings(*(table(spark, folder, t) for t in ("trace_samples", "signal_frames", "frame_tracks"))))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that the recorder can't have measured."""
    return implausible.implausible(_scored(spark, folder))


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every finite reading with its isolation score and flags."""
    return _scored(spark, folder)


QUERIES = {f.__name__: f for f in (p1_found, p1_coverage, p2_found, p2_times, p3_found, p3_table, p6_found, p6_scores)}

_PERIODS = """
with b as (
  select distinct trace_name, cast(round_even(start_time * 1000, 0) as bigint) s, cast(round_even(end_time * 1000, 0) as bigint) e
  from bursts where isfinite(start_time) and isfinite(end_time) and end_time > start_time),
m as (select *, max(e) over (partition by trace_name order by s, e rows between unbounded preceding and 1 preceding) pe from b where e > s),
g as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by trace_name order by s, e rows unbounded preceding) i from m),
p as (select trace_name, i, min(s) s, max(e) e from g group by all),
r as (select trace_name, 'period' kind, s start_us, e end_us from p
  union all select * from (select trace_name, 'gap', e, lead(s) over (partition by trace_name order by s) n from p) where n is not null)
"""

_CLOCK = r"""
with rec as (
  select recording_id, max(source_tiff) source_tiff, max(1000 / coalesce(case when sampling_rate_hz > 0 and isfinite(sampling_rate_hz) then sampling_rate_hz end,
    try_cast(regexp_extract(comment, '(?i)(\d+(?:\.\d+)?)\s*k?hz', 1) as double) * case when regexp_matches(comment, '(?i)\d\s*khz') then 1000 else 1 end)) period
  from recordings group by 1),
x as (
  select 'trace_samples' table_name, trace_id series_key, idx pos, min(t) x from trace_samples where t is not null and not isnan(t) and idx is not null group by all
  union all select 'spikes', trace_name, spike_index, min(spike_time) from spikes where spike_time is not null and not isnan(spike_time) and spike_index is not null group by all),
y as (select x.*, recording_id, period from x join rec on split_part(series_key, ' | ', 1) = recording_id where period is not null),
u as (select unnest(['ms', 's', 'us', 'min', 'ns', 'h']) unit, unnest([1.0, 1000.0, 0.001, 60000.0, 0.000001, 3600000.0]) f),
v as (select distinct recording_id, table_name, series_key, pos, round(x * f / period - pos) o from y, u where abs(x * f / period - pos - round(x * f / period - pos)) < 0.2 and round(x * f / period - pos) between 0 and 40),
c as (select recording_id, o, count(*) c from v group by 1, 2),
w as (select recording_id, o, row_number() over (partition by recording_id order by c desc, o) n from c),
z as (
  select table_name, series_key, pos, x, period, (pos + coalesce(o, 0)) * period expected from y left join (select * from w where n = 1) using (recording_id)
  union all select 'signal_frames', s.source_tiff, frame, min(time_ms), period, frame * period from signal_frames s join (select source_tiff, max(period) period from rec group by 1) r on s.source_tiff = r.source_tiff
    where time_ms is not null and not isnan(time_ms) and frame is not null and period is not null group by all)
"""

_CHANGES = """
with f as (
  select file_id, 'detection_params' stream, min(station) station, min(saved_at) saved_at, max(detection_params) text from sessions where file_id is not null and detection_params is not null group by 1
  union all select file_id, 'pipeline_config', min(station), min(saved_at), max(pipeline_config) from sessions where file_id is not null and pipeline_config is not null group by 1
  union all select file_id, 'manifest', min(station), min(saved_at), max(manifest) from analysis_packages where file_id is not null and manifest is not null group by 1),
o as materialized (select *, row_number() over (partition by stream, station order by saved_at nulls first, file_id) n from f where case when json_valid(text) then json_type(text) = 'OBJECT' else false end),
v as materialized (
  select o.stream, o.station, o.n, o.file_id, substring(t.fullkey, 3) field,
    case when t.type = 'BOOLEAN' then 'boolean' when t.type in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'number' when t.type = 'VARCHAR' then 'string' when t.type = 'ARRAY' then 'array' else 'null' end kind,
    case when t.type in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(cast(t.value as double) as varchar) else cast(t.value as varchar) end val
  from o, json_tree(o.text) t where t.type <> 'OBJECT' and t.fullkey not like '%[%'),
p as (select n.stream, n.station, n.n, n.file_id from o n join o b on b.stream = n.stream and b.station is not distinct from n.station and b.n = n.n - 1),
old as (select p.*, v.field, v.kind, v.val from p join v on v.stream = p.stream and v.station is not distinct from p.station and v.n = p.n - 1),
new as (select p.*, v.field, v.kind, v.val from p join v on v.stream = p.stream and v.station is not distinct from p.station and v.n = p.n),
gone as (select old.*, count(*) over (partition by file_id, stream, kind, val) c from old where not exists(select 1 from new where new.file_id = old.file_id and new.stream = old.stream and new.field = old.field)),
come as (select new.*, count(*) over (partition by file_id, stream, kind, val) c from new where not exists(select 1 from old where new.file_id = old.file_id and new.stream = old.stream and new.field = old.field)),
ren as (select g.file_id, g.stream, g.field, k.field new_field from gone g join come k on g.file_id = k.file_id and g.stream = k.stream and g.kind = k.kind and g.val = k.val where g.c = 1 and k.c = 1)
select file_id, stream, 'type_changed' change, field, '' new_field from new join old using (file_id, stream, field) where new.kind <> old.kind
union all select file_id, stream, 'renamed', field, new_field from ren
union all select file_id, stream, 'removed', field, '' from gone where not exists(select 1 from ren where ren.file_id = gone.file_id and ren.stream = gone.stream and ren.field = gone.field)
union all select file_id, stream, 'added', field, '' from come where not exists(select 1 from ren where ren.file_id = come.file_id and ren.stream = come.stream and ren.new_field = come.field)
"""

SQL = {
    "p3_found": _CHANGES,
    "p1_found": _PERIODS + "select * from r",
    "p1_coverage": _PERIODS
    + "select trace_name, count(*) filter (kind = 'period') periods, cast(coalesce(sum(end_us - start_us) filter (kind = 'period'), 0) as bigint) active_us, "
    "cast(coalesce(sum(end_us - start_us) filter (kind = 'gap'), 0) as bigint) idle_us from r group by 1",
    "p2_found": _CLOCK + "select table_name, series_key, pos, cast(round(expected * 1000) as bigint) time_us from z where abs(x - expected) > 0.05 * period",
}
