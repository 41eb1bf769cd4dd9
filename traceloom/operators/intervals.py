"""Overlapping, nested and gapped time intervals per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.ordered import carried
from traceloom.session import cut_lineage

#: Intervals are first merged inside buckets of this many microseconds of their start, so that a hot entity is many groups.
BUCKET_US = 10_000_000

#: Starts and ends outside of this range (in microseconds, about 63,000 years) can't be held by a session and are left out.
LIMIT_US = 2_000_000_000_000_000_000


def _whole_us(ms: Column) -> Column:
    ms = ms.cast("double")
    return F.when(F.abs(ms) < LIMIT_US / 1000, F.rint(ms * 1000).cast("long"))


def spans_from_ms(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """``(entity, s, e)`` in whole microseconds of the rows whose times are present, finite and in order."""
    out = df.select(F.col(entity).alias("entity"), _whole_us(F.col(start)).alias("s"), _whole_us(F.col(end)).alias("e"))
    return out.where(F.col(start).cast("double") < F.col(end).cast("double")).where("s is not null and e is not null and e > s")


def periods_and_gaps(spans: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Merge intervals ``(entity, s, e)`` into ``(entity, kind, start_us, end_us)`` with kind ``period`` or ``gap``.

    Spark's ``session_window`` with a duration that each row brings along merges what overlaps within a bucket of start
    times; the sessions that remain are carried on across buckets by the latest end so far, which also joins periods that
    just touch.  A period starts where a session starts after every earlier end; the ``lead`` of those starts gives its
    end and the gap after it.  Only one row per bucket crosses buckets, and those in two levels (``carried``), so no task holds
    a whole hot entity however sparse its intervals are.

    Repeated and nested intervals add nothing; an empty table gives no rows; a null entity is an entity of its own;
    intervals of no or negative length are no intervals.
    """
    spans = spans.select("entity", "s", "e").where("e > s").withColumn("bucket", F.floor(F.col("s") / bucket_us))
    length = F.expr("make_interval(0, 0, 0, 0, cast((e - s) div 3600000000 as int), 0, cast((e - s) % 3600000000 as decimal(18, 6)) / 1000000)")
    local = (
        spans.groupBy("entity", "bucket", F.session_window(F.timestamp_micros("s"), length))
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("session_window")
    )
    local = cut_lineage(local)  # read four times below
    edges = carried(local.groupBy("entity", "bucket").agg(F.max("e").alias("latest")), ["entity"], "bucket", "latest", "carried", "max")
    edges = edges.select(F.col("entity").alias("k"), F.col("bucket").alias("b"), "carried")
    joined = local.join(edges, F.col("entity").eqNullSafe(F.col("k")) & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("entity", "bucket").orderBy("s", "e")
    before = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    starts = joined.withColumn("before", F.greatest("carried", before)).where("before is null or s > before").select("entity", "bucket", "s", "before")
    # the next start of an entity, and the end of what lies before it, come from the same bucket or the next one with a start
    first = starts.groupBy("entity", "bucket").agg(F.min_by(F.struct("before", "s"), "s").alias("first"))
    seams = carried(first, ["entity"], "bucket", "first", "next", later=True).select(F.col("entity").alias("k"), F.col("bucket").alias("b"), "next")
    final = local.groupBy("entity").agg(F.max("e").alias("final")).withColumnRenamed("entity", "k2")
    led = starts.withColumn("lead", F.lead(F.struct("before", "s")).over(Window.partitionBy("entity", "bucket").orderBy("s")))
    led = led.join(seams, F.col("entity").eqNullSafe(F.col("k")) & (F.col("bucket") == F.col("b"))).withColumn("lead", F.coalesce("lead", "next"))
    # only the last period of an entity needs the latest end of all
    last = led.where("lead is null").join(final, F.col("entity").eqNullSafe(F.col("k2"))).select("entity", "s", F.col("final").alias("e"), F.lit(None).cast("long").alias("after"))
    ends = led.where("lead is not null").select("entity", "s", F.col("lead.before").alias("e"), F.col("lead.s").alias("after")).unionByName(last)
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_us"), F.col("e").alias("end_us")),
        F.struct(F.lit("gap").alias("kind"), F.col("e").alias("start_us"), F.col("after").alias("end_us")),
    )
    return ends.select("entity", F.explode(kinds).alias("x")).select("entity", "x.*").where("end_us is not null")
