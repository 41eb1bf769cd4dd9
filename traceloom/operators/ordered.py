"""Look-behind over ordered rows whose key may be hot.

A plain ``lag`` over a key puts every row of that key into one task.  Here the key is split into buckets of its order
column; rows look behind inside their bucket, and only one row per bucket travels to close the seams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets whose rows travel together when something is carried along a key; above them one row for so many buckets does.
FAN = 1024

#: A side of at most so many rows of one key and a few numbers each (tens of MB) may be broadcast.
SMALL = 200_000

#: Parts into which the rows of a hot key are spread where its side of a join is too large to be broadcast.
SALT = 32


def null_safe(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    """The condition that columns of ``left`` equal those of ``right``, nulls being equal."""
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in names.items()))


def with_numbers(df: DataFrame, numbers: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``numbers``, at most one row per key, to rows of which one key may hold any share.

    Up to ``SMALL`` rows, which are counted, ``numbers`` is broadcast and the rows stay where they are; beyond that the rows
    of a key are spread over ``SALT`` parts, to each of which its numbers go.
    """
    if numbers.count() <= SMALL:
        return df.join(F.broadcast(numbers), keys, how)
    spread = numbers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return df.withColumn("_salt", F.floor(F.rand(7) * SALT).cast("int")).join(spread, [*keys, "_salt"], how).drop("_salt")


def carried(edges: DataFrame, keys: list[str], bucket: str, value: str, out: str, how: str = "nearest", later: bool = False, fan: int = FAN) -> DataFrame:
    """Add ``out``: the ``value`` of all earlier buckets of a key (``later``: of all later ones) put together.

    ``how`` is ``max``, ``sum`` or ``nearest``, the nearest one that isn't null.  ``edges`` has one row per key and bucket;
    null keys are a key.  No window holds more than ``fan`` buckets of a key, but for one that has a row for each ``fan`` buckets.
    """
    combine = {"max": lambda c, _: F.max(c), "sum": lambda c, _: F.sum(c), "nearest": lambda c, _: F.last(c, True)}[how]
    order = (lambda c: F.desc(c)) if later else (lambda c: F.asc(c))
    before = (Window.unboundedPreceding, -1)
    rows = edges.withColumn("_carried_group", F.floor(F.col(bucket) / fan))
    near = combine(F.col(value), None).over(Window.partitionBy(*keys, "_carried_group").orderBy(order(bucket)).rowsBetween(*before))
    pick = F.min_by if later else F.max_by
    whole = pick(value, F.when(F.col(value).isNotNull(), F.col(bucket))) if how == "nearest" else combine(F.col(value), None)
    tops = rows.groupBy(*keys, "_carried_group").agg(whole.alias("_carried_whole"))
    far = combine(F.col("_carried_whole"), None).over(Window.partitionBy(*keys).orderBy(order("_carried_group")).rowsBetween(*before))
    tops = tops.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_carried_group").alias("_carried_top"), far.alias("_carried_far"))
    rows = rows.withColumn("_carried_near", near)
    met = rows.join(tops, null_safe(rows, tops, {k: f"_k{i}" for i, k in enumerate(keys)} | {"_carried_group": "_carried_top"}), "left")
    put = {"max": F.greatest("_carried_near", "_carried_far"), "sum": F.coalesce("_carried_near", F.lit(0)) + F.coalesce("_carried_far", F.lit(0)), "nearest": F.coalesce("_carried_near", "_carried_far")}[how]
    return met.withColumn(out, put).select(*edges.columns, out)


def bucketed_lag(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the row before, by ``order`` within ``keys``; null at the first row of a key.

    ``bucket`` must not decrease along ``order``.  Null keys form a key of their own.  Ties of ``order`` are broken
    arbitrarily, so callers append a unique column.  Rows per task: those of one bucket; the seams need one row a bucket.
    """
    if any(name in df.columns for name in ("_bucket", "_first", "_seam", out)):
        raise ValueError(f"columns _bucket, _first, _seam and {out} are made here")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = (
        df.withColumn("_bucket", bucket)
        .withColumn(out, F.lag(value).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
    )
    lasts = df.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    names = {name: f"_s{i}" for i, name in enumerate((*keys, "_bucket"))}
    seams = carried(lasts, keys, "_bucket", "_last", "_seam").select(*(F.col(a).alias(b) for a, b in names.items()), "_seam")
    joined = rows.join(seams, null_safe(rows, seams, names), "left").drop(*names.values())
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_seam.v")).otherwise(F.col(out))).drop("_bucket", "_first", "_seam")


def latest(rows: DataFrame, events: DataFrame, keys: list[str], at: str, bucket: str, value: str, out: str, equal: bool = True) -> DataFrame:
    """Add ``out`` to ``rows``: ``value`` of the last event of the same keys before a row, or at the same place if ``equal``.

    Both have the columns ``keys``, ``at`` and ``bucket``, which must not decrease along ``at``; null keys are a key.  Rows and
    events meet within buckets; what a bucket's end leaves is carried on, one row per bucket.
    """
    none = F.lit(None)
    kind = events.select(F.struct(F.col(value).alias("v")).alias("s")).schema["s"].dataType
    told = events.select(*keys, at, bucket, F.struct(F.col(value).alias("v")).alias("_v"), F.lit(0 if equal else 1).alias("_turn"), none.alias("_row"))
    both = rows.select(*keys, at, bucket, none.cast(kind).alias("_v"), F.lit(1 if equal else 0).alias("_turn"), F.struct(*rows.columns).alias("_row"))
    both = both.unionByName(told.withColumn("_row", none.cast(both.schema["_row"].dataType)))
    inside = Window.partitionBy(*keys, bucket).orderBy(at, "_turn").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_carried_near", F.last("_v", True).over(inside)).where("_row is not null")
    lasts = both.groupBy(*keys, bucket).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(at))).alias("_last"))
    names = {name: f"_s{i}" for i, name in enumerate((*keys, bucket))}
    seams = carried(lasts, keys, bucket, "_last", "_seam").select(*(F.col(a).alias(b) for a, b in names.items()), "_seam")
    met = near.join(seams, null_safe(near, seams, names), "left")
    return met.select("_row.*", F.coalesce("_carried_near", "_seam")["v"].alias(out))
