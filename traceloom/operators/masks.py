"""Boolean masks over traces as half-open regions of positions, and the algebra of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.intervals import periods_and_gaps

#: Positions in a piece of a trace.
PIECE = 16_384


def regions_of(df: DataFrame, mask: Column, piece: int = PIECE) -> DataFrame:
    """``(trace_id, start, end)``: the stretches of successive positions where ``mask`` holds; the end is excluded.

    Islands are found within pieces; only those that touch a piece's edge, at most two a piece, are put together per trace.
    Null masks count as false, so does a missing position.
    """
    on = df.where(mask).select("trace_id", F.col("idx").cast("long").alias("idx")).withColumn("piece", F.floor(F.col("idx") / piece))
    island = F.col("idx") - F.row_number().over(Window.partitionBy("trace_id", "piece").orderBy("idx"))
    parts = on.withColumn("g", island).groupBy("trace_id", "piece", "g").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"))
    edge = (F.pmod("start", F.lit(piece)) == 0) | (F.pmod("end", F.lit(piece)) == 0)
    parts = parts.select("trace_id", "start", "end", edge.alias("edge"))
    over = Window.partitionBy("trace_id", "edge").orderBy("start")
    met = F.lag("end").over(over) == F.col("start")
    joined = (
        parts.where("edge")
        .withColumn("new", F.when(met, 0).otherwise(1))
        .withColumn("run", F.sum("new").over(over))
        .groupBy("trace_id", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("run")
    )
    return parts.where("not edge").select("trace_id", "start", "end").unionByName(joined)


def _with_samples(regions: DataFrame, n: int | DataFrame) -> DataFrame:
    """Regions with ``_n``: a number of samples that is given, or that each trace has as ``(trace_id, n)``."""
    if isinstance(n, int):
        return regions.withColumn("_n", F.lit(n))
    return regions.join(n.select("trace_id", F.col("n").alias("_n")), "trace_id")


def merged(regions: DataFrame, gap: int | DataFrame = 0) -> DataFrame:
    """Regions with those at most ``gap`` apart, or overlapping, put together; ``gap`` may be ``(trace_id, n)``."""
    spans = _with_samples(regions.select("trace_id", "start", "end"), gap).select(F.col("trace_id").alias("entity"), F.col("start").alias("s"), (F.col("end") + F.col("_n")).alias("e"))
    met = periods_and_gaps(spans, PIECE).where("kind = 'period'").select(F.col("entity").alias("trace_id"), F.col("start_us").alias("start"), F.col("end_us").alias("end"))
    return _with_samples(met, gap).select("trace_id", "start", (F.col("end") - F.col("_n")).alias("end"))


def dilated(regions: DataFrame, radius: int | DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Regions widened by ``radius`` on both sides and put together where they meet; cut to 0 and, if given, ``n`` of the trace."""
    wide = _with_samples(regions, radius).select("trace_id", F.greatest(F.col("start") - F.col("_n"), F.lit(0)).alias("start"), (F.col("end") + F.col("_n")).alias("end"))
    if lengths is not None:
        wide = wide.join(lengths.select("trace_id", "n"), "trace_id").select("trace_id", "start", F.least("end", "n").alias("end"))
    return merged(wide)


def at_least(regions: DataFrame, length: int | DataFrame) -> DataFrame:
    """Regions of at least ``length`` positions, which may be ``(trace_id, n)``."""
    return _with_samples(regions, length).where(F.col("end") - F.col("start") >= F.col("_n")).drop("_n")


def longest(regions: DataFrame) -> DataFrame:
    """The longest region of each trace, the first of equals."""
    best = F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start")))
    return regions.groupBy("trace_id").agg(best.alias("r")).select("trace_id", "r.*")


# Milliseconds of gaps that are closed before and after blocked spans are widened, and by how much on either side.
CLOSED_MS, WIDER_MS, CLOSED_AGAIN_MS = 180, 45, 90


def artifact_blocks(regions: DataFrame, rates: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Regions as blocked spans: near ones put together, widened, and put together again; ``rates`` has ``(trace_id, fs)``."""
    n = lambda ms: rates.select("trace_id", F.greatest(F.lit(1), F.rint(ms / 1000 * F.col("fs")).cast("long")).alias("n"))
    return merged(dilated(merged(regions, n(CLOSED_MS)), n(WIDER_MS), lengths), n(CLOSED_AGAIN_MS))


def run_starts(regions: DataFrame, length: int) -> DataFrame:
    """``(trace_id, idx)``: the positions from which at least ``length`` positions in a row are covered."""
    return at_least(regions, length).select("trace_id", F.explode(F.sequence(F.col("start"), F.col("end") - length)).alias("idx"))


def covered(df: DataFrame, regions: DataFrame, out: str, piece: int = 1024) -> DataFrame:
    """Add ``out``: whether a position lies in a region.  Both sides meet by trace and bucket of positions."""
    cut = regions.select("trace_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / piece), F.floor((F.col("end") - 1) / piece))).alias("bucket"))
    cut = cut.select(F.col("trace_id").alias("k"), F.col("bucket").alias("b"), "start", "end")
    rows = df.withColumn("bucket", F.floor(F.col("idx") / piece))
    on = (F.col("trace_id") == F.col("k")) & (F.col("bucket") == F.col("b")) & (F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end"))
    inside = rows.join(cut, on, "left_semi").withColumn(out, F.lit(True))
    outside = rows.join(cut, on, "left_anti").withColumn(out, F.lit(False))
    return inside.unionByName(outside).drop("bucket")


def best_overlap(left: DataFrame, right: DataFrame, columns: list[str], piece: int = 1024) -> DataFrame:
    """Each left region with ``overlap`` and the columns of the right region that overlaps it most, the first of equals.

    Left regions without any overlap come out once with overlap 0 and nulls.
    """
    buckets = F.explode(F.sequence(F.floor(F.col("start") / piece), F.floor((F.col("end") - 1) / piece)))
    a = left.select("trace_id", "start", "end", buckets.alias("bucket"))
    b = right.select(F.col("trace_id").alias("k"), F.col("start").alias("s2"), F.col("end").alias("e2"), *columns).withColumn("b", F.explode(F.sequence(F.floor(F.col("s2") / piece), F.floor((F.col("e2") - 1) / piece))))
    shared = F.least("end", "e2") - F.greatest("start", "s2")
    met = a.join(b, (F.col("trace_id") == F.col("k")) & (F.col("bucket") == F.col("b"))).withColumn("overlap", shared).where("overlap > 0")
    best = met.groupBy("trace_id", "start", "end").agg(F.max_by(F.struct("overlap", *columns), F.struct(F.col("overlap"), -F.col("s2"), -F.col("e2"))).alias("x"))
    return left.select("trace_id", "start", "end").join(best, ["trace_id", "start", "end"], "left").select("trace_id", "start", "end", F.coalesce("x.overlap", F.lit(0)).cast("long").alias("overlap"), *(F.col(f"x.{c}").alias(c) for c in columns))


def labelled_by_priority(regions: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each region with the first source in the list of which a region overlaps it, else ``unknown``."""
    out = regions.select("trace_id", "start", "end")
    names = []
    for name, other in sources:
        hit = best_overlap(out.select("trace_id", "start", "end"), other, []).select("trace_id", "start", "end", (F.col("overlap") > 0).alias(f"in_{name}"))
        out = out.join(hit, ["trace_id", "start", "end"])
        names.append(name)
    label = F.coalesce(*(F.when(F.col(f"in_{n}"), n) for n in names), F.lit("unknown"))
    return out.select("trace_id", "start", "end", label.alias("source"))
