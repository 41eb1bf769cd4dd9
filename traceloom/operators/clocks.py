"""The same time recorded on different clocks: every record in one unit, with the unit that it was recorded in.

Each recording has a sampling period.  Given the start offset of its traces, the true time of position k is known but for
the unit of the recorded number, so ``log10(recorded / expected)`` falls on one of a few places, one per unit, apart by
known conversion factors.  A mixture with its components fixed at these places and free weights and widths is fitted to
all records; text about the unit only shifts the prior of a record, and the clock itself decides.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators.ordered import with_numbers
from traceloom.session import cut_lineage

# Milliseconds in one of each unit.  ``sample`` counts sampling periods and so differs by recording.
UNITS_MS = {"ms": 1.0, "s": 1000.0, "us": 0.001, "min": 60000.0, "ns": 0.000001, "h": 3600000.0}

# The components of the mixture.
COMPONENTS = sorted([*UNITS_MS, "sample"])

# How texts name the units.  The order is that of the tests: the first pattern that fits counts.
UNIT_WORDS = (
    ("ns", r"(?i)(^|[^a-z])(ns|nsec|nanosec\w*)([^a-z]|$)"),
    ("us", r"(?i)(^|[^a-zµμ])(us|µs|μs|usec|microsec\w*)([^a-z]|$)"),
    ("ms", r"(?i)(^|[^a-z])(ms|msec|millisec\w*)([^a-z]|$)"),
    ("min", r"(?i)(^|[^a-z])(min|minutes?)([^a-z]|$)"),
    ("h", r"(?i)(^|[^a-z])(hours?|hrs?)([^a-z]|$)"),
    ("s", r"(?i)(^|[^a-z])(s|sec|secs|seconds?|sek|sekunden?)([^a-z]|$)"),
)

#: A start offset is at most so many sampling periods.
MOST_OFFSET = 40

#: A record on which the text and the clock disagree is believed to follow the text with this weight against any other unit.
TEXT_WEIGHT = 20.0

#: Width of the bins of the residual's histogram, and where it ends: what lies further out counts in the last bin.  They
#: bound what the driver sees of a table, whatever its size.
BIN, REACH = 0.01, 12.0

#: Components are this wide at least, in decades.
LEAST_WIDTH = 0.004


def unit_named_in(text: Column) -> Column:
    """The unit that a text names, or null."""
    return reduce(lambda rest, x: F.when(F.regexp_like(text, F.lit(x[1])), x[0]).otherwise(rest), reversed(UNIT_WORDS), F.lit(None).cast("string"))


def _code(unit: Column) -> Column:
    """The place of a unit in the order of the names, null for none; the greatest code is that of the last name."""
    return reduce(lambda rest, i: F.when(unit == COMPONENTS[i], i).otherwise(rest), range(len(COMPONENTS)), F.lit(None).cast("int"))


def _owner() -> Column:
    """What a series is the clock of: its stack, or the recording that its name begins with."""
    return F.when(F.col("table_name") == "signal_frames", F.col("series_key")).otherwise(F.substring_index("series_key", " | ", 1))


def sampling_rates(recordings: DataFrame) -> DataFrame:
    """``(recording_id, source_tiff, rate, header_unit, sidecar_unit)``: one row per recording.

    The rate stands in ``sampling_rate_hz`` or else in the comment, as ``<number> (k)Hz``.  Rows without any are left out.
    """
    number = F.regexp_extract("comment", r"(?i)(\d+(?:\.\d+)?)\s*k?(?:ilo)?(?:hz|hertz)\b", 1).try_cast("double")
    kilo = F.regexp_like("comment", F.lit(r"(?i)\d\s*k(?:ilo)?(?:hz|hertz)\b"))
    said = F.when(kilo, number * 1000).otherwise(number)
    given = F.when((F.col("sampling_rate_hz") > 0) & (F.col("sampling_rate_hz") < float("inf")), F.col("sampling_rate_hz"))
    sidecar = F.concat_ws(" ; ", F.map_values(F.map_filter("raw_fields", lambda k, v: ~k.isin("Width", "Height", "RoiCount"))))
    return (
        recordings.select(
            "recording_id",
            "source_tiff",
            F.coalesce(given, F.when(said > 0, said)).alias("rate"),
            unit_named_in(F.col("time_header")).alias("header_unit"),
            unit_named_in(sidecar).alias("sidecar_unit"),
        )
        .where("rate is not null")
        .groupBy("recording_id")
        .agg(*(F.max(c).alias(c) for c in ("source_tiff", "rate", "header_unit", "sidecar_unit")))
    )


def clock_records(trace_samples: DataFrame, spikes: DataFrame, signal_frames: DataFrame) -> DataFrame:
    """``(table_name, series_key, pos, x, owner, note_unit)`` of the three tables; repeated rows come out as they stand.

    Null and NaN times and rows without a series or position are left out.
    """

    def one(df: DataFrame, name: str, series: str, pos: str, x: str, note: Column) -> DataFrame:
        rows = df.select(F.lit(name).alias("table_name"), F.col(series).alias("series_key"), F.col(pos).cast("long").alias("pos"), F.col(x).cast("double").alias("x"), note.alias("note_unit"))
        return rows.where("x is not null and not isnan(x) and pos is not null and series_key is not null")

    none = F.lit(None).cast("string")
    return (
        one(trace_samples, "trace_samples", "trace_id", "idx", "t", none)
        .unionByName(one(spikes, "spikes", "trace_name", "spike_index", "spike_time", unit_named_in(F.col("notes"))))
        .unionByName(one(signal_frames, "signal_frames", "source_tiff", "frame", "time_ms", none))
        .withColumn("owner", _owner())
    )


def start_offsets(traces: DataFrame) -> DataFrame:
    """``(owner, offset)``: the whole number of periods by which the traces of a recording start late.

    Every record votes, in every unit, for the offsets between 0 and ``MOST_OFFSET`` that would put it on the grid; the
    offset with most votes wins, the smaller of equals.  Votes are summed before they are shuffled, so a hot recording
    sends no more than the possible offsets.
    """
    at = [F.col("x") * f / F.col("period") - F.col("pos") for f in UNITS_MS.values()]
    votes = F.array(*(F.when((F.abs(a - F.rint(a)) < 0.2) & F.rint(a).between(0, MOST_OFFSET), F.rint(a).cast("int")) for a in at))
    return (
        traces.select("owner", F.explode(F.array_distinct(votes)).alias("offset"))
        .where("offset is not null")
        .groupBy("owner", "offset")
        .count()
        .groupBy("owner")
        .agg(F.max_by("offset", F.struct("count", -F.col("offset"))).alias("offset"))
    )


def _fit(bins: np.ndarray, shift: np.ndarray, counts: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Weights and widths of the components by expectation and maximisation over a histogram; the places stay fixed."""
    places = np.column_stack([np.full(len(bins), -math.log10(UNITS_MS[name])) if name in UNITS_MS else -shift for name in COMPONENTS])
    n = places.shape[1]
    weights, widths = np.full(n, 1 / n), np.full(n, 0.05)
    gap2 = (bins[:, None] - places) ** 2
    for _ in range(rounds):
        log = np.log(weights + 1e-12) - np.log(widths) - gap2 / (2 * widths**2)
        log -= log.max(axis=1, keepdims=True)
        share = np.exp(log)
        share *= (counts / share.sum(axis=1))[:, None]
        mass = share.sum(axis=0)
        weights = (mass + 1e-6) / (mass + 1e-6).sum()
        widths = np.clip(np.sqrt(((share * gap2).sum(axis=0) + 1e-6) / (mass + 1e-3)), LEAST_WIDTH, 0.05)
    return weights, widths


def _components(weights: np.ndarray, widths: np.ndarray) -> Column:
    """The fitted components as one structure: the level and the steepness of each unit's likelihood."""
    return F.struct(
        *(F.lit(math.log(w + 1e-12) - math.log(s)).alias(f"level_{name}") for name, w, s in zip(COMPONENTS, weights, widths)),
        *(F.lit(float(1 / (2 * s**2))).alias(f"steep_{name}") for name, s in zip(COMPONENTS, widths)),
    )


def _likelihood(name: str) -> Column:
    """Logarithm of a unit's likelihood for a record; the place of ``sample`` is minus the logarithm of the record's period."""
    gap = F.col("r") + (F.lit(math.log10(UNITS_MS[name])) if name in UNITS_MS else F.col("p"))
    text = F.when(F.col("said") == COMPONENTS.index(name), math.log(TEXT_WEIGHT)).otherwise(0.0)
    return F.col("model")[f"level_{name}"] + text - gap * gap * F.col("model")[f"steep_{name}"]


def in_one_unit(records: DataFrame, rates: DataFrame) -> DataFrame:
    """Every record with its unit: ``table_name, series_key, pos, x, unit, factor, posterior, uncertain, time_us, on_clock``.

    ``unit`` is the likeliest unit of the recorded number (``sample`` for a count of periods), ``factor`` the milliseconds in
    one of it, ``posterior`` its probability.  ``time_us`` is the recorded number in that unit, converted to whole microseconds
    and set on the nearest tick of the recording's clock.  A number that is on no unit's clock (``on_clock`` false) has the
    time that its position says.  ``uncertain`` says that the posterior is below 0.9 or the number on no clock.  Records of
    unknown recordings are left out, as their clock isn't known.  A recorded or expected 0 is 0 in every unit and comes out as
    ms.  Of repeated records the one with the smallest number counts.  Empty tables give no rows.

    The records are read three times, for the offsets, for the histogram that the mixture is fitted to, and for the answer;
    the first two sum up in place, and the few numbers of each recording are brought to the records (``with_numbers``).
    """
    frames = F.col("table_name") == "signal_frames"
    by_rec = rates.select(F.col("recording_id").alias("owner"), "rate", F.col("header_unit").alias("said"))
    by_tiff = rates.where("source_tiff is not null").groupBy(F.col("source_tiff").alias("owner")).agg(F.max("rate").alias("rate"), F.max("sidecar_unit").alias("said"))
    owners = cut_lineage(by_rec.withColumn("stack", F.lit(False)).unionByName(by_tiff.withColumn("stack", F.lit(True))).withColumn("period", 1000 / F.col("rate")))
    kept = records.withColumn("note_unit", _code(F.col("note_unit"))).withColumn("stack", frames)
    offsets = start_offsets(with_numbers(kept.where(~frames), owners, ["owner", "stack"])).withColumn("stack", F.lit(False))
    clocks = cut_lineage(owners.join(offsets, ["owner", "stack"], "left").select("owner", "stack", "period", _code(F.col("said")).alias("said"), F.coalesce("offset", F.lit(0)).alias("offset")))

    def placed(rows: DataFrame) -> DataFrame:
        timed = with_numbers(rows, clocks, ["owner", "stack"]).withColumn("expected", (F.col("pos") + F.col("offset")) * F.col("period"))
        clear = (F.col("x") > 0) & (F.col("expected") > 0) & (F.col("x") < float("inf"))
        return timed.withColumn("said", F.coalesce("note_unit", "said")).withColumn("r", F.when(clear, F.log10(F.col("x") / F.col("expected")))).withColumn("p", F.log10("period"))

    far = F.least(F.greatest("r", F.lit(-REACH)), F.lit(REACH))
    binned = placed(kept).where("r is not null").groupBy("table_name", (F.rint(far / BIN) * BIN).alias("r"), (F.rint(F.col("p") / BIN) * BIN).alias("p")).count().toPandas()
    parts = {t: _fit(g["r"].to_numpy(), g["p"].to_numpy(), g["count"].to_numpy(dtype=float)) for t, g in binned.groupby("table_name")}
    model = reduce(
        lambda rest, t: F.when(F.col("table_name") == t, _components(*parts[t])).otherwise(rest),
        parts,
        _components(np.full(len(COMPONENTS), 1 / len(COMPONENTS)), np.full(len(COMPONENTS), LEAST_WIDTH)),
    )
    # numbers only are summed up, so that repeated records meet in hash tables and nothing is sorted
    once = kept.groupBy("table_name", "series_key", "pos").agg(F.min("x").alias("x"), F.max("note_unit").alias("note_unit"))
    once = once.withColumn("owner", _owner()).withColumn("stack", frames)
    units = [F.struct(_likelihood(name).alias("l"), F.lit(name).alias("unit"), (F.lit(UNITS_MS[name]) if name in UNITS_MS else F.col("period")).alias("factor")) for name in COMPONENTS]
    # plain arithmetic for each unit, as functions over an array of components are interpreted row by row; and out of an
    # array of one, as otherwise each condition on the likeliest unit would be moved in front of it and work it out again
    scored = placed(once).withColumn("model", model).withColumn("top", F.explode(F.array(F.when(F.col("r").isNotNull(), F.array_max(F.array(*units))))))
    scored = scored.withColumn("posterior", 1 / reduce(lambda a, b: a + b, (F.exp(_likelihood(name) - F.col("top")["l"]) for name in COMPONENTS)))
    converted = F.col("x") * F.col("top")["factor"]
    zero = (F.col("x") == 0) & (F.col("expected") == 0)
    on_clock = zero | F.coalesce(F.abs(converted - F.col("expected")) <= F.greatest(0.1 * F.col("period"), 0.002 * F.abs("expected")), F.lit(False))
    ticks = F.rint(converted / F.col("period")) * F.col("period")
    scored = scored.withColumn("on_clock", on_clock)
    return scored.select(
        "table_name",
        "series_key",
        "pos",
        "x",
        F.when(zero, "ms").otherwise(F.coalesce(F.col("top")["unit"], F.lit("unknown"))).alias("unit"),
        F.when(zero, 1.0).otherwise(F.col("top")["factor"]).alias("factor"),
        F.when(zero, 1.0).otherwise(F.coalesce("posterior", F.lit(0.0))).alias("posterior"),
        (~zero & (~F.col("on_clock") | (F.coalesce("posterior", F.lit(0.0)) < 0.9))).alias("uncertain"),
        F.rint(F.when(F.col("on_clock") & ~zero, ticks).otherwise(F.col("expected")) * 1000).cast("long").alias("time_us"),
        "on_clock",
    )


def off_milliseconds(converted: DataFrame) -> DataFrame:
    """The records whose recorded number isn't their time in milliseconds: those of another unit, or on no clock."""
    other = F.abs(F.coalesce("factor", F.lit(0.0)) - 1) > 1e-9
    return converted.where(other | ~F.col("on_clock")).select("table_name", "series_key", "pos", "time_us")
