"""Scalar rules as Column expressions: units, sample counts, names, number formats and scales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands between recording and region in a trace name, and the recording of names without it.
BAR, UNGROUPED = " | ", "Ungrouped"

# Spellings of a background mode.
BACKGROUND_MODES = {"": "none", "none": "none", "off": "none", "false": "none", "parent_tile": "parent_tile", "parent-tile": "parent_tile", "tile": "parent_tile", "local": "parent_tile", "global": "global", "frame": "global"}


def finite(x: Column) -> Column:
    """The value, or null for NaN and infinity: missing values are null throughout."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def to_samples(ms: Column, rate: Column, least: int = 1) -> Column:
    """Milliseconds as a number of samples, halves to even, at least ``least``."""
    return F.greatest(F.lit(least), F.rint(ms / 1000 * rate).cast("int"))


def odd_at_least(n: Column, least: int = 5) -> Column:
    """An odd window of at least ``least``."""
    n = F.greatest(F.lit(least), n.cast("int"))
    return n + F.when(n % 2 == 0, 1).otherwise(0)


def recording_of(trace: Column) -> Column:
    """The recording of a trace name ``recording | roi``; ``Ungrouped`` for other names and where it is empty."""
    said = F.trim(F.split_part(trace, F.lit(BAR), F.lit(1)))
    return F.when(trace.contains(BAR) & (said != ""), said).when(trace.isNotNull(), UNGROUPED)


def roi_of(trace: Column) -> Column:
    """The region of a trace name: what follows the first bar with spaces around it, or the whole name."""
    said = F.trim(F.substring_index(trace, BAR, 1))
    rest = F.trim(F.regexp_replace(trace, r"^.*? \| ", ""))
    return F.when(trace.contains(BAR) & (rest != "") & said.isNotNull(), rest).otherwise(trace)


def canonical_name(name: Column) -> Column:
    """Lower-case letters and digits of a column name."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def slug(name: Column) -> Column:
    """A name for files: other characters become one underscore, dots and underscores at the ends go; never empty."""
    out = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(out == "", "trace").otherwise(out)


def hertz_in(text: Column) -> Column:
    """The first rate in a text, in Hz; null where there is none or it isn't positive."""
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*(k(?:ilo)?hz|k(?:ilo)?hertz|hz|hertz)\b"
    value = F.regexp_extract(text, pattern, 1).try_cast("double") * F.when(F.lower(F.regexp_extract(text, pattern, 2)).startswith("k"), 1000.0).otherwise(1.0)
    return F.when(value > 0, value)


def seconds_per_unit(header: Column) -> Column:
    """Seconds in one unit of a time column by its heading: 0.001, 1 or null where the heading doesn't say."""
    plain = F.replace(F.lower(header), F.lit(" "), F.lit(""))
    ms = plain.contains("(ms)") | plain.endswith("_ms") | (plain == "ms") | plain.contains("millisecond")
    seconds = plain.contains("(s)") | plain.endswith("_s") | plain.isin("s", "sec", "secs", "second", "seconds")
    return F.when(ms, 0.001).when(seconds, 1.0)


def nice_floor(x: Column) -> Column:
    """The greatest of 1, 2 or 5 times a power of ten that isn't above a positive value; 1 otherwise."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    lead = x / power
    return F.when(x > 0, power * F.when(lead >= 5, 5.0).when(lead >= 2, 2.0).otherwise(1.0)).otherwise(1.0)


def report_number(x: Column, digits: int = 2) -> Column:
    """A number as reports show it: no digits from 1000 on, one from 100 on, else ``digits``; empty for missing ones."""
    x = finite(x)
    shown = F.when(F.abs(x) >= 1000, F.format_string("%.0f", x)).when(F.abs(x) >= 100, F.format_string("%.1f", x)).otherwise(F.format_string(f"%.{digits}f", x))
    return F.when(x.isNotNull(), shown).otherwise("")


def shown_number(x: Column) -> Column:
    """A number as scales show it: whole ones without digits, from 1 on one digit at most, else two significant ones."""
    x = finite(x)
    one = F.regexp_replace(F.format_string("%.1f", x), r"\.?0+$", "")
    # two significant digits, in powers of ten below a ten-thousandth
    power = F.floor(F.log10(F.abs(x)))
    lead = F.rint(F.abs(x) / F.pow(F.lit(10.0), power - 1))
    power, lead = F.when(lead >= 100, power + 1).otherwise(power), F.when(lead >= 100, F.lit(10.0)).otherwise(lead)
    plain = F.regexp_replace(F.format_string("%.6f", lead * F.pow(F.lit(10.0), power - 1)), "0+$", "")
    small = F.concat(F.regexp_replace(F.format_string("%.1f", lead / 10), r"\.0$", ""), F.lit("e-"), F.lpad((-power).cast("string"), 2, "0"))
    two = F.concat(F.when(x < 0, "-").otherwise(""), F.when(power >= -4, plain).otherwise(small))
    whole = F.abs(x - F.rint(x)) < 1e-9
    return F.when(x.isNull(), F.lit(None).cast("string")).when(whole, F.rint(x).cast("long").cast("string")).when(F.abs(x) >= 1, one).otherwise(two)


def time_label(seconds: Column) -> Column:
    """A length of time in ms below a second, else in s."""
    return F.when(seconds < 1, F.concat(shown_number(seconds * 1000), F.lit(" ms"))).otherwise(F.concat(shown_number(seconds), F.lit(" s")))


def sheet_name(name: Column) -> Column:
    """A name for a sheet of a workbook: forbidden characters become underscores, 31 characters at most, never empty."""
    clean = F.trim(F.regexp_replace(name, r"[\[\]:*?/\\]", "_"))
    return F.substring(F.when(clean == "", "trace").otherwise(clean), 1, 31)


def short_label(name: Column, most: int = 26) -> Column:
    """A name of more than ``most`` characters as its first ``most`` - 1 and three dots."""
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.substring(name, 1, most - 1), F.lit("...")))


def unit_interval(x: Column) -> Column:
    """A value cut to 0..1; missing values become 0."""
    return F.coalesce(F.least(F.greatest(finite(x), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def background_mode(text: Column) -> Column:
    """The background mode that a spelling stands for; null for none."""
    plain = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return reduce(lambda rest, k: F.when(plain == k, BACKGROUND_MODES[k]).otherwise(rest), BACKGROUND_MODES, F.lit(None).cast("string"))


def parabola_vertex(left: Column, centre: Column, right: Column) -> Column:
    """Offset of a peak between samples, from three values, cut to half a sample."""
    bend = left - 2 * centre + right
    return F.when(F.abs(bend) < 1e-12, 0.0).otherwise(F.least(F.greatest(0.5 * (left - right) / bend, F.lit(-0.5)), F.lit(0.5)))


def signed_shift(at: Column, size: Column) -> Column:
    """A coordinate of a cyclic correlation as a shift to either side."""
    return F.when(at > size / 2, at - size).otherwise(at)
