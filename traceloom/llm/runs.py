"""Runs of identical or nearly identical consecutive events, collapsed into one event each with its count and extent."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sequence is worked through in stretches of so many positions, so that a hot sequence is many tasks.
STRETCH = 8192

# The states that a track can be in.
STATES = ("accepted", "rescued", "held", "invalid")

#: A written state stands for the nearest of the known ones if it is at most so many letters away; so may labels differ.
SLIPS = 2

_NUMBERS = re.compile("[0-9]+")


def clean_state(text: Column) -> Column:
    """The known state that ``text`` writes, whatever its case, punctuation, lead-in or slips; null if none is near."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s*(track[ _]?)?state\s*[:=]", ""), "[^a-z]", "")
    near = F.array_min(F.array(*(F.struct(F.levenshtein(letters, F.lit(s)).alias("d"), F.lit(s).alias("s")) for s in STATES)))
    return F.when(near["d"] <= SLIPS, near["s"])


def clean_label(text: Column) -> Column:
    """A label as its lower-case letters and its numbers without leading zeros; a label with another number differs."""
    plain = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]", "")
    return F.regexp_replace(plain, r"(?<![0-9])0+(?=[0-9])", "")


@lru_cache(maxsize=65_536)
def alike(a: str, b: str) -> bool:
    """Whether two kinds are the same but for slips: the same before the last bar, if there is one, and behind it the same
    numbers, and letters at most ``SLIPS`` apart, one slip for each three letters at most.  Nulls (written ``\0``) are like
    nothing else."""
    if a == b:
        return True
    (one, _, a), (two, _, b) = a.rpartition("|"), b.rpartition("|")
    if "\0" in (a, b) or one != two or _NUMBERS.findall(a) != _NUMBERS.findall(b):
        return False
    a, b = _NUMBERS.sub("", a), _NUMBERS.sub("", b)
    most = min(SLIPS, min(len(a), len(b)) // 3)
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1] <= most


def _alike(a: Column, b: Column) -> Column:
    """``alike`` of two columns."""
    head, tail = (lambda c: F.regexp_extract(c, r"^(.*\|)?", 0)), (lambda c: F.regexp_extract(c, r"([^|]*)$", 1))
    numbers, letters = (lambda c: F.regexp_extract_all(tail(c), F.lit("([0-9]+)"))), (lambda c: F.regexp_replace(tail(c), "[0-9]+", ""))
    most = F.least(F.lit(SLIPS), F.floor(F.least(F.length(letters(a)), F.length(letters(b))) / 3))
    slips = (a != "\0") & (b != "\0") & (head(a) == head(b)) & (numbers(a) == numbers(b)) & (F.levenshtein(letters(a), letters(b)) <= most)
    return (a == b) | slips


def _machine(batches: Iterator[pd.DataFrame], max_gap: int) -> Iterator[pd.DataFrame]:
    """Compare each event of sorted batches with the anchor of the open run and emit the runs that are finished.

    Only the open run is carried from batch to batch.  An event joins the run if it is of the same sequence and stretch, is
    ``alike`` the run's anchor, its first event, and follows at most ``max_gap`` after the last.  Stretches of exactly equal
    events are found at once; the anchor is asked only where the writing changes.
    """
    columns = ["entity", "stretch", "kind", "first_pos", "last_pos", "n"]
    open_run: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        batch = batch.rename(columns={"pos": "first_pos"})
        batch["last_pos"] = batch["first_pos"]
        batch["n"] = 1
        rows = batch[columns] if open_run is None else pd.concat([open_run, batch[columns]], ignore_index=True)
        step = rows["first_pos"].to_numpy()[1:] - rows["last_pos"].to_numpy()[:-1]
        near = step <= max_gap
        for name in ("entity", "stretch"):
            v = rows[name].to_numpy()
            near &= v[1:] == v[:-1]
        kind = rows["kind"].to_numpy()
        starts = np.r_[True, ~(near & (kind[1:] == kind[:-1]))]
        anchor = kind[0]
        for i in np.flatnonzero(starts)[1:]:
            if near[i - 1] and alike(anchor, kind[i]):
                starts[i] = False
            else:
                anchor = kind[i]
        # a repeated row has step 0: it belongs to the run and adds nothing
        repeat = ~starts[1:] & (step == 0)
        n = rows["n"].to_numpy().copy()
        n[1:][repeat] -= 1
        grouped = rows.assign(run=np.cumsum(starts), n=n).groupby("run", sort=False)
        done = grouped.agg({"entity": "first", "stretch": "first", "kind": "first", "first_pos": "min", "last_pos": "max", "n": "sum"})[columns]
        yield done.iloc[:-1]
        open_run = done.iloc[-1:].reset_index(drop=True)
    if open_run is not None:
        yield open_run


def collapse_runs(events: DataFrame, max_gap: int = 1, stretch: int = STRETCH) -> DataFrame:
    """Runs of ``(entity, pos, kind)``: ``entity, kind, first_pos, last_pos, n``, in whole sequences of any length.

    A run is a longest series of events of one entity at positions at most ``max_gap`` apart of which each is ``alike`` the
    first; that one's kind is the run's.  Events
    of a null kind belong to no run and, standing in its place, end one; repeated rows count once; a null entity or
    position is left out; an empty table gives no runs.  Two kinds at the same position don't join and end each other.

    Spark sorts each stretch of a sequence; a state machine passes over it and emits finished runs.  Runs cut at the edge
    of a stretch are put together from one row per run: a window over the runs that touch an edge only, each of which is
    compared with the one before.
    """
    rows = (
        events.where("entity is not null and pos is not null")
        .select("entity", F.col("pos").cast("long").alias("pos"), F.coalesce("kind", F.lit("\0")).alias("kind"))
        .withColumn("stretch", F.floor(F.col("pos") / stretch))
    )
    schema = "entity string, stretch bigint, kind string, first_pos bigint, last_pos bigint, n bigint"
    parts = (
        rows.repartition("entity", "stretch")
        .sortWithinPartitions("entity", "stretch", "pos", "kind")
        .mapInPandas(lambda batches: _machine(batches, max_gap), schema)
    )
    # a part can go on only if it reaches within max_gap of its stretch's edge
    at_start = F.col("first_pos") - F.col("stretch") * stretch < max_gap
    at_end = (F.col("stretch") + 1) * stretch - F.col("last_pos") <= max_gap
    edge = parts.withColumn("edge", at_start | at_end)
    along = Window.partitionBy("entity", "edge").orderBy("first_pos", "kind")
    before = (F.lag("stretch").over(along) < F.col("stretch")) & (F.col("first_pos") - F.lag("last_pos").over(along) <= max_gap) & F.col("edge")
    joined = (
        edge.where("edge")
        .withColumn("near", before)
        .withColumn("past", F.lag("kind").over(along))
        .withColumn("new", F.when(F.coalesce(F.col("near") & _alike(F.col("past"), F.col("kind")), F.lit(False)), 0).otherwise(1))
        .withColumn("run", F.sum("new").over(along))
        .groupBy("entity", "run")
        .agg(F.min_by("kind", "first_pos").alias("kind"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.sum("n").alias("n"))
        .drop("run")
    )
    columns = ["entity", "kind", "first_pos", "last_pos", "n"]
    return edge.where("not edge").select(columns).unionByName(joined.select(columns)).where(F.col("kind") != "\0")


def track_events(frame_tracks: DataFrame) -> DataFrame:
    """The rows of ``frame_tracks`` as events: entity is stack and mask, kind is clean state and label."""
    kind = F.concat_ws("|", clean_state(F.col("track_state")), F.coalesce(clean_label(F.col("label")), F.lit("")))
    return frame_tracks.select(
        F.concat(F.col("mask_index").cast("string"), F.lit("#"), F.col("source_tiff")).alias("entity"),
        F.col("frame").alias("pos"),
        F.when(clean_state(F.col("track_state")).isNotNull(), kind).alias("kind"),
    )


def track_runs(frame_tracks: DataFrame) -> DataFrame:
    """``source_tiff, mask_index, track_state, label, first_frame, last_frame, frames, n_rows`` of every run of a mask."""
    runs = collapse_runs(track_events(frame_tracks))
    mask = F.split_part("entity", F.lit("#"), F.lit(1))
    return runs.select(
        F.expr("substring(entity, length(split_part(entity, '#', 1)) + 2)").alias("source_tiff"),
        mask.cast("bigint").alias("mask_index"),
        F.split_part("kind", F.lit("|"), F.lit(1)).alias("track_state"),
        F.expr("substring(kind, length(split_part(kind, '|', 1)) + 2)").alias("label"),
        F.col("first_pos").alias("first_frame"),
        F.col("last_pos").alias("last_frame"),
        (F.col("last_pos") - F.col("first_pos") + 1).alias("frames"),
        F.col("n").alias("n_rows"),
    )
