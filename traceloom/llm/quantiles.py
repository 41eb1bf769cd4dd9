"""Percentiles with a bounded rank error by deterministic buffer collapsing.

A summary holds at most one buffer of ``K`` sorted values for each weight 1, 2, 4, ... and fewer than ``K`` values of
weight 1 besides.  Two full buffers of the same weight are collapsed into one of twice the weight by taking every second
position of the merged values, the odd and the even ones in turn.  A collapse of two buffers of weight w moves a rank by at
most w beyond what the buffers brought along, so a summary carries its own bound, and summaries of separate files or
days combine into one of the same form.  Up to ``K`` values a summary is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.grouped import starts_of, whole_groups

#: Values in a buffer.  The rank error of n values stays below n * log2(n / K) / (2 K).
K = 1024

#: Positions of a group that make up a chunk, which one task sorts and collapses, and summaries of a group that are merged at a time.
CHUNK, FAN_IN = 65_536, 64

#: Chunks over which the rows of a group that have no position are spread.
LOOSE = 4096

#: Rows that a task works through at once, beside the rest of the last group.
BATCH = 65_536

METRICS = ("amplitude_above_baseline", "snr", "fwhm_ms")

#: A summary as columns: number of values, bound of the rank error, weights of the buffers and the buffers.
SUMMARY = "n bigint, rank_error double, weights array<bigint>, buffers array<array<double>>"


def _collapse(a: np.ndarray, b: np.ndarray, odd: bool) -> np.ndarray:
    return np.sort(np.concatenate([a, b]), kind="stable")[int(odd) :: 2]


def merge_summaries(parts: list[tuple[float, list[int], list[np.ndarray]]], k: int = K) -> tuple[int, float, list[int], list[np.ndarray]]:
    """One summary of several ``(rank_error, weights, buffers)``; loose values are any buffers of weight 1 that aren't full."""
    full: dict[int, list[np.ndarray]] = {}
    loose: list[np.ndarray] = []
    error = 0.0
    for bound, weights, buffers in parts:
        error += bound
        for w, values in zip(weights, buffers):
            (full.setdefault(int(w), []) if len(values) == k else loose).append(np.asarray(values))
    rest = np.sort(np.concatenate(loose)) if loose else np.empty(0)
    while len(rest) >= k:
        # a full buffer is spread over the loose values, so that what stays loose is spread too
        take = np.linspace(0, len(rest) - 1, k).round().astype(int)
        full.setdefault(1, []).append(rest[take])
        rest = np.delete(rest, take)
    w = 1
    collapses = 0
    while w <= max(full, default=0):
        same = full.get(w, [])
        while len(same) > 1:
            merged = _collapse(same.pop(0), same.pop(0), collapses % 2 == 1)
            collapses += 1
            error += w
            full.setdefault(2 * w, []).append(merged)
        w *= 2
    weights = [w for w in sorted(full) if full[w]]
    buffers = [full[w][0] for w in weights]
    if len(rest):
        weights, buffers = [1, *weights], [rest, *buffers]
    return sum(w * len(b) for w, b in zip(weights, buffers)), error, weights, buffers


def quantiles_of(weights: list[int], buffers: list[np.ndarray], at: list[float]) -> list[float]:
    """The values at ranks ``ceil(q n)`` (at least 1) of a summary."""
    values = np.concatenate(buffers)
    each = np.repeat(np.array(weights, dtype=np.int64), [len(b) for b in buffers])
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(each[order])
    ranks = np.maximum(np.ceil(np.array(at) * reached[-1]), 1)
    return values[order][np.minimum(np.searchsorted(reached, ranks), len(values) - 1)].tolist()


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _put_together(values: np.ndarray, group: np.ndarray, groups: int, bounds: np.ndarray, buffers: dict[int, tuple[list[int], list[np.ndarray]]] | None, k: int) -> dict[str, pa.Array]:
    """Summaries of ``groups`` groups of loose values, which are sorted here, and of the buffers that some of them bring.

    All groups are sorted at once; a group that fits one buffer is its sorted values, which is what merging gives.  Fuller ones
    go through ``merge_summaries`` one by one: each has ``k`` values at least.
    """
    order = np.lexsort((values, group))
    values, size = values[order], np.bincount(group, minlength=groups)
    ends = np.cumsum(size)
    n, error = size.astype(np.int64), bounds.astype(float)
    weights: list[list[int]] = [[1]] * groups
    split: dict[int, list[np.ndarray]] = {}
    for g in np.flatnonzero((size >= k) | np.isin(np.arange(groups), list(buffers or ()))):
        w, held = (buffers or {}).get(int(g), ([], []))
        parts = [(0.0, [1], [values[ends[g] - size[g] : ends[g]]])] if size[g] else []
        n[g], added, weights[g], split[int(g)] = merge_summaries([*parts, (0.0, w, held)], k)
        error[g] += added
    per_group, per_buffer, flat = np.ones(groups, dtype=np.int64), [], []
    at = 0
    for g in sorted(split):  # stretches of plain groups between the others
        per_buffer.append(size[at:g])
        flat.append(values[ends[at] - size[at] : ends[g] - size[g]] if g > at else values[:0])
        per_buffer.append(np.array([len(b) for b in split[g]], dtype=np.int64))
        flat += split[g]
        per_group[g] = len(split[g])
        at = g + 1
    if at < groups:
        per_buffer.append(size[at:])
        flat.append(values[ends[at] - size[at] :])
    inner = _lists(np.concatenate(flat) if flat else np.zeros(0), np.concatenate(per_buffer) if per_buffer else np.zeros(0, np.int64))
    outer = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_group)].astype(np.int32)), inner)
    return {"n": pa.array(n), "rank_error": pa.array(error), "weights": pa.array(weights, pa.list_(pa.int64())), "buffers": outer}


def _keyed(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def _first_summaries(df: DataFrame, keys: list[str], metrics: list[str], named: str | None, k: int) -> DataFrame:
    """One summary of each group's values, from rows that Spark has brought together and sorted by ``keys``.

    With ``named`` each of the ``metrics`` has its own summary, with its name in that column.
    """
    schema = _keyed(df, keys) + (f", `{named}` string" if named else "") + ", " + SUMMARY

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, BATCH):
            starts = starts_of(table, keys)
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, table.num_rows]))
            heads = table.select(keys).take(pa.array(starts))
            for m in metrics:
                v = table.column(m).to_numpy()
                there = np.isfinite(v)
                met, own = np.unique(group[there], return_inverse=True)
                if not len(met):
                    continue
                out = heads.take(pa.array(met))
                if named:
                    out = out.append_column(named, pa.array([m] * len(met)))
                for name, column in _put_together(v[there], own, len(met), np.zeros(len(met)), None, k).items():
                    out = out.append_column(name, column)
                yield from out.to_batches()

    return df.select(*keys, *metrics).mapInArrow(work, schema)


def _merge(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Merge the summaries of ``df`` that agree on ``keys``: Spark brings them together, a task merges many groups at once."""
    schema = _keyed(df, keys) + ", " + SUMMARY

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, BATCH):
            starts = starts_of(table, keys)
            rows = np.diff(np.r_[starts, table.num_rows])
            group = np.repeat(np.arange(len(starts)), rows)
            lists = table.column("buffers").combine_chunks()
            counts = np.diff(lists.offsets.to_numpy())
            inner = lists.flatten()
            sizes = np.diff(inner.offsets.to_numpy())
            values = inner.flatten().to_numpy()
            of_buffer = np.repeat(group, counts)
            full = sizes == k
            weights = table.column("weights").combine_chunks().flatten().to_numpy()
            ends = np.cumsum(sizes)
            buffers: dict[int, tuple[list[int], list[np.ndarray]]] = {}
            for i in np.flatnonzero(full):
                w, held = buffers.setdefault(int(of_buffer[i]), ([], []))
                w.append(int(weights[i]))
                held.append(values[ends[i] - sizes[i] : ends[i]])
            loose = np.repeat(~full, sizes)
            bounds = np.bincount(group, weights=table.column("rank_error").to_numpy(), minlength=len(starts))
            out = table.select(keys).take(pa.array(starts))
            for name, column in _put_together(values[loose], np.repeat(of_buffer, sizes)[loose], len(starts), bounds, buffers, k).items():
                out = out.append_column(name, column)
            yield from out.to_batches()

    return df.select(*keys, "n", "rank_error", "weights", "buffers").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, schema)


def summarise(values: DataFrame, keys: list[str], metrics: list[str] | None = None, k: int = K) -> DataFrame:
    """Mergeable summaries by ``keys`` from rows ``(*keys, pos, value)``: ``(*keys, n, rank_error, weights, buffers)``.

    With ``metrics`` each of these columns is summarised, the name of which comes out as ``metric``.  Null, NaN and infinite
    values don't count; a group without any other gives no row.  A null key is a key.  ``pos`` only spreads the rows of a group
    over chunks; rows without one are spread by their values.  Each chunk, of ``CHUNK`` positions, is sorted and collapsed to
    buffers in the task that it is brought to; the summaries are then merged ``FAN_IN`` at a time in a tree, which has as many
    levels as the highest position needs, so a hot group is never gathered whole.
    """
    named = "metric" if metrics else None
    columns = metrics or ["value"]
    spread = F.floor(F.col("pos") / CHUNK)
    loose = -1 - F.pmod(F.xxhash64(*columns), F.lit(LOOSE))
    rows = values.select(*keys, F.coalesce(spread, loose).alias("_chunk"), *(F.col(c).cast("double").alias(c) for c in columns))
    by = [*keys, "_chunk"]
    out = _first_summaries(rows.repartition(*by).sortWithinPartitions(*by), by, columns, named, k)
    ends = values.agg(F.max(F.abs("pos")).alias("p"), F.bool_or(F.col("pos").isNull()).alias("l")).first()
    chunks = max((ends["p"] or 0) // CHUNK + 1, LOOSE if ends["l"] else 1)
    return _tree(out, [*keys, named] if named else keys, chunks, k)


def _tree(parts: DataFrame, keys: list[str], chunks: int, k: int) -> DataFrame:
    """Merge the summaries of chunks by their numbers, ``FAN_IN`` neighbours at a time, until one is left for each key."""
    while chunks > 1:
        chunks = -(-chunks // FAN_IN)
        parts = parts.withColumn("_chunk", F.floor(F.col("_chunk") / FAN_IN))
        if chunks > 1:
            parts = _merge(parts, [*keys, "_chunk"], k)
    return _merge(parts, keys, k)


def combine(summaries: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Combine summaries of separate files, days or partitions into those of ``keys``; all must have buffers of ``k`` values."""
    return _merge(summaries, keys, k)


def read_off(summaries: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """Percentiles of summaries as rows ``(*keys, n, rank_error, q, value)``."""

    @F.pandas_udf("array<double>")
    def ask(weights: pd.Series, buffers: pd.Series) -> pd.Series:
        return pd.Series([quantiles_of(list(w), [np.asarray(x) for x in b], at) for w, b in zip(weights, buffers)])

    asked = summaries.select(*keys, "n", "rank_error", F.arrays_zip(F.array(*map(F.lit, at)).alias("q"), ask("weights", "buffers").alias("value")).alias("x"))
    return asked.select(*keys, "n", "rank_error", F.explode("x").alias("x")).select(*keys, "n", "rank_error", F.col("x.q").alias("q"), F.col("x.value").alias("value"))


def spike_rows(spikes: DataFrame) -> DataFrame:
    """``(trace_name, day, pos, *METRICS)``: each spike once; the first day on which a spike was seen counts.

    A spike is known by trace and spike_index; rows without one of them are told apart by their values.
    """
    loose = F.when(F.col("trace_name").isNull() | F.col("spike_index").isNull(), F.xxhash64(*METRICS))
    once = spikes.groupBy("trace_name", "spike_index", loose.alias("loose")).agg(F.min("detected_at").alias("detected_at"), *(F.min(m).cast("double").alias(m) for m in METRICS))
    return once.select("trace_name", F.to_date("detected_at").alias("day"), F.col("spike_index").alias("pos"), *METRICS)


def spike_values(spikes: DataFrame) -> DataFrame:
    """``spike_rows`` in long form: ``(trace_name, day, metric, pos, value)``."""
    metric = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS)))
    return spike_rows(spikes).select("trace_name", "day", "pos", metric.alias("x")).select("trace_name", "day", "pos", "x.*")
