"""Array functions over sorted groups, many groups to a task: no call from Spark into Python per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a table that is sorted by ``keys``; nulls are a key of their own."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in keys:
        column = table.column(name).combine_chunks()
        here, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        differs = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(here.is_null(), before.is_null()))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(source: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Sorted batches put together to about ``rows`` rows that end with a whole group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in source:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        starts = starts_of(table, keys)
        cut = int(starts[-1]) if len(starts) > 1 else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        count = table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], order: str, run: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, dict[str, np.ndarray]]], passed: list[str], added: dict[str, str], rows: int = 65_536, used: list[str] | None = None) -> DataFrame:
    """``run`` over the rows of each group in order of ``order``.

    Spark brings groups together by ``keys`` and sorts them.  ``run`` gets the other columns, or those that are ``used``, as
    arrays, nulls as NaN, and gives the rows to keep and the values of the added columns for these; the ``passed`` columns
    come along.
    """
    types = dict(df.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in passed] + [f"{c} {t}" for c, t in added.items()])
    given = used or [c for c in df.columns if c not in keys]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, rows):
            arrays = {c: table.column(c).to_numpy() for c in given}
            starts = starts_of(table, keys)
            kept, values = [], {c: [] for c in added}
            for a, b in zip(starts, np.r_[starts[1:], table.num_rows]):
                at, new = run({c: v[a:b] for c, v in arrays.items()})
                if len(at):
                    kept.append(np.asarray(at) + a)
                    for c in added:
                        values[c].append(new[c])
            if kept:
                out = table.take(pa.array(np.concatenate(kept))).select(passed)
                for c in added:
                    out = out.append_column(c, pa.array(np.concatenate(values[c])))
                yield from out.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(work, schema)
