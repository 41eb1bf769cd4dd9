"""Analysis packages: tables of one analysis in a folder, with a manifest that names them; and plain table exports."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def write_package(tables: dict[str, DataFrame], folder: str, settings: dict | None = None) -> None:
    """Write each table as Parquet under ``folder`` and then the manifest, so that a folder with a manifest is complete.

    The manifest is written by Spark too: the folder may lie on any file system that the cluster reaches.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    manifest = {"version": VERSION, "created_at": datetime.now(timezone.utc).isoformat(), "tables": sorted(tables), "settings": settings or {}}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")


def read_package(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """Manifest and tables of a package; another version than this one's is refused."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json").first()["value"])
    if manifest.get("version") != VERSION:
        raise ValueError(f"package version {manifest.get('version')} isn't {VERSION}")
    return manifest, {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in manifest["tables"]}


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Write a table as CSV with a header: preferred columns first, the rest after them, missing numbers blank."""
    first = [c for c in columns or [] if c in df.columns]
    ordered = df.select(*first, *[c for c in df.columns if c not in first])
    plain = ordered.select(*(F.col(c).cast("int").alias(c) if kind == "boolean" else F.nanvl(F.col(c), F.lit(None)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in ordered.dtypes))
    plain.write.mode("overwrite").option("header", "true").csv(path)


def read_csv_long(spark: SparkSession, path: str, keys: list[str], name: str = "trace_id", value: str = "value") -> DataFrame:
    """A wide CSV, one column per trace, as long rows; cells that are no numbers are null."""
    wide = spark.read.option("header", "true").csv(path)
    rest = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *(F.col(f"`{c}`").try_cast("double").alias(c) for c in rest)).unpivot(keys, rest, name, value)


def wide_traces(samples: DataFrame, column: str, traces: list[str]) -> DataFrame:
    """Traces side by side by position, the shorter ones padded with nulls; the list of traces bounds the columns."""
    wide = samples.groupBy("idx").pivot("trace_id", traces).agg(F.first(column))
    return wide.orderBy("idx")


#: Samples of a trace's arrays that are passed on at a time.
CHUNK = 65_536


def read_trace_arrays(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``(trace_id, idx, fs, ...)`` of packages that hold a folder with ``arrays.npz`` and ``metadata.json`` for each trace.

    Each of ``columns`` is an array of the file, as numbers (flags are 0 and 1); one that is missing is null, but ``raw`` and
    ``corrected_source`` take the place of ``corrected``; shorter arrays end in nulls.  A trace takes its name and rate from the
    metadata, without them its folder's name and no rate.  Files that can't be read give no rows.  A task reads one file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "arrays.npz").option("recursiveFileLookup", "true").load(path)
    texts = spark.read.format("text").option("pathGlobFilter", "metadata.json").option("recursiveFileLookup", "true").option("wholetext", "true").load(path)
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]+$", 1)
    notes = texts.select(folder(F.col("_metadata.file_path")).alias("folder"), F.from_json("value", "trace_name string, sampling_rate_hz double").alias("m"))
    # the two readers write the same place as file:/a and file:///a
    place = lambda c: F.regexp_replace(c, "^file:/+", "/")
    named = files.select(place(folder(F.col("path"))).alias("folder"), "content").join(notes.withColumn("folder", place(F.col("folder"))), "folder", "left")
    named = named.select(F.coalesce("m.trace_name", F.regexp_extract("folder", "([^/]+)$", 1)).alias("trace_id"), F.col("m.sampling_rate_hz").alias("fs"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, fs, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                try:
                    with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as z:
                        instead = {c: c if c in z.files or c not in ("raw", "corrected_source") else "corrected" for c in columns}
                        arrays = {c: z[a].ravel().astype(float) for c, a in instead.items() if a in z.files}
                except (ValueError, OSError, EOFError, zipfile.BadZipFile):
                    continue
                n = max((len(a) for a in arrays.values()), default=0)
                for at in range(0, n, CHUNK):
                    idx = np.arange(at, min(n, at + CHUNK))
                    cut = [arrays.get(c, idx[:0])[at : at + CHUNK] for c in columns]
                    filled = [pa.array(np.concatenate([a, np.full(len(idx) - len(a), np.nan)]), pa.float64(), from_pandas=True) for a in cut]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(idx)), pa.array(idx, pa.int64()), pa.array([fs] * len(idx), pa.float64()), *filled], names=["trace_id", "idx", "fs", *columns])

    return named.mapInArrow(run, "trace_id string, idx bigint, fs double, " + ", ".join(f"`{c}` double" for c in columns))
