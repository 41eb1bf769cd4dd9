"""Image stacks, masks and sidecar texts from files."""

from __future__ import annotations

import io
import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sizes of the field types of a TIFF directory, and sample types by (format, bits).
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
_SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4"}


def tiff_frames(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a classic grey-scale TIFF, either byte order, plain or deflated strips."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no classic TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    while at:
        count = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(count):
            tag, kind, n, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
            place = at + 10 + 12 * i
            if _SIZES.get(kind, 1) * n > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if kind in (3, 4):
                tags[tag] = struct.unpack_from(f"{order}{n}{'HI'[kind - 3]}", data, place)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
        width, height = tags[256][0], tags[257][0]
        packing = tags.get(259, (1,))[0]
        if packing not in (1, 8, 32946) or tags.get(277, (1,))[0] != 1:
            raise ValueError(f"compression {packing} or colour isn't read")
        strips = [data[o : o + n] for o, n in zip(tags[273], tags[279])]
        raw = b"".join(zlib.decompress(s) if packing != 1 else s for s in strips)
        kind = _SAMPLES[tags.get(339, (1,))[0], tags.get(258, (1,))[0]]
        yield np.frombuffer(raw, dtype=order + kind, count=width * height).reshape(height, width)


def write_tiff(path: str, frames: Iterator[np.ndarray]) -> int:
    """Write frames of one shape and type as plain strips, one page at a time; the number of pages.  Under 4 GiB."""
    count, shape, link = 0, None, 4
    with open(path, "wb") as f:
        f.write(b"II*\0\0\0\0\0")
        for frame in frames:
            frame = np.ascontiguousarray(frame)
            if shape not in (None, (frame.shape, frame.dtype)):
                raise ValueError("frames of a stack have one shape and one type")
            shape = (frame.shape, frame.dtype)
            bits, sort = frame.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[frame.dtype.kind]
            body = frame.astype(frame.dtype.newbyteorder("<")).tobytes()
            at = f.tell()
            if at + len(body) + 200 >= 2**32:
                raise ValueError("a classic TIFF holds less than 4 GiB")
            f.write(body + b"\0" * (len(body) % 2))
            here = f.tell()
            entries = [(256, 4, frame.shape[1]), (257, 4, frame.shape[0]), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, at), (277, 3, 1), (278, 4, frame.shape[0]), (279, 4, len(body)), (339, 3, sort)]
            f.write(struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<I", v) if k == 4 else struct.pack("<HH", v, 0)) for t, k, v in entries) + struct.pack("<I", 0))
            end = f.tell()
            f.seek(link)
            f.write(struct.pack("<I", here))
            f.seek(end)
            link = end - 4
            count += 1
    return count


def write_stacks(frames: DataFrame, folder: str) -> DataFrame:
    """Write each stack of ``(stack, frame, height, width, pixels)`` as one TIFF of floats; ``(stack, path, frames)`` of those written.

    Nothing is written before the result is used.  Spark brings the frames of a stack together in order, and a task passes them
    on to the file one at a time, under another name until it is whole, so that a task that is run again does no harm.
    ``folder`` must be a path that all executors have mounted.  Missing pixels are NaN; a file holds less than 4 GiB.
    """
    place = folder.removeprefix("file://").removeprefix("file:")
    kind = dict(frames.dtypes)["stack"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(place, exist_ok=True)
        rows = (r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)))
        for stack, pages in itertools.groupby(rows, key=lambda r: r[0]):
            path = f"{place}/{re.sub('[^A-Za-z0-9_.-]+', '_', str(stack))}.tif"
            begun = f"{path}.{uuid.uuid4().hex}"
            shaped = (np.asarray(p.values.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(h.as_py(), w.as_py()) for _, h, w, p in pages)
            count = write_tiff(begun, shaped)
            os.replace(begun, path)
            yield pa.RecordBatch.from_arrays([pa.array([stack]), pa.array([path]), pa.array([count], pa.int64())], names=["stack", "path", "frames"])

    given = frames.select("stack", "frame", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("pixels").cast("array<double>").alias("pixels"))
    return given.repartition("stack").sortWithinPartitions("stack", "frame").select("stack", "height", "width", "pixels").mapInArrow(run, f"stack {kind}, path string, frames bigint")


def read_stacks(spark: SparkSession, path: str, frames: bool = True) -> DataFrame:
    """``(path, frame, height, width, dtype, pixels)`` of all TIFF files under a path; without pixels if ``frames`` is false.

    Files that can't be read give no rows.  A task reads one file and passes its pages on one at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                try:
                    for i, page in enumerate(tiff_frames(content.as_py())):
                        pixels = page.ravel().astype(float) if frames else None
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name.as_py()]), pa.array([i], pa.int64()), pa.array([page.shape[0]], pa.int32()), pa.array([page.shape[1]], pa.int32()), pa.array([page.dtype.newbyteorder("=").name]), pa.array([pixels], pa.list_(pa.float64()))],
                            names=["path", "frame", "height", "width", "dtype", "pixels"],
                        )
                except (ValueError, KeyError, struct.error, zlib.error):
                    continue

    return files.mapInArrow(run, "path string, frame bigint, height int, width int, dtype string, pixels array<double>")


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """``(path, mask, label, y, x, w)`` of the masks in npz files: an array ``masks`` or one ``label_image``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as z:
                    masks = z["masks"] if "masks" in z else np.stack([z["label_image"] == i for i in range(1, int(z["label_image"].max()) + 1)])
                    masks = masks[None] if masks.ndim == 2 else masks
                    labels = [str(x) for x in z["labels"]] if "labels" in z else [f"MASK{i + 1:02d}" for i in range(len(masks))]
                k, y, x = np.nonzero(masks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(k)), pa.array(k, pa.int64()), pa.array([labels[i] for i in k], pa.string()), pa.array(y, pa.int64()), pa.array(x, pa.int64()), pa.array(masks[k, y, x].astype(float))],
                    names=["path", "mask", "label", "y", "x", "w"],
                )

    return files.mapInArrow(run, "path string, mask bigint, label string, y bigint, x bigint, w double")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """``(path, fields)``: the ``key: value`` lines of sidecar texts; of repeated keys the last counts; marked lines don't."""
    lines = spark.read.format("text").option("pathGlobFilter", "*.txt").option("wholetext", "true").load(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    pair = lines.where(~F.trim("line").rlike("^[%><]")).select("path", "n", F.trim(F.regexp_extract("line", "^([^:]+):(.*)$", 1)).alias("k"), F.trim(F.regexp_extract("line", "^([^:]+):(.*)$", 2)).alias("v")).where("k <> ''")
    last = pair.groupBy("path", "k").agg(F.max_by("v", "n").alias("v"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))
