"""Operators over stacks of image frames: layouts, means, projections, correlation, thresholds, masks and motion.

Frames are rows ``(stack, frame, height, width, pixels)`` with the pixels in row-major order.  Per-pixel work explodes pixels
and aggregates natively; only transforms of a whole frame run as Arrow functions over batches of frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.grouped import map_groups
from traceloom.operators.ordered import carried
from traceloom.operators.stats import otsu
from traceloom.session import cut_lineage

#: Frames of a stack through which a mask is followed in one group.
FRAMES = 4096


def pixels(frames: DataFrame) -> DataFrame:
    """``(stack, frame, y, x, v)`` of every pixel."""
    out = frames.select("stack", "frame", "width", F.posexplode("pixels").alias("pos", "v"))
    return out.select("stack", "frame", F.floor(F.col("pos") / F.col("width")).alias("y"), (F.col("pos") % F.col("width")).cast("long").alias("x"), F.col("v").cast("double").alias("v"))


def roi_boxes(layout: DataFrame) -> DataFrame:
    """Row-major grid of equal boxes that tile a frame exactly: ``(stack, roi, x0, y0, x1, y1)``.

    ``layout`` has ``(stack, width, height, box_width, box_height, roi_count)``.  A layout whose boxes don't tile the frame, or
    are too many, gives no boxes.
    """
    ok = (F.col("width") % F.col("box_width") == 0) & (F.col("height") % F.col("box_height") == 0)
    fits = F.col("roi_count") <= (F.col("width") / F.col("box_width")) * (F.col("height") / F.col("box_height"))
    per_row = F.col("width") / F.col("box_width")
    rows = layout.where(ok & fits & (F.col("roi_count") > 0)).select("*", F.explode(F.sequence(F.lit(0), F.col("roi_count") - 1)).alias("i"))
    x0, y0 = F.col("i") % per_row * F.col("box_width"), F.floor(F.col("i") / per_row) * F.col("box_height")
    return rows.select("stack", (F.col("i") + 1).cast("long").alias("roi"), x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), (x0 + F.col("box_width")).cast("long").alias("x1"), (y0 + F.col("box_height")).cast("long").alias("y1"))


def tile_of(y: Column, x: Column, tile: int, width: int) -> Column:
    """Number of a tile, from 1, in row-major order."""
    return (F.floor(y / tile) * (width // tile) + F.floor(x / tile) + 1).cast("long")


def _arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """The frames of a batch as arrays of ``height`` by ``width``, missing pixels as NaN."""
    lists = batch.column(batch.schema.get_field_index(name))
    flat, ends = lists.values.to_numpy(zero_copy_only=False).astype(float), lists.offsets.to_numpy()
    h, w = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("height", "width"))
    return [flat[a:b].reshape(y, x) for a, b, y, x in zip(ends[:-1], ends[1:], h, w)]


def roi_means(frames: DataFrame, tile: int, width: int) -> DataFrame:
    """``(stack, frame, roi, value)``: mean of the present pixels of each tile of each frame; no pixel leaves its task."""
    kinds = dict(frames.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, roi, value = [], [], []
            for i, x in enumerate(_arrays(batch, "pixels")):
                y, c = np.indices(x.shape)
                place = ((y // tile) * (width // tile) + c // tile).ravel()
                there = np.isfinite(x.ravel())
                n = np.bincount(place, there)
                tiles = np.unique(place)
                at += [i] * len(tiles)
                roi += (tiles + 1).tolist()
                total = np.bincount(place, np.where(there, x.ravel(), 0.0))
                value += [total[t] / n[t] if n[t] else None for t in tiles]
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(roi, pa.int64()), pa.array(value, pa.float64())], names=["stack", "frame", "roi", "value"])

    return frames.select("stack", "frame", "height", "width", "pixels").mapInArrow(run, f"stack {kinds['stack']}, frame {kinds['frame']}, roi bigint, value double")


def _partial_projections(frames: DataFrame) -> DataFrame:
    """``(stack, y, x, n, total, squares, top)`` of what each task has seen of a stack: one row a pixel and task, not a frame."""
    kind = dict(frames.dtypes)["stack"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for stack, (n, total, squares, top) in seen.items():
                y, x = (c.ravel() for c in np.indices(total.shape))
                columns = [pa.array([stack] * total.size), pa.array(y, pa.int64()), pa.array(x, pa.int64()), *(pa.array(v.ravel(), pa.float64()) for v in (n, total, squares, top))]
                yield pa.RecordBatch.from_arrays(columns, names=["stack", "y", "x", "n", "total", "squares", "top"])
            seen.clear()

        for batch in batches:
            for stack, x in zip(batch.column(0).to_pylist(), _arrays(batch, "pixels")):
                there = np.isfinite(x)
                v = np.where(there, x, 0.0)
                if stack in seen:
                    one = seen[stack]
                    for i, part in enumerate((there, v, v * v)):
                        one[i] += part
                    np.maximum(one[3], np.where(there, x, -np.inf), out=one[3])
                else:
                    seen[stack] = [there.astype(float), v, v * v, np.where(there, x, -np.inf)]
            if sum(one[0].size for one in seen.values()) > 2_000_000:
                yield from flush()
        yield from flush()

    return frames.select("stack", "height", "width", "pixels").mapInArrow(run, f"stack {kind}, y bigint, x bigint, n double, total double, squares double, top double")


def _projection_sums(frames: DataFrame) -> DataFrame:
    """``(stack, y, x, n, total, squares, top)`` of every pixel of a stack, missing in all frames or not."""
    return _partial_projections(frames).groupBy("stack", "y", "x").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("top").alias("top"))


def projections(frames: DataFrame) -> DataFrame:
    """``(stack, y, x, mean, sd, top)`` over the frames of a stack; the deviation of a single frame is 0.

    Each task adds its frames up before anything is shuffled: one row for each pixel of a stack and task.
    """
    sums = _projection_sums(frames)
    mean = F.col("total") / F.col("n")
    sd = F.sqrt(F.greatest((F.col("squares") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    return sums.where("n > 0").select("stack", "y", "x", mean.alias("mean"), F.when(F.col("n") > 1, sd).otherwise(0.0).alias("sd"), "top")


def frame_correlation(frames: DataFrame, threshold_mad: float = 3.0, bins: int = 1024) -> DataFrame:
    """How well each frame agrees with its stack's mean: correlation, its complement, mean difference, rank, heavy motion.

    A frame moves heavily if its correlation lies below the median by ``threshold_mad`` scaled median absolute deviations, or
    below the median where these are 0.  The rank counts from the lowest correlation, ties by frame; frames are ranked within
    ``bins`` bins of correlation, whose counts are carried on.
    """
    kinds = dict(frames.dtypes)
    paired = frames.join(_mean_images(frames), "stack").select("stack", "frame", "height", "width", "pixels", "reference")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, m in zip(_arrays(batch, "pixels"), _arrays(batch, "reference")):
                there = np.isfinite(x) & np.isfinite(m)
                a, b = x[there], m[there]
                difference = float(np.abs(a - b).mean()) if len(a) else None
                a, b = a - a.mean() if len(a) else a, b - b.mean() if len(b) else b
                norm = float(np.sqrt((a * a).sum() * (b * b).sum()))
                c = float((a * b).sum()) / norm if norm > 1e-12 else float(difference == 0)
                out.append((min(max(c, -1.0), 1.0), difference))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], pa.float64()) for i in (0, 1))], names=["stack", "frame", "correlation", "difference"])

    rows = cut_lineage(paired.mapInArrow(run, f"stack {kinds['stack']}, frame {kinds['frame']}, correlation double, difference double"))
    middle = rows.groupBy("stack").agg(F.percentile("correlation", F.lit(0.5)).alias("m"))
    rows = rows.join(middle, "stack")
    mad = rows.groupBy("stack").agg(F.percentile(F.abs(F.col("correlation") - F.col("m")), F.lit(0.5)).alias("mad"))
    rows = rows.join(mad, "stack").withColumn("limit", F.col("m") - threshold_mad * 1.4826 * F.col("mad")).withColumn("bin", F.floor((F.col("correlation") + 1) / 2 * bins))
    below = carried(rows.groupBy("stack", "bin").agg(F.count("*").alias("here")), ["stack"], "bin", "here", "below", "sum").drop("here")
    within = F.row_number().over(Window.partitionBy("stack", "bin").orderBy("correlation", "frame"))
    rows = rows.join(below, ["stack", "bin"]).withColumn("rank", (F.col("below") + within).cast("bigint"))
    return rows.select("stack", "frame", "correlation", (1 - F.col("correlation")).alias("distance"), "difference", (F.col("correlation") < F.col("limit")).alias("heavy_motion"), "rank")


def mask_means(frames: DataFrame, weights: DataFrame) -> DataFrame:
    """``(stack, frame, mask, value)``: weighted mean under each mask; ``weights`` has ``(mask, y, x, w)`` and is small."""
    joined = pixels(frames).join(weights, ["y", "x"])
    return joined.groupBy("stack", "frame", "mask").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("value"))


def background_weights(weights: DataFrame, tile: int, width: int, mode: str) -> DataFrame:
    """Pixels that stand for a mask's background: the whole frame, or the tiles that the mask lies in, without any mask's."""
    places = weights.select("y", "x").distinct()
    tiles = weights.select("mask", tile_of(F.col("y"), F.col("x"), tile, width).alias("tile")).distinct()
    grid = weights.sparkSession.range(width * width).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    free = grid.join(places, ["y", "x"], "left_anti").withColumn("tile", tile_of(F.col("y"), F.col("x"), tile, width))
    if mode == "parent_tile":
        return free.join(tiles, "tile").select("mask", "y", "x", F.lit(1.0).alias("w"))
    # the free pixels of a frame stand for all masks alike
    every = weights.agg(F.collect_set("mask").alias("masks"))
    return free.join(every).select(F.explode("masks").alias("mask"), "y", "x", F.lit(1.0).alias("w")) if mode == "global" else weights.where("false")


def mask_records(weights: DataFrame) -> DataFrame:
    """Per mask: pixel count, sum of weights, half-open bounding box and weighted centre."""
    return weights.where("w > 0").groupBy("mask").agg(
        F.count("*").alias("pixel_count"),
        F.sum("w").alias("weight_sum"),
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        (F.max("x") + 1).alias("x1"),
        (F.max("y") + 1).alias("y1"),
        (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("centre_x"),
        (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("centre_y"),
    )


def mask_boundary(mask: DataFrame) -> DataFrame:
    """The pixels ``(mask, y, x)`` of a mask that have a neighbour outside of it, edges of the frame included."""
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
    around = mask.select("mask", "y", "x", steps.alias("s")).select("mask", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    covered = around.groupBy("mask", "y", "x").count()
    inner = covered.where("count = 9").select("mask", "y", "x")
    return mask.select("mask", "y", "x").join(inner, ["mask", "y", "x"], "left_anti")


def tile_foreground(mean_image: DataFrame, tile: int, width: int, method: str = "foreground", foreground: float = 0.6, brightest: float = 0.95, factor: float = 2.5) -> DataFrame:
    """Pixels ``(stack, tile, y, x)`` brighter than their tile's threshold.

    By ``foreground`` that is a percentile; by ``otsu`` the split of a histogram; by ``brightest`` the greater of a high
    percentile and the lesser of median and mean with ``factor`` deviations (robust and plain).  Tiles of one brightness have
    none; where nothing is above the threshold the brightest pixels are it.
    """
    keys = ["stack", "tile"]
    rows = mean_image.where(F.col("mean").isNotNull()).withColumn("tile", tile_of(F.col("y"), F.col("x"), tile, width))
    ends = rows.groupBy(*keys).agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"), F.percentile("mean", F.lit(foreground if method == "foreground" else brightest)).alias("limit"), F.percentile("mean", F.lit(0.5)).alias("middle"), F.avg("mean").alias("usual"), F.stddev_pop("mean").alias("spread"))
    ends = ends.where("hi > lo")
    if method == "otsu":
        bins = min(128, max(8, int(np.sqrt(tile * tile)) * 4))
        ends = ends.drop("limit").join(otsu(rows, keys, "mean", bins).withColumnRenamed("threshold", "limit"), keys)
    elif method == "brightest":
        mad = rows.join(ends.select(*keys, "middle"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("mean") - F.col("middle")), F.lit(0.5)).alias("mad"))
        robust, plain = F.col("middle") + factor * 1.4826 * F.col("mad"), F.col("usual") + factor * F.col("spread")
        ends = ends.join(mad, keys).withColumn("limit", F.greatest("limit", F.least(robust, plain)))
    elif method != "foreground":
        raise ValueError(f"unknown method {method!r}; there are foreground, otsu and brightest")
    above = (F.col("mean") > F.col("limit")) | ((F.col("limit") >= F.col("hi")) & (F.col("mean") >= F.col("hi")))
    return rows.join(ends.select(*keys, "limit", "hi"), keys).where(above).select("stack", "tile", "y", "x")


def components(mask: DataFrame, keys: list[str]) -> DataFrame:
    """8-connected components of pixels ``(*keys, y, x)``: adds ``component``, the least row-major place in it.

    Labels spread to neighbours by joins, with doubling through the pixel that a label names, until none changes; components
    of a large image take about the logarithm of their extent in rounds.
    """
    place = F.col("y") * 1_000_000 + F.col("x")
    now = cut_lineage(mask.select(*keys, "y", "x", place.alias("here"), place.alias("component")))
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
    while True:
        sent = now.select(*keys, "y", "x", "component", steps.alias("s"))
        sent = sent.select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "component")
        least = sent.groupBy(*keys, "y", "x").agg(F.min("component").alias("least"))
        near = now.join(least, [*keys, "y", "x"])
        jump = near.select(*keys, F.col("here").alias("least"), F.col("least").alias("far"))
        moved = near.join(jump, [*keys, "least"], "left").select(*keys, "y", "x", "here", F.least("least", F.coalesce("far", "least")).alias("new"), "component")
        moved = cut_lineage(moved)
        if moved.where("new <> component").isEmpty():
            break
        now = moved.select(*keys, "y", "x", "here", F.col("new").alias("component"))
    return now.drop("here")


def display_range(frames: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """``(stack, frame, black, white)``: percentiles of a frame, its extremes where they coincide, one apart where those do."""
    ends = pixels(frames).groupBy("stack", "frame").agg(F.percentile("v", F.lit(low)).alias("a"), F.percentile("v", F.lit(high)).alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wide = F.col("b") > F.col("a")
    black, white = F.when(wide, F.col("a")).otherwise(F.col("lo")), F.when(wide, F.col("b")).otherwise(F.col("hi"))
    return ends.select("stack", "frame", black.alias("black"), F.when(white > black, white).otherwise(black + 1).alias("white"))


def to_uint8(v: Column, black: Column, white: Column) -> Column:
    """A brightness between black and white as 0..255, halves to even, cut at the ends."""
    return F.least(F.greatest(F.rint((v - black) / (white - black) * 255), F.lit(0.0)), F.lit(255.0)).cast("int")


def thinned(frames: DataFrame, most_edge: int) -> DataFrame:
    """Pixels of a preview: every n-th row and column, so that no edge is longer than ``most_edge``."""
    step = F.ceil(F.greatest("height", "width") / most_edge)
    cut = pixels(frames).join(frames.select("stack", "frame", step.alias("step")), ["stack", "frame"]).where((F.col("y") % F.col("step") == 0) & (F.col("x") % F.col("step") == 0))
    return cut.select("stack", "frame", (F.col("y") / F.col("step")).cast("long").alias("y"), (F.col("x") / F.col("step")).cast("long").alias("x"), "v")


def moved(frames: DataFrame, shifts: DataFrame) -> DataFrame:
    """Frames moved by ``(dy, dx)`` each without wrapping; what comes free takes the frame's median.

    Shifts between pixels mix the four pixels around where a pixel comes from, which must all be in the frame.  Frames without a
    shift stay.  Each frame is moved within its row: only the shifts are joined.
    """
    kinds = dict(frames.dtypes)
    paired = frames.join(shifts.select("stack", "frame", F.col("dy").cast("double").alias("dy"), F.col("dx").cast("double").alias("dx")), ["stack", "frame"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dy, dx = (np.nan_to_num(batch.column(i).to_numpy(zero_copy_only=False)) for i in (5, 6))
            there = [move(x, y, c).ravel() for x, y, c in zip(_arrays(batch, "pixels"), dy, dx)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(there, pa.list_(pa.float64()))], names=["stack", "frame", "height", "width", "pixels"])

    out = paired.select("stack", "frame", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels", "dy", "dx")
    return out.mapInArrow(run, f"stack {kinds['stack']}, frame {kinds['frame']}, height int, width int, pixels array<double>")


def shifted(frames: DataFrame, shifts: DataFrame) -> DataFrame:
    """Pixels ``(stack, frame, y, x, v)`` of the frames as they are ``moved``."""
    return pixels(moved(frames, shifts))


def move(frame: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """A frame moved by ``dy`` down and ``dx`` to the right, free places filled with its median."""
    h, w = frame.shape
    out = np.full((h, w), np.median(frame[np.isfinite(frame)]) if np.isfinite(frame).any() else 0.0)
    if abs(dy - round(dy)) < 1e-8 and abs(dx - round(dx)) < 1e-8:
        y, x = int(round(dy)), int(round(dx))
        if abs(y) < h and abs(x) < w:
            out[max(y, 0) : h + min(y, 0), max(x, 0) : w + min(x, 0)] = frame[max(-y, 0) : h - max(y, 0), max(-x, 0) : w - max(x, 0)]
        return out
    top, left = int(np.floor(-dy)), int(np.floor(-dx))
    part_y, part_x = -dy - top, -dx - left
    a, b = max(0, -top), min(h, h - 1 - top)
    c, d = max(0, -left), min(w, w - 1 - left)
    if a < b and c < d:
        corner = lambda y, x: frame[a + top + y : b + top + y, c + left + x : d + left + x]
        upper = (1 - part_x) * corner(0, 0) + part_x * corner(0, 1)
        lower = (1 - part_x) * corner(1, 0) + part_x * corner(1, 1)
        out[a:b, c:d] = (1 - part_y) * upper + part_y * lower
    return out


def _without_slow_changes(x: np.ndarray, sigma: float | None) -> np.ndarray:
    """A frame less its Gaussian blur, if a width is given, and less its mean; missing pixels take the mean of the others first."""
    there = np.isfinite(x)
    if not there.all():
        x = np.where(there, x, x[there].mean() if there.any() else 0.0)
    if sigma:
        reach = max(1, round(3 * sigma))
        kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
        kernel /= kernel.sum()
        blur = x
        for axis in (0, 1):
            wide = np.pad(blur, [(reach, reach) if i == axis else (0, 0) for i in (0, 1)], mode="reflect")
            blur = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis=axis) @ kernel
        x = x - blur
    return x - x.mean()


def widest_shift(boxes: DataFrame) -> int:
    """The bound of shifts for a layout: an eighth of the shortest edge of its boxes, from 1 to 5."""
    edge = boxes.agg(F.min(F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("e")).first()["e"]
    return 1 if edge is None else max(1, min(5, int(edge) // 8))


def estimate_shift(reference: np.ndarray, moving: np.ndarray, most: int, subpixel: bool = False, high_pass: float | None = None, least_ratio: float | None = None) -> tuple[float, float, float, float, bool]:
    """Shift ``(dy, dx)`` that brings ``moving`` onto ``reference`` by phase correlation, the peak's height, its ratio to the
    next one, and whether that is enough.

    Only shifts of at most ``most`` pixels are looked at; of equal peaks the first in row-major order counts.  Between pixels a
    parabola through the peak's neighbours gives the place.  A flat frame or reference isn't moved.
    """
    a, b = _without_slow_changes(reference, high_pass), _without_slow_changes(moving, high_pass)
    if not a.any() or not b.any():
        return 0.0, 0.0, 0.0, 0.0, False
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    peak = np.abs(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)))
    h, w = peak.shape
    near = peak[np.ix_(np.arange(-most, most + 1) % h, np.arange(-most, most + 1) % w)]
    y, x = np.unravel_index(int(np.argmax(np.round(near, 12))), near.shape)
    y, x, top = int(y) - most, int(x) - most, float(near[y, x])
    ratio = top / max(float(np.partition(near.ravel(), -2)[-2]), 1e-12) if near.size > 1 else float("inf")
    dy, dx = float(y), float(x)
    if subpixel:
        def vertex(left: float, right: float) -> float:
            bend = left - 2 * top + right
            return 0.0 if abs(bend) < 1e-12 else min(max(0.5 * (left - right) / bend, -0.5), 0.5)

        dy += vertex(float(peak[(y - 1) % h, x % w]), float(peak[(y + 1) % h, x % w]))
        dx += vertex(float(peak[y % h, (x - 1) % w]), float(peak[y % h, (x + 1) % w]))
    dy, dx = min(max(dy, -most), most), min(max(dx, -most), most)
    enough = not least_ratio or ratio >= least_ratio
    return (dy if enough else 0.0), (dx if enough else 0.0), top, ratio, enough


def frames_of(rows: DataFrame, height: int, width: int) -> DataFrame:
    """Frames of pixels ``(stack, frame, y, x, v)`` of one size."""
    packed = rows.groupBy("stack", "frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    return packed.select("stack", "frame", F.lit(height).alias("height"), F.lit(width).alias("width"), F.col("p.v").alias("pixels"))


def _mean_images(frames: DataFrame) -> DataFrame:
    """``(stack, reference)``: the mean of a stack's frames as an array, null for pixels that no frame has."""
    mean = _projection_sums(frames).select("stack", "y", "x", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"))
    return mean.groupBy("stack").agg(F.sort_array(F.collect_list(F.struct("y", "x", "mean"))).alias("r")).select("stack", F.col("r.mean").alias("reference"))


def _shifts_against(frames: DataFrame, references: DataFrame, most: int, subpixel: bool = False, high_pass: float | None = None, least_ratio: float | None = None) -> DataFrame:
    """Shift of every frame against its stack's reference; frames are transformed batch by batch in Arrow calls."""
    paired = frames.join(references, "stack").select("stack", "frame", "height", "width", "pixels", "reference")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [estimate_shift(m, x, min(most, (min(x.shape) - 1) // 2), subpixel, high_pass, least_ratio) for x, m in zip(_arrays(batch, "pixels"), _arrays(batch, "reference"))]
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["stack", "frame", "dy", "dx", "peak", "ratio", "accepted"])

    kind = dict(frames.dtypes)
    out = paired.mapInArrow(run, f"stack {kind['stack']}, frame {kind['frame']}, dy double, dx double, peak double, ratio double, accepted boolean")
    return out if subpixel else out.withColumn("dy", F.col("dy").cast("bigint")).withColumn("dx", F.col("dx").cast("bigint"))


def motion_shifts(frames: DataFrame, most: int = 2, reference: str = "mean", rounds: int = 1, subpixel: bool = False, high_pass: float | None = None, least_ratio: float | None = None) -> DataFrame:
    """``(stack, frame, dy, dx, peak, ratio, accepted)``: the shift of every frame against its stack's reference.

    The reference is the stack's first frame (``first``) or its mean image, which with more ``rounds`` is taken again from the
    frames as they are moved so far.  Means are partial sums of each task, joined to the frames by stack.  Frames whose peak
    isn't ``least_ratio`` times the next one aren't moved.
    """
    how = {"subpixel": subpixel, "high_pass": high_pass, "least_ratio": least_ratio}
    if reference == "first":
        first = frames.groupBy("stack").agg(F.min_by("pixels", "frame").alias("reference"))
        return _shifts_against(frames, first, most, **how)
    shifts = _shifts_against(frames, _mean_images(frames), most, **how)
    for _ in range(rounds - 1):
        shifts = cut_lineage(shifts)
        shifts = _shifts_against(frames, _mean_images(moved(frames, shifts)), most, **how)
    return shifts


# Fixed value: a tile's own peak must be so many times the next one for the tile to move.
RESIDUAL_RATIO = 1.10


def residual_moved(frames: DataFrame, boxes: DataFrame, most: int = 2, residual: int = 1, least_ratio: float = RESIDUAL_RATIO, high_pass: float | None = None, **shared) -> DataFrame:
    """Frames moved as a whole by ``motion_shifts``, then each tile by what is left of its shift: frames with ``tiles``.

    ``boxes`` has ``(stack, roi, x0, y0, x1, y1)``, within the frames and few for each stack.  ``tiles`` is an array of ``(roi, dy, dx,
    peak, ratio, accepted)``; a tile is compared with the mean of the frames after the first step and moves by whole pixels,
    ``residual`` at most, where its peak is ``least_ratio`` times the next one.  What comes free takes the tile's median.  Stacks
    without boxes keep their frames, with no tiles.  ``shared`` goes to ``motion_shifts``.
    """
    whole = cut_lineage(moved(frames, motion_shifts(frames, most, high_pass=high_pass, **shared)))
    tiles = boxes.groupBy("stack").agg(F.sort_array(F.collect_list(F.array("roi", "x0", "y0", "x1", "y1"))).alias("boxes"))
    paired = whole.join(_mean_images(whole), "stack").join(tiles, "stack", "left").select("stack", "frame", "height", "width", "pixels", "reference", "boxes")
    kinds = dict(frames.dtypes)
    tile = pa.struct([("roi", pa.int64()), ("dy", pa.int64()), ("dx", pa.int64()), ("peak", pa.float64()), ("ratio", pa.float64()), ("accepted", pa.bool_())])

    def settle(frame: np.ndarray, mean: np.ndarray, roi: int, x0: int, y0: int, x1: int, y1: int) -> dict:
        part = frame[y0:y1, x0:x1].copy()
        reach = max(0, min(residual, (min(part.shape) - 1) // 2))
        dy, dx, peak, ratio, accepted = estimate_shift(mean[y0:y1, x0:x1], part, reach, False, high_pass, least_ratio)
        frame[y0:y1, x0:x1] = move(part, dy, dx)
        return {"roi": roi, "dy": int(dy), "dx": int(dx), "peak": peak, "ratio": ratio, "accepted": bool(accepted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x.copy() for x in _arrays(batch, "pixels")]
            found = [[settle(x, m, *b) for b in boxes or []] for x, m, boxes in zip(out, _arrays(batch, "reference"), batch.column(6).to_pylist())]
            columns = [pa.array([x.ravel() for x in out], pa.list_(pa.float64())), pa.array(found, pa.list_(tile))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *columns], names=["stack", "frame", "height", "width", "pixels", "tiles"])

    shape = "array<struct<roi: bigint, dy: bigint, dx: bigint, peak: double, ratio: double, accepted: boolean>>"
    return paired.mapInArrow(run, f"stack {kinds['stack']}, frame {kinds['frame']}, height int, width int, pixels array<double>, tiles {shape}")


def residual_shifts(corrected: DataFrame) -> DataFrame:
    """``(stack, frame, roi, dy, dx, peak, ratio, accepted)`` of the tiles of ``residual_moved``."""
    return corrected.select("stack", "frame", F.explode("tiles").alias("t")).select("stack", "frame", "t.*")


def tile_shifts(frames: DataFrame, boxes: DataFrame, height: int, width: int, most: int = 2) -> DataFrame:
    """``(stack, roi, frame, dy, dx, peak)``: each tile of a stack moved on its own against its first frame."""
    cut = roi_crops(frames, boxes).withColumn("tile", F.struct("stack", "roi"))
    tiles = frames_of(cut.select(F.to_json("tile").alias("stack"), "frame", "y", "x", "v"), height, width)
    out = motion_shifts(tiles, most, "first")
    kind = dict(frames.dtypes)["stack"]
    place = F.from_json("stack", f"stack {kind}, roi bigint")
    return out.select(place["stack"].alias("stack"), place["roi"].alias("roi"), "frame", "dy", "dx", "peak", "ratio", "accepted")


def mask_shifts(frames: DataFrame, weights: DataFrame, radius: int) -> DataFrame:
    """``(stack, frame, mask, dy, dx, score, visible, signal)``: where each mask fits each frame best, near its place.

    Every shift of at most ``radius`` pixels is scored by the correlation of the stack's mean under the mask with the frame under
    the shifted mask, or by the mean brightness where either is flat; pixels that leave the frame drop out.  The best score
    wins, then the smaller dy and dx.  Masks are small and the shifts few, so the join is on pixels: (2 radius + 1) squared
    rows for each pixel of a mask in each frame, summed up at once.
    """
    each = pixels(frames)
    template = each.groupBy("stack", "y", "x").agg(F.avg("v").alias("t")).join(weights.where("w > 0").select("mask", "y", "x"), ["y", "x"])
    moves = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))))
    moved = template.select("stack", "mask", "t", "y", "x", moves.alias("s")).select("stack", "mask", "t", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "s.dy", "s.dx")
    met = moved.join(each, ["stack", "y", "x"])
    scored = met.groupBy("stack", "frame", "mask", "dy", "dx").agg(F.count("*").alias("visible"), F.avg("v").alias("signal"), F.corr("t", "v").alias("c"), F.stddev_pop("t").alias("st"), F.stddev_pop("v").alias("sv"))
    score = F.when((F.col("visible") >= 2) & (F.col("st") > 1e-9) & (F.col("sv") > 1e-9), F.col("c")).otherwise(F.col("signal"))
    best = scored.withColumn("score", score).groupBy("stack", "frame", "mask").agg(F.max_by(F.struct("dy", "dx", "score", "visible", "signal"), F.struct(F.round("score", 9), -F.col("dy"), -F.col("dx"))).alias("b"))
    return best.select("stack", "frame", "mask", "b.*")


def difference_map(v: Column, limit: Column, gamma: float = 0.85) -> Column:
    """A signed difference as -1..1 for a diverging map, cut at the limit and bent by ``gamma``."""
    share = F.least(F.greatest(v / limit, F.lit(-1.0)), F.lit(1.0))
    return F.signum(share) * F.pow(F.abs(share), gamma)


def sample_frames(count: Column, wanted: int) -> Column:
    """At most ``wanted`` frame numbers spread evenly over ``count``, each once, as an array; empty where there are none."""
    n = F.least(count, F.lit(wanted)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.rint(i * (count - 1) / max(wanted - 1, 1)).cast("long"))
    return F.when(n > 0, F.array_distinct(spread)).otherwise(F.array().cast("array<bigint>"))


def tracked_masks(frames: DataFrame, weights: DataFrame, local: int = 1, bound: int = 2, least_score: float | None = None, least_visible: float = 0.25) -> DataFrame:
    """Masks followed from frame to frame: ``(stack, mask, frame, dy, dx, score, visible_fraction, signal, state)``.

    Every shift within ``bound`` is scored natively, as in ``mask_shifts``.  Then a small state machine passes over the frames of
    each mask, in pieces of ``FRAMES``: first from every place that a mask may have at the start of a piece, all at once, which
    gives its place at the end; these are followed from piece to piece, one row each; then from the place that it really has: it takes the best shift near the last one (``accepted``), else the best of all (``rescued``), else stays where
    it was (``held``); the first frame starts from no shift.  A shift passes if its score and the visible share of the mask do.
    """
    each = pixels(frames)
    inside = weights.where("w > 0")
    template = each.groupBy("stack", "y", "x").agg(F.avg("v").alias("t")).join(inside.select("mask", "y", "x"), ["y", "x"])
    sizes = inside.groupBy("mask").agg(F.count("*").alias("size"))
    moves = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-bound, bound + 1) for dx in range(-bound, bound + 1))))
    moved = template.select("stack", "mask", "t", "y", "x", moves.alias("s")).select("stack", "mask", "t", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "s.dy", "s.dx")
    scored = moved.join(each, ["stack", "y", "x"]).groupBy("stack", "mask", "frame", "dy", "dx").agg(
        F.count("*").alias("visible"), F.avg("v").alias("signal"), F.corr("t", "v").alias("c"), F.stddev_pop("t").alias("st"), F.stddev_pop("v").alias("sv")
    )
    score = F.when((F.col("visible") >= 2) & (F.col("st") > 1e-9) & (F.col("sv") > 1e-9), F.col("c")).otherwise(F.col("signal"))
    rows = scored.join(sizes, "mask").select("stack", "mask", "frame", "dy", "dx", score.alias("score"), (F.col("visible") / F.col("size")).alias("visible_fraction"), "signal", (F.col("frame") * 10_000 + (F.col("dy") + bound) * 100 + F.col("dx") + bound).alias("place"), F.floor(F.col("frame") / FRAMES).alias("piece"))
    rows = cut_lineage(rows)  # read twice below

    side = 2 * bound + 1
    grid = np.array([(dy, dx) for dy in range(-bound, bound + 1) for dx in range(-bound, bound + 1)])
    close = np.abs(grid[:, None] - grid[None]).max(axis=2) <= local

    def frames_in(g: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First row of each frame, and for each place of the grid its row there, its score and whether that passes."""
        passes = (g["visible_fraction"] >= least_visible) & ((g["score"] >= least_score) if least_score is not None else True)
        edges = np.flatnonzero(np.r_[True, g["frame"][1:] != g["frame"][:-1], True])
        at = ((g["dy"] + bound) * side + g["dx"] + bound).astype(int)
        for a, b in zip(edges[:-1], edges[1:]):
            row, score, ok = np.full(len(grid), -1), np.full(len(grid), -np.inf), np.zeros(len(grid), dtype=bool)
            row[at[a:b]], score[at[a:b]], ok[at[a:b]] = np.arange(a, b), np.round(g["score"][a:b], 9), passes[a:b]
            yield a, row, score, ok

    def step(last: np.ndarray, row: np.ndarray, score: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places after a frame for places before it, and how: 0 accepted, 1 rescued, 2 held, 3 not seen at all."""
        near = np.where(close[last], score, -np.inf).argmax(axis=1)
        best = int(score.argmax())
        accepted = close[last, near] & ok[near]
        rescued = ~accepted & ok[best]
        how = np.where(accepted, 0, np.where(rescued, 1, np.where(row[last] >= 0, 2, 3)))
        return np.where(accepted, near, np.where(rescued, best, last)), how

    def ends(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        last = np.arange(len(grid))
        for _, row, score, ok in frames_in(g):
            last, _ = step(last, row, score, ok)
        return np.zeros(len(grid), dtype=np.int64), {"begin": np.arange(len(grid)), "end": last}

    def follow(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        now, begins = len(grid) // 2, []
        for end in g["end"].reshape(-1, len(grid)):
            begins.append(now)
            now = int(end[now])
        return np.arange(len(begins)) * len(grid), {"start": np.array(begins)}

    def run(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        at, state, last = [], [], np.array([int(g["start"][0])])
        for _, row, score, ok in frames_in(g):
            last, how = step(last, row, score, ok)
            if how[0] < 3:
                at.append(row[last[0]])
                state.append(("accepted", "rescued", "held")[how[0]])
        return np.array(at, dtype=np.int64), {"state": np.array(state, dtype=object)}

    keys = ["stack", "mask", "piece"]
    used = ["frame", "dy", "dx", "score", "visible_fraction"]
    maps = map_groups(rows, keys, "place", ends, keys, {"begin": "bigint", "end": "bigint"}, used=used)
    starts = map_groups(maps.withColumn("order", F.col("piece") * len(grid) + F.col("begin")), ["stack", "mask"], "order", follow, keys, {"start": "bigint"}, used=["end"])
    return map_groups(rows.join(starts, keys), keys, "place", run, ["stack", "mask", "frame", "dy", "dx", "score", "visible_fraction", "signal"], {"state": "string"}, used=[*used, "start"])


def roi_crops(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(stack, frame, roi, y, x, v)``: every frame cut to each of its stack's boxes ``(stack, roi, x0, y0, x1, y1)``."""
    met = pixels(frames).join(boxes, "stack").where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return met.select("stack", "frame", "roi", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


def tracked_signals(tracks: DataFrame) -> DataFrame:
    """``(source_tiff, frame, mask_0, mask_1, ...)``: valid signals of every mask there is, and of the first three in any case."""
    rows = tracks.where("source_tiff is not null")
    there = sorted({0, 1, 2} | {r["mask_index"] for r in rows.where("mask_index is not null").select("mask_index").distinct().collect()})
    wide = rows.groupBy("source_tiff", "frame").pivot("mask_index", there).agg(F.max(F.when(F.col("tv"), F.col("sg"))))
    return wide.select("source_tiff", "frame", *(F.col(f"`{i}`").alias(f"mask_{i}") for i in there))
