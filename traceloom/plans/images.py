"""Registered queries over frames, masks, tracks and recordings, with the same in SQL.

The vectors of ``embeddings`` stand for frames of 8 by 8 pixels, their labels for stacks; tiles are 4 by 4 pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import scalars
from traceloom.operators import images
from traceloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _frames(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("embedding is not null and size(embedding) = 64")
    return rows.select(F.col("label").cast("bigint").alias("stack"), F.col("vec_id").alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").cast("array<double>").alias("pixels"))


def _mask(spark: SparkSession) -> DataFrame:
    """Two masks over an 8 by 8 frame: a square and a cross, with weights."""
    rows = [(1, y, x, 1.0) for y in range(1, 4) for x in range(1, 4)] + [(2, 5, x, 0.5) for x in range(4, 8)] + [(2, y, 6, 1.0) for y in (4, 6, 7)]
    return spark.createDataFrame(rows, "mask bigint, y bigint, x bigint, w double")


_P = """with px as (select cast(label as bigint) stack, vec_id frame, i // 8 as y, i % 8 as x, v::double v from (select label, vec_id, unnest(embedding) v, unnest(range(0, 64)) i from embeddings where embedding is not null and len(embedding) = 64)),
ml as (select * from (select 1::bigint mask, y, x, 1.0 w from range(1, 4) a(y), range(1, 4) b(x)) union all select 2, 5, x, 0.5 from range(4, 8) b(x) union all select 2, y, 6, 1.0 from (values (4), (6), (7)) c(y)),
"""


@query(_P + "z as (select stack, frame, (y // 4) * 2 + x // 4 + 1 roi, avg(v) m from px group by all) select stack, frame, roi, cast(m as float) as \"value\" from z")
def roi_means(spark, d):
    """Mean of each tile of each frame."""
    return images.roi_means(_frames(spark, d), 4, 8).withColumn("value", F.col("value").cast("float"))


@query(_P + "z as (select 1) select stack, y, x, cast(avg(v) as float) mean, cast(coalesce(stddev_samp(v), 0) as float) sd, cast(max(v) as float) top from px group by 1, 2, 3")
def projections(spark, d):
    """Mean, deviation and maximum of each pixel of a stack."""
    out = images.projections(_frames(spark, d))
    return out.select("stack", "y", "x", *(F.col(c).cast("float").alias(c) for c in ("mean", "sd", "top")))


_CORR = (
    _P
    + """mi as (select stack, y, x, avg(v) m from px group by 1, 2, 3),
c as (select stack, frame, least(greatest(coalesce(corr(v, m), case when avg(abs(v - m)) = 0 then 1 else 0 end), -1), 1) c, avg(abs(v - m)) df from px join mi using (stack, y, x) group by 1, 2),
k as (select c.*, md from c join (select stack, median(c) md from c group by 1) using (stack)), l as (select k.*, ma from k join (select stack, median(abs(c - md)) ma from k group by 1) using (stack))
"""
)


@query(_CORR + "select stack, frame, cast(c as float) correlation, cast(df as float) difference, c < md - 3 * 1.4826 * ma heavy_motion, row_number() over (partition by stack order by c, frame) rank from l")
def frame_correlation(spark, d):
    """Agreement of each frame with its stack's mean."""
    out = images.frame_correlation(_frames(spark, d))
    return out.select("stack", "frame", F.col("correlation").cast("float"), F.col("difference").cast("float"), "heavy_motion", "rank")


@query(_P + "z as (select stack, frame, mask, sum(v * w) / sum(w) m from px join ml using (y, x) group by 1, 2, 3) select stack, frame, mask, cast(m as float) as \"value\" from z")
def mask_means(spark, d):
    """Weighted mean under each mask."""
    return images.mask_means(_frames(spark, d), _mask(spark)).withColumn("value", F.col("value").cast("float"))


@query(
    _P
    + """tl as (select distinct mask, (y // 4) * 2 + x // 4 t from ml), gr as (select i // 8 y, i % 8 x from range(0, 64) r(i)),
bg as (select mask, y, x from gr join tl on t = (y // 4) * 2 + x // 4 where not exists(select 1 from ml where ml.y = gr.y and ml.x = gr.x)),
a as (select stack, frame, mask, sum(v * w) / sum(w) m from px join ml using (y, x) group by 1, 2, 3), b as (select stack, frame, mask, avg(v) g from px join bg using (y, x) group by 1, 2, 3)
select stack, frame, mask, cast(m - g as float) as "value" from a join b using (stack, frame, mask)"""
)
def mask_means_less_background(spark, d):
    """Weighted mean under each mask less the mean of the free pixels of its tiles."""
    frames, weights = _frames(spark, d), _mask(spark)
    back = images.mask_means(frames, images.background_weights(weights, 4, 8, "parent_tile")).withColumnRenamed("value", "g")
    own = images.mask_means(frames, weights).join(back, ["stack", "frame", "mask"])
    return own.select("stack", "frame", "mask", (F.col("value") - F.col("g")).cast("float").alias("value"))


_FG = (
    _P
    + """mi as (select stack, y, x, avg(v) m, (y // 4) * 2 + x // 4 + 1 tile from px group by 1, 2, 3), pc as (select stack, tile, quantile_cont(m, 0.6) p, min(m) lo, max(m) hi from mi group by 1, 2),
fg as (select stack, tile, y, x from mi join pc using (stack, tile) where hi > lo and (m > p or (p >= hi and m >= hi)))
"""
)


@query(_FG + "select * from fg")
def tile_foreground(spark, d):
    """Bright pixels of each tile of a stack's mean image."""
    mean = images.projections(_frames(spark, d)).select("stack", "y", "x", "mean")
    return images.tile_foreground(mean, 4, 8)


@query(
    _P
    + """mi as (select stack, y, x, avg(v) m, (y // 4) * 2 + x // 4 + 1 tile from px group by 1, 2, 3),
pc as (select stack, tile, quantile_cont(m, 0.8) p, median(m) md, avg(m) av, stddev_pop(m) sp, min(m) lo, max(m) hi from mi group by 1, 2), ma as (select stack, tile, median(abs(m - md)) mad from mi join pc using (stack, tile) group by 1, 2),
th as (select *, greatest(p, least(md + 1.0 * 1.4826 * mad, av + 1.0 * sp)) t from pc join ma using (stack, tile))
select stack, tile, y, x from mi join th using (stack, tile) where hi > lo and (m > t or (t >= hi and m >= hi))"""
)
def tile_brightest(spark, d):
    """The brightest pixels of each tile of a stack's mean image, by robust and plain deviations."""
    mean = images.projections(_frames(spark, d)).select("stack", "y", "x", "mean")
    return images.tile_foreground(mean, 4, 8, "brightest", brightest=0.8, factor=1.0)


@query()
def tile_otsu(spark, d):
    """Bright pixels of each tile by the split of its histogram."""
    return images.tile_foreground(images.projections(_frames(spark, d)).select("stack", "y", "x", "mean"), 4, 8, "otsu")


_CC = (
    _FG.replace("with px", "with recursive px")
    + """, rc as (select stack, tile, y, x, y * 1000000 + x c from fg union select f.stack, f.tile, f.y, f.x, rc.c from rc join fg f on f.stack = rc.stack and f.tile = rc.tile and abs(f.y - rc.y) <= 1 and abs(f.x - rc.x) <= 1),
cc as (select stack, tile, y, x, min(c) component from rc group by 1, 2, 3, 4)
"""
)


def _components(spark: SparkSession, d: str) -> DataFrame:
    return images.components(tile_foreground(spark, d), ["stack", "tile"])


@query(_CC + "select * from cc")
def tile_components(spark, d):
    """Connected bright pixels of each tile."""
    return _components(spark, d)


@query(_CC + "select stack, tile, component, count(*) area, min(x) x0, min(y) y0, max(x) + 1 x1, max(y) + 1 y1, cast(avg(x) as float) centre_x, cast(avg(y) as float) centre_y from cc group by 1, 2, 3 having count(*) between 2 and 9")
def component_records(spark, d):
    """Area, box and centre of each component of two to nine pixels."""
    out = _components(spark, d).groupBy("stack", "tile", "component").agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.avg("x").cast("float").alias("centre_x"), F.avg("y").cast("float").alias("centre_y")
    )
    return out.where("area between 2 and 9")


@query(
    _FG
    + """select stack, tile, y, x from fg where (select count(*) from fg g where g.stack = fg.stack and g.tile = fg.tile and abs(g.y - fg.y) <= 1 and abs(g.x - fg.x) <= 1) < 9"""
)
def mask_boundaries(spark, d):
    """Bright pixels with a neighbour that isn't one."""
    rows = tile_foreground(spark, d).select(F.concat_ws("/", "stack", "tile").alias("mask"), "y", "x")
    out = images.mask_boundary(rows)
    return out.select(F.split_part("mask", F.lit("/"), F.lit(1)).cast("bigint").alias("stack"), F.split_part("mask", F.lit("/"), F.lit(2)).cast("bigint").alias("tile"), "y", "x")


_RANGE = (
    _P
    + """a as (select stack, frame, quantile_cont(v, 0.005) a, quantile_cont(v, 0.995) b, min(v) lo, max(v) hi from px group by 1, 2),
b as (select stack, frame, case when b > a then a else lo end black, case when b > a then b else hi end white from a), dr as (select stack, frame, black, case when white > black then white else black + 1 end white from b)
"""
)


@query(_RANGE + "select stack, frame, cast(black as float) black, cast(white as float) white from dr")
def display_range(spark, d):
    """Black and white level of each frame."""
    out = images.display_range(_frames(spark, d))
    return out.select("stack", "frame", F.col("black").cast("float"), F.col("white").cast("float"))


@query(_RANGE + "select stack, frame, y, x, cast(least(greatest(round_even((v - black) / (white - black) * 255, 0), 0), 255) as int) as \"value\" from px join dr using (stack, frame)")
def frames_as_uint8(spark, d):
    """Frames scaled to 0..255 for display."""
    frames = _frames(spark, d)
    rows = images.pixels(frames).join(images.display_range(frames), ["stack", "frame"])
    return rows.select("stack", "frame", "y", "x", images.to_uint8(F.col("v"), F.col("black"), F.col("white")).alias("value"))


@query(_P + "z as (select 1) select stack, frame, y // 2 y, x // 2 x, cast(v as float) v from px where y % 2 = 0 and x % 2 = 0")
def previews(spark, d):
    """Every second row and column of a frame."""
    return images.thinned(_frames(spark, d), 4).withColumn("v", F.col("v").cast("float"))


@query(
    _P
    + """f as (select stack, frame, median(v) fill from px group by 1, 2)
select p.stack, p.frame, p.y, p.x, cast(coalesce(q.v, fill) as float) v from px p join f on f.stack = p.stack and f.frame = p.frame left join px q on q.stack = p.stack and q.frame = p.frame and q.y = p.y - 1 and q.x = p.x + 2"""
)
def shifted_frames(spark, d):
    """Frames moved one pixel down and two to the left."""
    frames = _frames(spark, d)
    shifts = frames.select("stack", "frame", F.lit(1).alias("dy"), F.lit(-2).alias("dx"))
    return images.shifted(frames, shifts).withColumn("v", F.col("v").cast("float"))


@query()
def motion_shifts(spark, d):
    """Shift of each frame against its stack's mean by phase correlation."""
    return images.motion_shifts(_frames(spark, d))


@query()
def motion_shifts_subpixel(spark, d):
    """Shift of each frame between pixels, after a high-pass, where the peak stands out."""
    return images.motion_shifts(_frames(spark, d), 2, subpixel=True, high_pass=1.0, least_ratio=1.05)


@query()
def motion_corrected_subpixel(spark, d):
    """Frames moved back by their shifts between pixels."""
    frames = _frames(spark, d)
    return images.shifted(frames, images.motion_shifts(frames, 2, subpixel=True).select("stack", "frame", "dy", "dx"))


@query()
def motion_corrected(spark, d):
    """Frames moved back by their shifts."""
    frames = _frames(spark, d)
    return images.shifted(frames, images.motion_shifts(frames).select("stack", "frame", "dy", "dx"))


def _tiles(frames: DataFrame) -> DataFrame:
    """Each stack's four tiles of 4 by 4."""
    layout = frames.select("stack", "width", "height").distinct()
    return images.roi_boxes(layout.select("*", F.lit(4).alias("box_width"), F.lit(4).alias("box_height"), F.lit(4).alias("roi_count")))


@query()
def residual_shifts(spark, d):
    """What is left of the shift of each tile after its frame has been moved as a whole."""
    frames = _frames(spark, d)
    return images.residual_shifts(images.residual_moved(frames, _tiles(frames)))


@query()
def residual_corrected(spark, d):
    """Frames moved as a whole and then tile by tile."""
    frames = _frames(spark, d)
    return images.pixels(images.residual_moved(frames, _tiles(frames))).withColumn("v", F.col("v").cast("float"))


_LAYOUT = """with l as (select source_tiff stack, max(width) w, max(height) h, max(roi_count) n, max(roi_sizes[1].w) bw, max(roi_sizes[1].h) bh from recordings where source_tiff is not null group by 1),
b as (select *, w // n cw from l where n > 0 and w % n = 0), bx as (select stack, cw, h, unnest(range(0, n)) i from b where cw > 0 and h > 0)
"""


@query(_LAYOUT + "select stack, cast(i + 1 as bigint) roi, cast(i * cw as bigint) x0, 0::bigint y0, cast((i + 1) * cw as bigint) x1, cast(h as bigint) y1 from bx")
def roi_layout(spark, d):
    """Boxes of the regions of each stack: equal tiles side by side."""
    rows = table(spark, d, "recordings").where("source_tiff is not null").groupBy(F.col("source_tiff").alias("stack")).agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max("roi_count").alias("roi_count"))
    rows = rows.where("roi_count > 0 and width % roi_count = 0 and height > 0 and width >= roi_count")
    return images.roi_boxes(rows.select("*", F.expr("width div roi_count").alias("box_width"), F.col("height").alias("box_height")))


@query(
    """with r as (select distinct recording_id, comment, sampling_rate_hz from recordings),
k as (select *, try_cast(regexp_extract(comment, '(?i)(\\d+(?:\\.\\d+)?)\\s*(k(?:ilo)?hz|k(?:ilo)?hertz|hz|hertz)\\b', 1) as double) * case when regexp_matches(regexp_extract(comment, '(?i)(\\d+(?:\\.\\d+)?)\\s*(k(?:ilo)?hz|k(?:ilo)?hertz|hz|hertz)\\b', 2), '(?i)^k') then 1000 else 1 end said from r)
select recording_id, max(case when said > 0 then said end) said_hz, max(case when isfinite(sampling_rate_hz) then sampling_rate_hz end) given_hz from k group by 1"""
)
def sampling_rate_in_text(spark, d):
    """Sampling rate of each recording as its comment says and as it is given."""
    rows = table(spark, d, "recordings").select("recording_id", scalars.hertz_in(F.col("comment")).alias("said"), scalars.finite(F.col("sampling_rate_hz")).alias("given"))
    return rows.groupBy("recording_id").agg(F.max("said").alias("said_hz"), F.max("given").alias("given_hz"))


@query(
    """with r as (select source_tiff, max(width) w, max(height) h, max(roi_count) n, max(try_cast(raw_fields['Width'] as int)) fw, max(try_cast(raw_fields['Height'] as int)) fh, max(try_cast(raw_fields['RoiCount'] as int)) fn, max(len(roi_sizes)) ns, max(len(roi_indices)) ni from recordings where source_tiff is not null group by 1)
select source_tiff, coalesce(w = fw, false) width_ok, coalesce(h = fh, false) height_ok, coalesce(n = fn, false) count_ok, coalesce(ns = n or ns = 1, false) sizes_ok, coalesce(ni = n, false) indices_ok from r"""
)
def sidecar_checks(spark, d):
    """Whether the parsed fields of a recording agree with its sidecar text and with each other."""
    def number(key):
        return F.max(F.col("raw_fields")[key].try_cast("int"))

    rows = table(spark, d, "recordings").where("source_tiff is not null").groupBy("source_tiff").agg(
        F.max("width").alias("w"), F.max("height").alias("h"), F.max("roi_count").alias("n"), number("Width").alias("fw"), number("Height").alias("fh"), number("RoiCount").alias("fn"), F.max(F.size("roi_sizes")).alias("ns"), F.max(F.size("roi_indices")).alias("ni")
    )
    ok = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "source_tiff",
        ok(F.col("w") == F.col("fw")).alias("width_ok"),
        ok(F.col("h") == F.col("fh")).alias("height_ok"),
        ok(F.col("n") == F.col("fn")).alias("count_ok"),
        ok((F.col("ns") == F.col("n")) | (F.col("ns") == 1)).alias("sizes_ok"),
        ok(F.col("ni") == F.col("n")).alias("indices_ok"),
    )


_TRACKS = "with t as (select source_tiff, mask_index, frame, any_value(valid_frame) vf, any_value(trace_valid) tv, min(case when isfinite(signal) then signal end) sg, min(dx) dx, min(dy) dy, min(cumulative_dx) cx, min(cumulative_dy) cy, min(case when isfinite(tracking_score) then tracking_score end) sc, bool_or(used_rescue) ur from frame_tracks group by 1, 2, 3)\n"


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    number = lambda c: F.min(scalars.finite(F.col(c)))
    return table(spark, d, "frame_tracks").groupBy("source_tiff", "mask_index", "frame").agg(
        F.any_value("valid_frame").alias("vf"), F.any_value("trace_valid").alias("tv"), number("signal").alias("sg"), F.min("dx").alias("dx"), F.min("dy").alias("dy"), F.min("cumulative_dx").alias("cx"), F.min("cumulative_dy").alias("cy"), number("tracking_score").alias("sc"), F.bool_or("used_rescue").alias("ur")
    )


@query(_TRACKS + "select source_tiff, mask_index, count(*) frames, count(*) filter (vf) valid_frames, count(*) filter (ur) rescued, cast(avg(sc) as float) mean_score, max(abs(cx)) most_dx, max(abs(cy)) most_dy, cast(avg(sg) filter (tv) as float) mean_signal from t group by 1, 2")
def track_summary(spark, d):
    """Frames, valid and rescued ones, score, farthest shift and mean signal of each mask."""
    return _tracks(spark, d).groupBy("source_tiff", "mask_index").agg(
        F.count("*").alias("frames"), F.count_if("vf").alias("valid_frames"), F.count_if("ur").alias("rescued"), F.avg("sc").cast("float").alias("mean_score"), F.max(F.abs("cx")).alias("most_dx"), F.max(F.abs("cy")).alias("most_dy"), F.avg(F.when(F.col("tv"), F.col("sg"))).cast("float").alias("mean_signal")
    )


@query(_TRACKS + "select source_tiff, frame, max(sg) filter (mask_index = 0 and tv) mask_0, max(sg) filter (mask_index = 1 and tv) mask_1, max(sg) filter (mask_index = 2 and tv) mask_2 from t where source_tiff is not null group by 1, 2")
def tracked_signals(spark, d):
    """Signals of all masks side by side by frame; the first three always have a column, as in the SQL."""
    return images.tracked_signals(_tracks(spark, d))


@query(
    """with f as (select source_tiff, frame, any_value(signals) sg from signal_frames group by 1, 2), u as (select source_tiff, frame, unnest(sg) v, unnest(range(1, len(sg) + 1)) roi from f), a as (select source_tiff, frame, roi, case when isfinite(v) then v end v from u)
select source_tiff, roi, count(v) n, cast(median(v) as float) f0, cast(max(v) as float) peak from a group by 1, 2"""
)
def roi_signal_summary(spark, d):
    """Count, median and peak of each region's signal."""
    once = table(spark, d, "signal_frames").groupBy("source_tiff", "frame").agg(F.any_value("signals").alias("sg"))
    rows = once.select("source_tiff", F.posexplode("sg").alias("i", "v")).select("source_tiff", (F.col("i") + 1).cast("bigint").alias("roi"), scalars.finite(F.col("v")).alias("v"))
    return rows.groupBy("source_tiff", "roi").agg(F.count("v").alias("n"), F.percentile("v", F.lit(0.5)).cast("float").alias("f0"), F.max("v").cast("float").alias("peak"))


@query(
    """with s as (select distinct file_id, station, saved_at, excel_path from sessions), k as (select *, row_number() over (partition by station, excel_path order by saved_at desc, file_id desc) n from s)
select station, excel_path, file_id, saved_at from k where n = 1"""
)
def latest_sessions(spark, d):
    """The session saved last for each workbook of a station."""
    rows = table(spark, d, "sessions").groupBy("file_id", "station", "excel_path", "saved_at").count()
    return rows.groupBy("station", "excel_path").agg(F.max_by(F.struct("file_id", "saved_at"), F.struct("saved_at", "file_id")).alias("x")).select("station", "excel_path", "x.file_id", "x.saved_at")


@query(
    _P
    + """te as (select stack, y, x, avg(v) t from px group by 1, 2, 3), tm as (select stack, mask, te.y, te.x, t from te join ml using (y, x)),
mv as (select stack, mask, t, y + dy y, x + dx x, dy, dx from tm, range(-1, 2) a(dy), range(-1, 2) b(dx)),
sc as (select px.stack, frame, mask, dy, dx, count(*) visible, avg(v) signal, case when count(*) >= 2 and stddev_pop(t) > 1e-9 and stddev_pop(v) > 1e-9 then corr(t, v) else avg(v) end score
  from mv join px on px.stack = mv.stack and px.y = mv.y and px.x = mv.x group by 1, 2, 3, 4, 5),
k as (select *, row_number() over (partition by stack, frame, mask order by round(score, 9) desc, dy, dx) n from sc)
select stack, frame, mask, dy, dx, cast(score as float) score, visible, cast(signal as float) signal from k where n = 1"""
)
def mask_shifts(spark, d):
    """Where each mask fits each frame best within one pixel."""
    out = images.mask_shifts(_frames(spark, d), _mask(spark), 1)
    return out.select("stack", "frame", "mask", F.col("dy").cast("bigint"), F.col("dx").cast("bigint"), F.col("score").cast("float"), "visible", F.col("signal").cast("float"))


@query(
    _P
    + """mi as (select stack, y, x, avg(v) m from px group by 1, 2, 3), df as (select px.stack, frame, px.y, px.x, v - m e from px join mi using (stack, y, x)),
l as (select stack, frame, greatest(quantile_cont(abs(e), 0.99), 1e-9) lim from df group by 1, 2), s as (select df.*, least(greatest(e / lim, -1), 1) q from df join l using (stack, frame))
select stack, frame, y, x, cast(sign(q) * pow(abs(q), 0.85) as float) as "value" from s"""
)
def difference_maps(spark, d):
    """Each frame's difference from its stack's mean as a diverging map."""
    each = images.pixels(_frames(spark, d))
    mean = each.groupBy("stack", "y", "x").agg(F.avg("v").alias("m"))
    gap = each.join(mean, ["stack", "y", "x"]).withColumn("e", F.col("v") - F.col("m"))
    limit = gap.groupBy("stack", "frame").agg(F.greatest(F.percentile(F.abs("e"), F.lit(0.99)), F.lit(1e-9)).alias("limit"))
    return gap.join(limit, ["stack", "frame"]).select("stack", "frame", "y", "x", images.difference_map(F.col("e"), F.col("limit")).cast("float").alias("value"))


@query(
    """with s as (select distinct file_id, station, excel_path, pipeline_config from sessions where json_valid(pipeline_config)),
k as (select file_id, json_extract_string(pipeline_config, '$.active_preset') preset, json_extract(pipeline_config, '$.ordered_step_ids') st from s where json_type(pipeline_config) = 'OBJECT'),
u as (select file_id, preset, unnest(from_json(st, '["varchar"]')) step, unnest(range(1, cast(json_array_length(st) as bigint) + 1)) position from k where json_type(st) = 'ARRAY')
select file_id, preset, step, position from u"""
)
def session_steps(spark, d):
    """The ordered pipeline steps of each session, where they are saved as a list."""
    rows = table(spark, d, "sessions").select("file_id", "pipeline_config").dropDuplicates(["file_id"])
    rows = rows.withColumn("c", F.from_json("pipeline_config", "active_preset string, ordered_step_ids string", {"mode": "PERMISSIVE"})).where("try_parse_json(pipeline_config) is not null")
    steps = F.from_json("c.ordered_step_ids", "array<string>")
    listed = rows.where(F.col("c.ordered_step_ids").startswith("["))
    out = listed.select("file_id", F.col("c.active_preset").alias("preset"), F.posexplode(steps).alias("i", "step"))
    return out.select("file_id", "preset", "step", (F.col("i") + 1).cast("bigint").alias("position"))


@query()
def tracked_masks(spark, d):
    """Masks followed from frame to frame."""
    return images.tracked_masks(_frames(spark, d), _mask(spark))


@query(_P + "z as (select 1) select stack, frame, cast((y // 4) * 2 + x // 4 + 1 as bigint) roi, y % 4 y, x % 4 x, cast(v as float) v from px")
def roi_crops(spark, d):
    """Frames cut into their tiles."""
    frames = _frames(spark, d)
    layout = frames.select("stack", "width", "height").distinct().select("*", F.lit(4).alias("box_width"), F.lit(4).alias("box_height"), F.lit(4).alias("roi_count"))
    return images.roi_crops(frames, images.roi_boxes(layout)).withColumn("v", F.col("v").cast("float"))


@query()
def shared_template_shifts(spark, d):
    """Shift of each frame against a mean image that is refined once."""
    return images.motion_shifts(_frames(spark, d), 2, "mean", 2)


@query()
def tile_first_shifts(spark, d):
    """Shift of each tile against its first frame."""
    frames = _frames(spark, d)
    layout = frames.select("stack", "width", "height").distinct().select("*", F.lit(4).alias("box_width"), F.lit(4).alias("box_height"), F.lit(4).alias("roi_count"))
    return images.tile_shifts(frames, images.roi_boxes(layout), 4, 4, 1)


@query(
    _FG
    + """, mw as (select stack, tile, y, x, m w from fg join mi using (stack, tile, y, x) where m > 0)
select stack || '/' || tile mask, count(*) pixel_count, cast(sum(w) as float) weight_sum, min(x) x0, min(y) y0, max(x) + 1 x1, max(y) + 1 y1, cast(sum(x * w) / sum(w) as float) centre_x, cast(sum(y * w) / sum(w) as float) centre_y from mw group by 1"""
)
def mask_records(spark, d):
    """Size, box and weighted centre of the bright pixels of each tile, weighted by their brightness."""
    mean = images.projections(_frames(spark, d)).select("stack", "y", "x", F.col("mean").alias("w"))
    weights = tile_foreground(spark, d).join(mean, ["stack", "y", "x"]).select(F.concat_ws("/", "stack", "tile").alias("mask"), "y", "x", "w")
    out = images.mask_records(weights)
    return out.select("mask", "pixel_count", F.col("weight_sum").cast("float"), "x0", "y0", "x1", "y1", F.col("centre_x").cast("float"), F.col("centre_y").cast("float"))


@query(
    """with c as (select source_tiff, max(frame) + 1 n from signal_frames where source_tiff is not null and frame is not null group by 1),
u as (select source_tiff, n, unnest(range(0, least(n, 7))) i from c)
select distinct source_tiff, cast(round_even(i * (n - 1) / 6.0, 0) as bigint) frame from u"""
)
def sampled_frames(spark, d):
    """Seven frames of each stack, spread evenly."""
    counts = table(spark, d, "signal_frames").where("source_tiff is not null and frame is not null").groupBy("source_tiff").agg((F.max("frame") + 1).alias("n"))
    return counts.select("source_tiff", F.explode(images.sample_frames(F.col("n"), 7)).alias("frame"))


@query(_P + "n as (select stack, frame, y, x, v, dense_rank() over (partition by stack order by frame) - 1 page from px) select stack, page, y, x, cast(v as float) v from n")
def stack_round_trip(spark, d):
    """Stacks written as image files by the executors and read again, page by page."""
    from traceloom.plans.traces import _scratch
    from traceloom.sources import stacks

    folder = _scratch(spark, "stacks")
    written = stacks.write_stacks(_frames(spark, d), folder)
    written.count()
    back = stacks.read_stacks(spark, folder)
    named = back.select(F.regexp_extract("path", r"([^/]+)\.tif$", 1).cast("bigint").alias("stack"), "frame", "height", "width", "pixels")
    return images.pixels(named).select("stack", F.col("frame").alias("page"), "y", "x", F.col("v").cast("float").alias("v"))
