"""Registered queries of the frame, detection and event operators over the fixture tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.frames import colour_bars, colour_bars_planes, gray8, micros, pattern, rgb8, table
from framelake.operators import color, detect, events, geometry, grades, histogram, hud, packed, recorder, sequence, stencil, temporal, tone
from framelake.plans import chain
from framelake.ship import shared_folder
from framelake.sources import bitstream, containers

QUERIES = {}
RGB = ("r", "g", "b")


def query(f):
    QUERIES[f.__name__] = f
    return f


def on_rgb(name: str, f) -> None:
    """Registers f(rgb frames)."""
    QUERIES[name] = lambda spark, d: f(rgb8(spark, d))


def on_gray(name: str, f) -> None:
    QUERIES[name] = lambda spark, d: f(gray8(spark, d))


def leveled(rows: DataFrame, planes: list[str]) -> DataFrame:
    """8 by 8 frames of rows (f, planes): each plane an array of 64 numbers, laid out in Arrow without a row for each pixel."""
    def run(batches):
        for b in batches:
            v = np.stack([b.column(n).flatten().to_numpy().astype(np.float64).reshape(-1, 64) for n in planes], axis=-1)
            data = np.floor(np.clip((v + 0.6) / 1.2 * 255, 0, 255) + 0.5).astype(np.uint8)
            size = lambda k: pa.array([k] * b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("f"), size(8), size(8), size(len(planes)), pa.array([x.tobytes() for x in data], pa.binary())], ["f", "w", "h", "c", "data"])
    return packed.arrow_pass(rows, ["f", *planes], run, f"f long, {packed.FRAME}")


def gray_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames of gray8 as rows."""
    return leveled(table(spark, d, "embeddings").select(F.col("vec_id").alias("f"), F.col("embedding").alias("v")), ["v"])


def rgb_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames of rgb8 as rows."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("f"), (F.col("vec_id") % 3).alias("c"), "embedding")
    r, g, b = (e.where(F.col("c") == i).select("f", F.col("embedding").alias(n)) for i, n in enumerate("rgb"))
    return leveled(r.join(g, "f").join(b, "f"), ["r", "g", "b"])


def on_gray_frames(name: str, f) -> None:
    """Registers the pixels of gray frames with f applied to stacks."""
    QUERIES[name] = lambda spark, d: packed.unpack(packed.map_frames(gray_frames(spark, d), f), ("v",))


def on_rgb_frames(name: str, f) -> None:
    QUERIES[name] = lambda spark, d: packed.unpack(packed.map_frames(rgb_frames(spark, d), f))


# Flagship: denoise, grade, summarise.
@query
def flagship(spark: SparkSession, d: str) -> DataFrame:
    clean = packed.unpack(packed.map_frames(gray_frames(spark, d), packed.bilateral(kernel=3)), ("v",))
    px = tone.brightness_contrast(clean, 20.0, 1.2)
    h = histogram.histogram(px, ["f"])
    rank = F.row_number().over(Window.partitionBy("f").orderBy(F.desc("n"), "v"))
    return h.withColumn("rank", rank).where(F.col("rank") <= 5)


def pix(spark: SparkSession, d: str) -> DataFrame:
    """(r, g, b): one pixel for each line item."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") * 37 % 256).cast("int").alias("g"), (F.col("l_orderkey") * 91 % 256).cast("int").alias("b"))


def planes(spark: SparkSession, d: str) -> DataFrame:
    return color.rgb_to_planes(rgb8(spark, d))


# Sources.
@query
def s03_extension(spark, d):
    url = F.split(F.col("url"), "[?#]")[0]
    return table(spark, d, "pages").select("page_id", bitstream.extension(url).alias("ext"), bitstream.container(url).alias("container"))


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """(id, payload): document text with every 'e' followed by a space read as a start code."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.unhex(F.replace(F.hex("text"), F.lit("6520"), F.lit("000001"))).alias("payload"))


@query
def s04_units(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.encode(F.regexp_replace(F.regexp_replace("text", "[^ -~]", "#"), "e ", "\u0000\u0000\u0001"), "utf-8").alias("payload"))
    return bitstream.split_units(docs).select("id", "no", "type", "is_vcl", F.octet_length("unit").alias("n"))


@query
def s05_vcl(spark, d):
    return s04_units(spark, d).where("is_vcl").groupBy("id").agg(F.count("*").alias("n"), F.sum("n").cast("long").alias("bytes"))


def supplier_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(f, w, h): a frame for each supplier, of even sizes."""
    n = F.col("s_nationkey")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("f"), (4 + 2 * (n % 7)).cast("int").alias("w"), (2 + 2 * (n % 3)).cast("int").alias("h"))


@query
def s13_pattern(spark, d):
    return pattern(supplier_sizes(spark, d)).select("f", "y", "x", "v")


@query
def s14_bars(spark, d):
    return colour_bars(supplier_sizes(spark, d))


@query
def s14_bars_planes(spark, d):
    return colour_bars_planes(supplier_sizes(spark, d))


@query
def s15_fallback(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    return temporal.fallback(e, "user_id", "ts", 500_000).groupBy("user_id").agg(F.count_if("stale").alias("stale"), F.count("*").alias("n"))


@query
def s21_pcm16(spark, d):
    return table(spark, d, "events").select("event_id", bitstream.pcm16(F.col("value") / 100.0, 0.7).alias("sample"))


@query
def s22_edit_list(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("frame"), "event_type")
    of = lambda kind, text: e.where(F.col("event_type") == kind).select("frame", F.lit(text).alias("label"))
    return bitstream.edit_list(of("view", "take"), of("error", "cut"), of("purchase", "mark"))


@query
def s27_probe(spark, d):
    line = F.concat_ws(",", (F.col("p_size") * 16).cast("string"), (F.col("p_size") * 9).cast("string"), F.element_at(F.array(F.lit("h264"), F.lit("hevc"), F.lit("av1")), (F.col("p_partkey") % 3 + 1).cast("int")))
    p = bitstream.probe_line(line)
    return table(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in p.items()))


# Colour.
QUERIES["c01_planes_to_rgb"] = lambda s, d: color.planes_to_rgb(planes(s, d))
QUERIES["c02_planes_to_rgb_limited"] = lambda s, d: color.planes_to_rgb(planes(s, d), limited=True)
on_rgb("c03_rgb_to_planes", color.rgb_to_planes)
on_rgb("c04_rgb_to_planes_709", lambda p: color.rgb_to_planes(p, "709", True))
on_rgb("c05_rgb_to_planes_601", lambda p: color.rgb_to_planes(p, "601", True))
on_rgb("c06_matrix_by_height", lambda p: color.rgb_to_planes_by_height(p, 8))
on_rgb("c07_rgb_to_planes_integer", color.rgb_to_planes_integer)
on_rgb("c10_swap", color.swap_red_blue)
on_rgb("c11_pq_to_sdr", lambda p: color.pq_to_sdr(p, 100.0))
QUERIES["c12_yuy2"] = lambda s, d: color.pack_yuy2(planes(s, d))
on_rgb("c13_luminance", color.luminance)
on_rgb("c14_channels", lambda p: color.with_channel(p, "r", color.channel(p, "b")))

# Tone.
QUERIES["p01_brightness_contrast"] = lambda s, d: tone.brightness_contrast(pix(s, d), 12.0, 1.3).groupBy(*RGB).agg(F.count("*").alias("n"))
on_rgb("p02_saturation", lambda p: tone.saturation(p, 1.4))
on_rgb("p03_gamma", lambda p: tone.gamma(p, 0.8))
on_rgb("p04_white_balance", lambda p: tone.white_balance(p, 10.0, -5.0))
on_rgb("p05_vignette", lambda p: tone.vignette(p, 8, 8, 0.6))
on_rgb("p06_film_grain", lambda p: tone.film_grain(p, 20.0, 42))
on_rgb("p07_hdr_reinhard", lambda p: tone.hdr_reinhard(p, 120.0))
on_rgb("p08_hdr_aces", lambda p: tone.hdr_aces(p, 150.0))
on_rgb("p09_apply_lut", lambda p: tone.apply_lut(p, tone.lut(p.sparkSession, "warm"), strength=0.75))
@query
def p10_lut(spark, d):
    """The grid colours that customers stand for, in the look of their segment."""
    looks = tone.lut(spark, "cinematic").withColumn("preset", F.lit("cinematic")).unionByName(tone.lut(spark, "vintage").withColumn("preset", F.lit("vintage")))
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "cinematic").otherwise("vintage").alias("preset"), *(((k * m) % 17).cast("int").alias(n) for n, m in (("ri", 1), ("gi", 3), ("bi", 7))))
    return c.join(F.broadcast(looks), ["preset", "ri", "gi", "bi"]).select("c_custkey", "preset", *RGB)


on_rgb("p11_chroma_key", tone.chroma_key)
on_rgb("p12_composite", lambda p: tone.composite_alpha(p, color.swap_red_blue(p), p.select("f", "y", "x", (F.col("x") / 7.0).alias("a"))))
on_rgb("p13_blend", lambda p: tone.blend(p, p.withColumn("f", F.col("f") - 1), 0.3))
on_rgb("p14_relight", lambda p: tone.relight(p, color.luminance(p).withColumn("v", F.least(F.col("v") + 30, F.lit(255)))))
on_gray("p15_depth_to_gray", lambda p: tone.depth_to_gray(p, F.col("v") / 200.0))
on_gray("p16_flow_to_rgb", lambda p: tone.flow_to_rgb(p.withColumns({"dx": F.col("v") / 32.0 - 4, "dy": F.col("x") / 2.0 - 1.7})).select("f", "y", "x", *RGB))
QUERIES["p17_sigmoid"] = lambda s, d: table(s, d, "events").select("event_id", F.floor(tone.sigmoid(F.col("value") / 50.0 - 1) * 1e6).cast("long").alias("s"))

# Geometry.
on_rgb("g01_crop", lambda p: geometry.crop(p, 6, 5, 4, 2))
QUERIES["g02_crop_planes"] = lambda s, d: geometry.crop_planes(planes(s, d), 6, 6, 4, 2)
on_rgb("g03_pad", lambda p: geometry.pad(p, 8, 8, 2, 1, (10, 20, 30)))
on_rgb("g04_flip", lambda p: geometry.flip(geometry.flip(p, 8, 8, True), 8, 8, False))
on_rgb("g05_translate", lambda p: geometry.translate(p, 8, 8, 2, -1))
on_rgb("g06_lens", lambda p: geometry.lens(p, 8, 8, 0.2))
on_rgb("g07_resize_bilinear", lambda p: geometry.resize_bilinear(p, 8, 8, 12, 6))
on_rgb("g08_resize_bicubic", lambda p: geometry.resize_bicubic(p, 8, 8, 12, 6))
QUERIES["g09_resize_planes"] = lambda s, d: geometry.resize_planes(planes(s, d), 8, 8, 12, 6)
QUERIES["g09_resize_planes_cubic"] = lambda s, d: geometry.resize_planes(planes(s, d), 8, 8, 12, 6, True)
on_rgb("g10_resize_nearest", lambda p: geometry.resize_nearest(p, 8, 8, 5, 11))
on_rgb("g11_letterbox", lambda p: geometry.letterbox(geometry.crop_inside(p, 8, 4, 0, 2), 8, 4, 11, 11))
on_rgb("g12_crop_inside", lambda p: geometry.crop_inside(p, 4, 4, 2, 3))
on_rgb("g13_zoom", lambda p: geometry.zoom(p, 8, 8, 2.0))


@query
def g14_compose(spark, d):
    n = F.col("r_regionkey")
    layout = table(spark, d, "region").select(n.cast("int").alias("tile"), n.cast("long").alias("src_f"), ((n % 3) * 10).cast("int").alias("dst_x"), (F.floor(n / 3) * 9).cast("int").alias("dst_y"), F.lit(12).alias("tile_w"), F.lit(10).alias("tile_h"), (n != 2).alias("active"))
    return geometry.compose(gray8(spark, d), layout, 8, 8, 30, 20)


@query
def g14_compose_planes(spark, d):
    n = F.col("n_nationkey")
    layout = table(spark, d, "nation").select(n.cast("int").alias("tile"), (n * 3).cast("long").alias("src_f"), ((n % 5) * 12).cast("int").alias("dst_x"), (F.floor(n / 5) * 10).cast("int").alias("dst_y"), F.lit(12).alias("tile_w"), F.lit(10).alias("tile_h"), F.lit(True).alias("active"))
    return geometry.compose_planes(planes(spark, d), layout, 8, 8, 60, 50)


@query
def g15_grid(spark, d):
    c, r = geometry.grid_layout(F.col("n_nationkey") % 17)
    return table(spark, d, "nation").select("n_nationkey", c.alias("cols"), r.alias("rows"))


@query
def g16_pip_box(spark, d):
    w, h = (F.col("p_size") * 47).cast("int"), (F.col("p_partkey") % 1500).cast("int")
    return table(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in geometry.pip_box(w, h).items()))


@query
def g17_inset(spark, d):
    rgb = rgb8(spark, d)
    return geometry.inset(geometry.resize_nearest(rgb, 8, 8, 16, 16), rgb, 9, 9, 5, 4, 8, 8, 2)


@query
def g19_draw(spark, d):
    rgb = rgb8(spark, d)
    f = rgb.select("f").distinct()
    boxes = f.select("f", F.lit(1).alias("z"), (F.col("f") % 4).cast("int").alias("x1"), F.lit(1).alias("y1"), F.lit(6).alias("x2"), F.lit(5).alias("y2"), F.lit(255).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    discs = f.select("f", F.lit(1).alias("z"), F.lit(4).alias("cx"), (F.col("f") % 8).cast("int").alias("cy"), F.lit(2).alias("radius"), F.lit(0).alias("r"), F.lit(255).alias("g"), F.lit(9).alias("b"))
    return geometry.draw_discs(geometry.draw_boxes(rgb, boxes), discs)


on_rgb("g22_outline", lambda p: geometry.outline(p, 8, 8, F.col("f") % 2 == 0, 2))


@query
def g18_redirect_eyes(spark, d):
    rgb = rgb8(spark, d)
    eye = F.explode(F.array(F.lit(0), F.lit(1)))
    eyes = rgb.select("f").distinct().select("f", eye.alias("eye")).select("f", "eye", (F.col("eye") * 4 + 2).alias("cx"), F.lit(4).alias("cy"), F.lit(3.0).alias("er"), (F.col("f") % 3 - 1.0).alias("dx"), F.lit(0.5).alias("dy"), F.when(F.col("f") % 5 == 0, 0.3).otherwise(0.9).alias("score"))
    return packed.unpack(geometry.redirect_eyes_frames(rgb_frames(spark, d), eyes, 0.8))


@query
def g20_text_dots(spark, d):
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("f"), F.lit(0).alias("z"), F.lit(2).alias("x0"), F.lit(1).alias("y0"), F.concat_ws("-", F.col("p_partkey").cast("string"), "p_brand", F.lit("a.b c")).alias("text"))
    return geometry.text_dots(texts, 2).groupBy("f").agg(F.count_if("dot").alias("dots"), F.count("*").alias("cells"), F.sum(F.when(F.col("dot"), F.col("x") * 31 + F.col("y")).otherwise(0)).cast("long").alias("places"))


@query
def g20_draw_text(spark, d):
    rgb = rgb8(spark, d)
    return geometry.draw_text(rgb, rgb.select("f").distinct().select("f", F.lit(0).alias("z"), F.lit(1).alias("x0"), F.lit(2).alias("y0"), F.lit("h7").alias("text")), 1, (250, 240, 10), (5, 6, 7))


# Neighbourhoods.
on_gray_frames("n01_bilateral", packed.bilateral(15.0, 25.0, 5))
QUERIES["n02_denoise_planes"] = lambda s, d: stencil.denoise_planes(planes(s, d), 15.0, 25.0, 5)
on_gray_frames("n03_gaussian", packed.gaussian(2.0))
on_gray_frames("n04_sharpen", packed.sharpen(1.0))
on_rgb_frames("n05_edges", packed.edges())
on_gray_frames("n06_directional_blur", packed.directional_blur(30.0, 4))
on_gray("n09_block_motion", lambda p: stencil.block_motion(p, 4, 2, 2, 8, 8))
QUERIES["n01_bilateral_planes"] = lambda s, d: packed.unpack(packed.map_frames(packed.pack(gray8(s, d), 8, 8, ("v",)), packed.bilateral(15.0, 25.0, 5)), ("v",))
on_gray_frames("n07_background_blur", packed.background_blur(0.5, 0.5))
on_gray_frames("n08_double", packed.double(0.5))

# Histograms and reductions.
TABLE_SUMS = lambda t: t.groupBy("f", "ty", "tx").agg(F.count("*").alias("n"), F.sum("cdf").alias("total"), F.sum(F.col("cdf") * F.col("v")).alias("weighed"))
on_gray("a01_tile_tables", lambda p: TABLE_SUMS(histogram.tile_tables(p, 4, 3.0)))
on_gray("a01_tile_tables_wide", lambda p: TABLE_SUMS(histogram.tile_tables(p, 8, 12.0)))
on_rgb_frames("a03_equalise_rgb", grades.clahe(4, 40.0))
QUERIES["a03_equalise_planes"] = lambda s, d: histogram.equalise_planes(planes(s, d), 8, 8, 4, 40.0)
on_gray("a03_equalise", lambda p: histogram.equalise(p, 8, 8, 4, 3.0))
on_gray("a04_normalise_depth", lambda p: histogram.normalise_depth(p.select("f", "y", "x", F.when(F.col("v") == 200, F.lit(float("nan"))).otherwise(F.col("v") / 7.0).alias("d"))).select("f", "y", "x", F.floor(F.col("d") * 1000 + 1e-7).cast("int").alias("d")))
on_gray("a05_mean_motion", lambda p: histogram.mean_motion(stencil.block_motion(p, 4, 2, 2, 8, 8)))
on_gray("a06_sampled_mean", lambda p: histogram.sampled_mean(p, 8, 13).select("f", F.floor(F.col("mean") * 1000 + 1e-6).cast("long").alias("mean")))
on_rgb("a07_channel_stats", lambda p: histogram.channel_stats(p).select("f", "c", "lo", "hi", F.floor(F.col("mean") * 1000 + 1e-6).cast("long").alias("mean")))
on_gray("a08_mean_absolute_error", lambda p: histogram.mean_absolute_error(p, p.withColumn("f", F.col("f") - 1)).select("f", F.floor(F.col("mae") * 1000 + 1e-6).cast("long").alias("mae")))
on_gray("a09_matte_stats", lambda p: histogram.matte_stats(p, (2, 2, 5, 5)).select("f", "mass", "x1", "y1", "x2", "y2", F.floor(F.col("inside") * 1000 + 1e-6).cast("long").alias("inside"), F.floor(F.col("outside") * 1000 + 1e-6).cast("long").alias("outside")))
QUERIES["a10_throughput"] = lambda s, d: histogram.throughput(table(s, d, "events"), "user_id", "ts").select("user_id", "n", "ms", F.floor(F.col("fps") * 1e6 + 1e-6).cast("long").alias("ufps"))
QUERIES["a12_peak"] = lambda s, d: histogram.peak(table(s, d, "events"), "user_id", "value")

# Time.
on_gray("t01_fir_denoise", lambda p: temporal.fir_denoise(p, 0.3))
on_gray("t02_iir_denoise", lambda p: temporal.iir_denoise(p, 0.3))
on_gray("t03_ring", lambda p: temporal.ring(p, 5).select("f", "y", "x", *(F.element_at("window", i + 1).alias(f"v{i}") for i in range(5))))
on_gray("t04_stabilise", lambda p: temporal.stabilise(histogram.mean_motion(stencil.block_motion(p, 4, 4, 2, 8, 8)).withColumn("camera", F.floor(F.col("f") / 25)), 0.8))
on_gray("t05_interpolate", temporal.interpolate)
on_gray("t06_with_previous", temporal.with_previous)


def stream(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, t_ms, seq, kind, v): samples of each user in order."""
    return table(spark, d, "events").select("user_id", F.floor(micros("ts") / 1000).alias("t_ms"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.floor("value").cast("int").alias("v"))


@query
def t07_auto_frame(spark, d):
    b = lines_as_boxes(spark, d).withColumn("score", F.col("score") % 1000 / 1000.0).withColumnRenamed("frame", "f")
    return temporal.auto_frame(b.withColumn("camera", F.col("f") % 50), 640, 480, "camera")


QUERIES["t08_every_nth"] = lambda s, d: temporal.every_nth(stream(s, d), "user_id", "seq", "v", 3).select("user_id", "seq", "cached")
QUERIES["t09_as_of"] = lambda s, d: temporal.as_of(table(s, d, "events").where("event_type = 'purchase'"), table(s, d, "events").where("event_type = 'view'"), "user_id", "ts", "event_id", "value").select("user_id", "event_id", "value_as_of")
QUERIES["t10_pace"] = lambda s, d: temporal.pace(stream(s, d), "user_id", ["seq"], "t_ms", 100_000)
QUERIES["t11_hysteresis"] = lambda s, d: temporal.hysteresis(stream(s, d), "user_id", ["seq"], "v", 40, 90, 2)
QUERIES["t12_quiet_runs"] = lambda s, d: temporal.runs_of(stream(s, d), "user_id", ["seq"], F.col("v") <= 50).select("user_id", "seq", "run")
QUERIES["t13_breaker"] = lambda s, d: temporal.breaker(stream(s, d).withColumn("ok", F.col("kind") == "purchase"), "user_id", ["seq"], "t_ms", "ok", 2_000_000, 9).select("user_id", "seq", "open")
QUERIES["t14_display_order"] = lambda s, d: temporal.display_order(stream(s, d), "user_id", "seq").select("user_id", "seq", "display_no")


# Detection.
#: Rows that a part sorts or joins, about; more rows make more parts, not larger ones.
PART_ROWS = 1 << 20


def line_parts(spark: SparkSession, d: str) -> int:
    """Parts for the line items: the session's number, more if there are many (a count that reads no column)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, d, "lineitem").count() // PART_ROWS))


def lines_as_boxes(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").repartition(line_parts(spark, d), "l_orderkey")
    no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    x, y = (F.col("l_partkey") * 7 % 600).cast("int"), (F.col("l_suppkey") * 13 % 440).cast("int")
    w, h = (20 + F.col("l_partkey") % 160).cast("int"), (20 + F.col("l_orderkey") % 120).cast("int")
    return l.select(F.col("l_orderkey").alias("frame"), no.alias("box"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("score"), F.col("l_linenumber").alias("cls"))


QUERIES["m15_suppress"] = lambda s, d: detect.suppress(lines_as_boxes(s, d).withColumns({"x1": F.col("x1") % 100, "x2": F.col("x1") % 100 + 150}), 0.45, 5)


@query
def m01_best_class(spark, d):
    b = lines_as_boxes(spark, d)
    return detect.best_class(b.select(F.col("frame"), "cls", F.col("score").alias("score")), ["frame"], 2_000_000)


@query
def m01_unletterbox(spark, d):
    return detect.unletterbox(lines_as_boxes(spark, d).select("frame", "box", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))), 0.5, 0.0, 80.0, 640, 480)


@query
def m01_detections(spark, d):
    b = lines_as_boxes(spark, d)
    share = lambda k: (F.col("score") * k % 101 / 128.0)
    cells = b.select("frame", F.col("box").alias("cell"), (F.col("x1") % 300 + 20).alias("cx"), (F.col("y1") % 200 + 120).alias("cy"), (F.col("x2") - F.col("x1") + 100).alias("bw"), (F.col("y2") - F.col("y1") + 100).alias("bh"), F.array(share(1), share(7), share(11)).alias("scores"))
    return detect.detections(cells, 0.5, 0.0, 80.0, 640, 480, 0.35, 0.45, 3).select("frame", "box", "rank", *(F.floor(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")), "score", "cls")


@query
def m02_decode_points(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("frame"), F.lit(16).alias("stride"), (F.col("user_id") % 16).cast("int").alias("i"), (F.col("value") / 50 - 1).alias("cls"), F.lit(2.0).alias("obj"), (F.col("event_id") % 7 / 8.0).alias("dx"), F.lit(0.25).alias("dy"), (F.col("event_id") % 5 / 4.0).alias("lw"), F.lit(0.5).alias("lh"))
    return detect.decode_points(e, detect.point_priors(spark, 64), 0.4).select("frame", *(F.floor(F.col(c) * 1000 + 1e-6).cast("long").alias(c) for c in ("score", "x1", "y1", "x2", "y2")))


def palm_windows(spark: SparkSession, d: str) -> DataFrame:
    b = lines_as_boxes(spark, d)
    raw = b.select("frame", F.col("box").alias("anchor"), (F.col("x1") % 60).alias("x"), (F.col("y1") % 90).alias("y"), (F.col("x2") - F.col("x1") - 24).alias("bw"), (F.col("y2") - F.col("y1") - 24).alias("bh"), (F.col("score") % 1001 / 100 - 4).alias("logit"))
    return detect.hands(raw, 640, 480)


QUERIES["m03_hands"] = lambda s, d: palm_windows(s, d).withColumn("score", F.floor(F.col("score") * 1e6 + 1e-3).cast("long"))


@query
def m03_hand_joints(spark, d):
    windows = palm_windows(spark, d)
    points = windows.select("frame", "hand", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("joint")).select("frame", "hand", "joint", (F.col("joint") / 8.0).alias("x"), (F.col("joint") * 7.0).alias("y"))
    return detect.hand_joints(points, windows).select("frame", "hand", "joint", *(F.floor(F.col(c) * 1000 + 1e-6).cast("long").alias(c) for c in ("x", "y")))


@query
def m08_work_size(spark, d):
    w, h = (64 + F.col("p_partkey") * 37 % 4000).cast("int"), (48 + F.col("p_partkey") * 91 % 2200).cast("int")
    dw, dh = detect.work_size(w, h)
    return table(spark, d, "part").select("p_partkey", dw.alias("dw"), dh.alias("dh"))


on_rgb("m09_blur_behind", lambda p: detect.blur_behind(p, p.where("x < 4 and y < 4").select("f", "y", "x", ((F.col("r") + F.col("g")) / 512.0).alias("a")), 4, 4, 8, 8, 2.0))
QUERIES["m05_pose"] = lambda s, d: detect.pose(table(s, d, "events").select("event_id", (F.col("value") * 2.0).alias("x"), (F.col("value") / 64.0).alias("y"), (F.col("value") / 50 - 1).alias("vis"), F.lit(2.0).alias("pres"))).select("event_id", *(F.floor(F.col(c) * 1e6 + 1e-3).cast("long").alias(c) for c in ("x", "y", "visibility")))
on_gray("m07_resize_flow", lambda p: geometry.resize_flow(p.select("f", "y", "x", (F.col("v") / 8.0).alias("dx"), (F.col("x") - 4.0).alias("dy")), 8, 8, 12, 4))
QUERIES["m02_point_priors"] = lambda s, d: table(s, d, "events").select("event_id", F.element_at(F.array(F.lit(8), F.lit(16), F.lit(32)), (F.col("event_id") % 3 + 1).cast("int")).alias("stride"), (F.col("user_id") % 16).cast("int").alias("i")).join(F.broadcast(detect.point_priors(s, 64)), ["stride", "i"])
QUERIES["m04_eye_windows"] = lambda s, d: detect.eye_windows(lines_as_boxes(s, d)).select("frame", "box", "eye", *(F.floor(F.col(c) * 100 + 1e-6).cast("long").alias(c) for c in ("cx", "cy", "radius")))
QUERIES["m12_with_class"] = lambda s, d: detect.with_class(lines_as_boxes(s, d).select("frame", "box", (F.col("cls") * 13 % 90 - 2).cast("int").alias("cls")))
QUERIES["m13_label_place"] = lambda s, d: lines_as_boxes(s, d).select("frame", "box", detect.label_place(F.col("y1"), F.col("y2"), 480).cast("int").alias("at"))


@query
def m14_iou(spark, d):
    b = lines_as_boxes(spark, d)
    box = lambda n: F.struct(*(F.col(f"{n}.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
    j = b.alias("a").join(b.alias("b"), F.expr("a.frame = b.frame and a.box < b.box"))
    return j.select(F.col("a.frame").alias("frame"), F.col("a.box").alias("p"), F.col("b.box").alias("q"), F.floor(detect.iou(box("a"), box("b")) * 1e6 + 1e-6).cast("long").alias("iou"))


# Events.
def hands(spark: SparkSession, d: str) -> DataFrame:
    """(hand, joint, x, y): 21 points from the first 42 components of each embedding."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("hand"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("joint"))
    at = lambda i: F.floor((F.element_at("embedding", i).cast("double") + 0.6) * 500).cast("int")
    return e.select("hand", "joint", at(F.col("joint") + 1).alias("x"), at(F.col("joint") + 22).alias("y"))


QUERIES["e01_gesture"] = lambda s, d: events.gesture(hands(s, d))
QUERIES["e14_hand_shape"] = lambda s, d: events.hand_shape(hands(s, d)).select("hand", *(F.floor(F.col(c) * 1000 + 1e-6).cast("long").alias(c) for c in ("cx", "cy", "pinch")), "pointing")
QUERIES["e02_best_hand"] = lambda s, d: events.best_hand(lines_as_boxes(s, d).select("frame", F.col("box").alias("hand"), (F.col("score") % 1000 / 1000.0).alias("score")), "frame")
QUERIES["e03_holds"] = lambda s, d: events.holds(stream(s, d), "user_id", ["seq"], "t_ms", "kind")
QUERIES["e03_gesture_actions"] = lambda s, d: events.gesture_actions(stream(s, d), "user_id", ["seq"], "t_ms", "kind", {"click": 1, "view": 60_000}, 3_600_000)
QUERIES["e04_segments"] = lambda s, d: events.segments(stream(s, d).withColumn("idr", F.col("kind") == "view"), "user_id", ["seq"], "idr", 5, 9)


def spans(spark: SparkSession, d: str) -> DataFrame:
    s = stream(spark, d).withColumns({"cut": F.col("kind") == "error", "idr": F.col("kind") == "view"})
    return events.cut_spans(s, "user_id", "seq", "cut", "idr")


@query
def e05_cut_spans(spark, d):
    return spans(spark, d).withColumn("end", F.coalesce("end", F.lit(-1)))


@query
def e10_without_spans(spark, d):
    return events.without_spans(stream(spark, d).where("kind = 'click'").select("user_id", "seq"), spans(spark, d), "user_id", "seq")


QUERIES["e06_last_kept"] = lambda s, d: events.last_kept(stream(s, d).where("kind = 'view'"), "user_id", "seq").select("user_id", "seq", "v")
QUERIES["e07_marks"] = lambda s, d: events.marks(stream(s, d).where("kind = 'purchase'"), "user_id", ["seq"], F.lit(True)).select("user_id", "seq", "label")
QUERIES["e07_paused"] = lambda s, d: events.paused(stream(s, d), "user_id", ["seq"], F.col("kind") == "signup").select("user_id", "seq", "paused")
QUERIES["e08_long_enough"] = lambda s, d: events.long_enough(stream(s, d), ["user_id", "kind"], 10)


@query
def e09_audio_gate(spark, d):
    kind = F.col("kind")
    return events.audio_gate(stream(spark, d), "user_id", ["seq"], kind == "signup", kind == "error", (kind == "purchase") & (F.col("v") > 60), (kind == "click") & (F.col("v") > 70), kind == "view").select("user_id", "seq", "open")


QUERIES["e11_measured_fps"] = lambda s, d: stream(s, d).groupBy("user_id").agg(events.measured_fps(F.count("*"), (F.max("seq") - F.min("seq")) / 400.0).alias("fps"))
QUERIES["e12_voice_gain"] = lambda s, d: table(s, d, "events").select("event_id", F.floor(events.voice_gain(-F.col("value")) * 1000).cast("long").alias("gain"))
QUERIES["e13_debounce"] = lambda s, d: events.debounce(stream(s, d), "user_id", ["seq"], F.col("v") > 50)


@query
def e15_aim_hand(spark, d):
    s = stream(spark, d)
    hand = lambda kind, k: F.when(F.col("kind") != kind, F.struct((F.col("v") * k % 101).alias("x"), (F.col("seq") * k % 89).alias("y")))
    d = s.withColumns({"a": hand("click", 3), "b": hand("view", 7)}).withColumn("b", F.when(F.col("kind") != "error", F.col("b"))).withColumn("a", F.when(F.col("kind") != "error", F.col("a")))
    return events.aim_hand(d, "user_id", ["seq"], "a", "b").withColumn("aim", F.coalesce("aim", F.lit(-1)))


def aims(spark: SparkSession, d: str, **how) -> DataFrame:
    s = stream(spark, d).withColumn("w", F.col("v") / 128.0)
    return events.smooth_aim(s, "user_id", ["seq"], "w", 0.5, 0.0625, 1.5, 0.375, **how).select("user_id", "seq", F.floor(F.col("aim") * 1000 + 1e-6).cast("long").alias("aim"))


QUERIES["e16_smooth_aim"] = aims
QUERIES["e16_relative_aim"] = lambda s, d: aims(s, d, relative=True)
QUERIES["e17_flicks"] = lambda s, d: events.flicks(stream(s, d).withColumn("h", F.col("v") / 100.0), "user_id", ["seq"], "t_ms", "h", 0.185, 3, 800_000)
QUERIES["e19_zones"] = lambda s, d: table(s, d, "events").select("event_id", *(c.alias(n) for c, n in zip(events.zones(F.col("value") / 100 - 0.5, F.col("value") / 200 - 0.2), ("zone", "lean"))))
QUERIES["e18_palm_hold"] = lambda s, d: events.palm_hold(stream(s, d), "user_id", ["seq"], "t_ms", F.col("v") > 40, 600_000, 2_000_000).select("user_id", "seq", "tap", "kill")
QUERIES["e19_move_keys"] = lambda s, d: table(s, d, "events").select("event_id", *(c.alias(n) for n, c in events.move_keys(F.col("value") / 100 - 0.5, F.col("event_id") % 8 / 8.0 - 0.5, F.col("value") % 1.0).items()))
QUERIES["e19_crouched"] = lambda s, d: events.crouched(stream(s, d), "user_id", ["seq"], F.col("v") / 100.0 - 0.25, 3).select("user_id", "seq", "crouch")


@query
def e20_score(spark, d):
    s = stream(spark, d).withColumns({"fire": F.col("kind") != "error", "hit": F.col("v") % 3 != 0, "lost": (F.col("v") > 97).cast("int")})
    return events.score(s, "user_id", ["seq"], "t_ms", "fire", "hit", "lost", 4, 900_000)


@query
def e20_hits(spark, d):
    s = stream(spark, d)
    shots = s.where("kind = 'click'").select("user_id", F.col("seq").alias("shot"), F.col("v").alias("x"), (F.col("seq") % 100).alias("y"))
    targets = s.where("kind = 'purchase'").select("user_id", F.col("seq").alias("target"), F.col("v").alias("tx"), (F.col("seq") * 7 % 100).alias("ty"))
    return events.hits(shots, targets, "user_id", 20.0)


QUERIES["e21_window_matches"] = lambda s, d: table(s, d, "part").select("p_partkey", events.window_matches(F.col("p_name"), "A", "self").alias("ok"))
QUERIES["e20_wave_targets"] = lambda s, d: events.wave_targets(table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 12 + 1).alias("wave")), "wave", F.col("c_custkey")).select(
    "c_custkey", "wave", F.col("target").cast("int").alias("target"), *(F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in ("x", "y", "r", "vx", "vy")))
QUERIES["e20_drift"] = lambda s, d: events.drift(stream(s, d).withColumn("dt", F.col("v") / 64.0), "user_id", ["seq"], "dt", F.lit(0.5), F.lit(16.0), 64, 0.0625, 0.9375).select(
    "user_id", "seq", F.floor(F.col("at") * 4096).cast("long").alias("at"), F.col("v").cast("int").alias("v"))
QUERIES["e22_spawn"] = lambda s, d: table(s, d, "customer").select("c_custkey", F.posexplode(events.spawn(F.col("c_custkey"), 4)).alias("i", "n"))
QUERIES["e23_bitrate"] = lambda s, d: table(s, d, "part").select("p_partkey", events.bitrate(F.col("p_size") * 40, F.col("p_size") * 22, F.lit(30)).alias("kbps"))


# Plans.
@query
def x01_file_chain(spark, d):
    spec = chain.parse_flags("--crop w=6 h=6 left=1 top=1 --gamma g=0.9 --saturation factor=1.2 --flip", 8, 8)
    return chain.compile_chain(spec, rgb8(spark, d))


@query
def x01_frame_chain(spark, d):
    """Steps that look at neighbours or change the grid, in one pass over frames."""
    spec = chain.Spec(8, 8, "file", {"crop": {"w": 8, "h": 6, "left": 0, "top": 1}, "pad": {"px_x": 1, "px_y": 2, "colour": (9, 8, 7)}, "super_res": {"strength": 0.5}, "sharpen": {"strength": 1.0}, "white_balance": {"temperature": 8.0, "tint": 2.0}})
    return packed.unpack(chain.compile_frames(spec, rgb_frames(spark, d)))


def cameras(frames: DataFrame) -> DataFrame:
    """frames with a camera for each 25 of them."""
    return frames.withColumn("camera", F.floor(F.col("f") / 25))


@query
def x02_live_chain(spark, d):
    spec = chain.Spec(8, 8, "live", {"temporal": {"strength": 0.25}, "brightness_contrast": {"contrast": 1.1}, "grain": {}})
    return packed.unpack(chain.compile_frames(spec, cameras(rgb_frames(spark, d))))


@query
def x01_recursive_chain(spark, d):
    """The file chain's temporal step mixes with the chain's own last output."""
    spec = chain.Spec(8, 8, "file", {"temporal": {"strength": 0.25}, "flip": {}})
    return packed.unpack(chain.compile_frames(spec, cameras(rgb_frames(spark, d))))


@query
def s24_batch_matrix(spark, d):
    of = lambda **steps: chain.Spec(8, 8, "file", steps)
    specs = {"plain": of(), "warm": of(white_balance={"temperature": 8.0, "tint": 2.0}), "flipped": of(flip={}), "small": of(scale={"w": 4, "h": 2, "how": "nearest"})}
    return packed.unpack(chain.batch_matrix(rgb_frames(spark, d), specs), keys={"config": "string", "f": "long"})


# Layouts, regions, windows and carried state.
def tensor_values(tensors: DataFrame) -> DataFrame:
    return packed.samples(tensors).select("f", "i", F.floor(F.col("v") * 1e6 + 0.5).cast("long").alias("v"))


QUERIES["g21_planar"] = lambda s, d: tensor_values(packed.to_tensors(rgb_frames(s, d)))
QUERIES["g21_signed_bgr"] = lambda s, d: tensor_values(packed.to_tensors(rgb_frames(s, d), "nhwc", "signed", bgr=True))
QUERIES["g21_interleaved"] = lambda s, d: tensor_values(packed.interleaved(packed.to_tensors(rgb_frames(s, d), "nchw", "raw")))
QUERIES["g21_back"] = lambda s, d: packed.unpack(packed.from_tensors(packed.to_tensors(rgb_frames(s, d), "nchw", "signed"), "nchw", "signed"))


@query
def m03_crops(spark, d):
    """Two squares of each frame, brought to 4 by 4."""
    hand = F.explode(F.array(F.lit(0), F.lit(1))).alias("hand")
    w = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("frame")).distinct().select("frame", hand).select("frame", "hand", (F.col("frame") % 3 + F.col("hand")).cast("int").alias("left"), (F.col("frame") % 2).cast("int").alias("top"), (2 + 2 * F.col("hand")).alias("side"))
    return packed.unpack(detect.hand_crops(rgb_frames(spark, d), w, 4), keys={"f": "long", "id": "long"})


@query
def m04_gaze(spark, d):
    faces = lines_as_boxes(spark, d)
    places = detect.eye_places(faces, 640, 480)
    points = places.select("frame", "id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("point")).withColumns({"x": (F.col("frame") * 7 + F.col("id") * 5 + F.col("point") * 3) % 80 / 1.0, "y": (F.col("frame") * 3 + F.col("point") * 8) % 64 / 1.0})
    return detect.gaze(points, places, parts=line_parts(spark, d)).select("frame", "id", *(F.floor(F.col(c) * 1000 + 1e-6).cast("long").alias(c) for c in ("cx", "cy", "er", "dx", "dy")), "score")


def brightest(window: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """A stand-in for a denoiser: the brightest of five frames, lifted by the noise map."""
    return window.reshape(5, 3, *window.shape[2:]).max(0)[None] + noise


QUERIES["m08_five_frames"] = lambda s, d: packed.unpack(sequence.map_windows(cameras(rgb_frames(s, d)), sequence.denoised(lambda: brightest), 5, block=8))


def peak_hold(tensor: np.ndarray, states: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A stand-in for a recurrent matting model: red, held at its highest so far."""
    held = np.maximum(tensor[0, 0], states[0][0, 0])
    return held, [held[None, None], *states[1:]]


QUERIES["t16_matting"] = lambda s, d: packed.unpack(sequence.recurrent(cameras(rgb_frames(s, d)), sequence.matted(lambda: peak_hold, (8, 8), sigma=0.5)))


@query
def s02_written_frames(spark, d):
    """Frames written as samples and read again by ranges of them."""
    containers.register(spark)
    at = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    gray_frames(spark, d).select(F.col("f").alias("no"), F.col("data").alias("unit")).write.format(containers.NAME).mode("append").save(at)
    back = spark.read.format(containers.NAME).option("bytesPerPartition", 4096).load(at)
    frames = back.select(F.col("no").alias("f"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(1).alias("c"), F.col("unit").alias("data"))
    return packed.unpack(frames, ("v",))


# Displays and recordings.
@query
def g23_trainer(spark, d):
    """What the display of each supplier's game covers, as sums: the topmost cell at each place."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    target = lambda i: F.struct(((k + i * 3) % 10 / 10.0).alias("nx"), ((k + i * 5) % 10 / 10.0).alias("ny"), F.lit(6.5 + 3 * i).alias("r"), ((k + i) % 4 != 0).alias("alive"), ((k + i) % 2 / 2.0).alias("flash"))
    state = table(spark, d, "supplier").select(
        k.alias("f"), (k * 37).alias("score"), (100 - n).alias("health"), (k % 13).alias("ammo"), (k % 5 == 0).alias("reloading"), (F.abs("s_acctbal") / 100).alias("time"), (k % 9).alias("wave"), (k % 4).alias("combo"), (k % 7).alias("best"),
        F.element_at(F.array(*map(F.lit, ("play", "idle", "pause", "over"))), (k % 4 + 1).cast("int")).alias("phase"), F.when(k % 3 != 0, n / 25.0).alias("aim_x"), F.when(k % 3 != 0, k % 8 / 8.0).alias("aim_y"), F.array(*map(target, range(3))).alias("targets"))
    top = hud.top_cells(hud.trainer(state, 240, 100), 240, 100)
    return top.groupBy("f").agg(F.count("*").alias("n"), F.sum(F.col("x") * 31 + F.col("y")).alias("places"), *(F.sum(F.col(c) * (F.col("x") + 1)).alias(c) for c in RGB))


def takes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Recordings of each user: views are frames that others don't depend on, clicks others; errors cut, signups take the last segment back, some purchases mark or pause."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "idr").when(F.col("event_type") == "error", "cut").when(F.col("event_type") == "signup", "cut_prev").when((F.col("event_type") == "purchase") & (F.col("value") > 60), "mark").when(
        (F.col("event_type") == "purchase") & (F.col("value") > 55), "pause").otherwise("frame")
    return recorder.recording(e.select("user_id", "event_id", (F.floor(micros("ts") / 1000) / 1000.0).alias("t"), kind.alias("kind")), "user_id", "event_id", target=4, least=2)


QUERIES["e05_recorder_segments"] = lambda s, d: takes(s, d)["segments"]
QUERIES["e06_recorder_cuts"] = lambda s, d: takes(s, d)["cuts"].select("user_id", "start", "end", "live", *(F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in ("t0", "t1")))
QUERIES["e10_recorder_snips"] = lambda s, d: recorder.coalesced(takes(s, d)["snips"], "user_id").select("user_id", *(F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in ("a", "b")))


# Byte streams and settings.
def pieces(spark: SparkSession, d: str) -> DataFrame:
    """(id, p): the pieces of each text between "e " with printable letters only, empty ones left out."""
    clean = F.split(F.regexp_replace("text", "[^ -~]", "#"), "e ")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.filter(clean, lambda p: p != "").alias("p"))


def byte_rows(spark: SparkSession, d: str, head: str, each) -> DataFrame:
    """(id, payload): hex digits `head`, then each(piece) in hex digits, for every piece of a text."""
    p = pieces(spark, d)
    return p.select("id", F.unhex(F.concat(F.lit(head), F.array_join(F.transform("p", each), ""))).alias("payload"))


def little(n, width: int):
    """An integer as `width` little-endian bytes in hex digits."""
    big = F.lpad(F.hex(n), 2 * width, "0")
    return F.concat(*(F.substring(big, 2 * i + 1, 2) for i in reversed(range(width))))


@query
def s06_start_codes(spark, d):
    rows = byte_rows(spark, d, "", lambda p: F.concat(F.lpad(F.hex(F.length(p)), 8, "0"), F.hex(p)))
    return bitstream.reframe(rows).select("id", F.octet_length("payload").alias("n"), F.md5("payload").alias("digest"))


@query
def s08_ivf(spark, d):
    rows = byte_rows(spark, d, "444B4946" + "00" * 28, lambda p: F.concat(little(F.length(p), 4), F.lit("00" * 8), F.hex(p)))
    return bitstream.split_ivf(rows).select("id", "no", F.decode("unit", "utf-8").alias("piece"))


@query
def s11_raw_frames(spark, d):
    payload = F.encode(F.rpad(F.regexp_replace("text", "[^ -~]", "#"), 120, "."), "utf-8")
    frames = bitstream.raw_frames(table(spark, d, "documents").select(F.col("doc_id").alias("id"), payload.alias("payload")), 4, 2)
    return frames.select("id", "no", F.decode("unit", "utf-8").alias("unit"))


@query
def s23_concatenate(spark, d):
    s = stream(spark, d).select("user_id", "seq", (F.col("kind") != "error").alias("kept"), F.encode("kind", "utf-8").alias("unit"))
    return bitstream.concatenate(s, "user_id", "seq", "unit").select("user_id", F.md5("payload").alias("digest"))


QUERIES["a11_rate"] = lambda s, d: temporal.rate(stream(s, d).withColumn("dt", F.col("v") / 40.0), "user_id", ["seq"], "dt").select("user_id", "seq", F.floor(F.col("rate") * 1e6 + 1e-3).cast("long").alias("rate"))


@query
def e24_settings(spark, d):
    text = F.concat(F.lit("name="), "p_name", F.lit("\n# size=0\nsize = "), F.col("p_size").cast("string"), F.lit("\n\nname="), "p_brand", F.lit("=x"))
    m = events.settings(text)
    return table(spark, d, "part").select("p_partkey", m["name"].alias("name"), m["size"].alias("size"), F.size(m).alias("n"))


@query
def e25_progress(spark, d):
    line = F.concat(F.lit("frame= "), F.col("v").cast("string"), F.lit(" fps="), (F.col("v") / 4.0).cast("string"), F.lit(" q=1"))
    s = stream(spark, d).select("user_id", "seq", F.when(F.col("kind") == "error", F.lit("failed")).otherwise(line).alias("line"))
    return events.progress(s, "user_id", "seq", "line", 20).select("user_id", "seq", F.coalesce("frame", F.lit(-1)).alias("frame"), F.coalesce("fps", F.lit(-1.0)).alias("fps"))


QUERIES["x09_readiness"] = lambda s, d: table(s, d, "part").select("p_partkey", chain.readiness(F.col("p_size") > 10, F.col("p_size") > 30).cast("int").alias("ready"))
