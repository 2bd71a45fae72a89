"""Byte streams as rows: start-code splitting, length-prefixed framing, containers, raw frames, WAV and edit lists."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, extension, content) of whole files; a file has to fit in a row."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", basename(F.col("path")).alias("name"), extension(F.col("path")).alias("extension"), "content")


def basename(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/\\\\]*)$", 1), "\\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./\\\\]+)$", 1))


def container(path: Column) -> Column:
    """The reader a file's extension asks for."""
    e = extension(path)
    return F.when(e.isin(".mp4", ".mov", ".m4v"), "mp4").when(e.isin(".mkv", ".webm", ".ivf"), "mkv").otherwise("raw")


def codec_id(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.isin("av1"), 0x31).when(n.isin("hevc", "h265"), 0x23).otherwise(0x21)


def probe_line(line: Column) -> dict[str, Column]:
    """width, height and codec number of a probe's comma-separated line."""
    p = F.split(line, ",")
    return {"width": F.try_element_at(p, F.lit(1)).try_cast("int") if hasattr(Column, "try_cast") else F.try_element_at(p, F.lit(1)).cast("int"),
            "height": F.try_element_at(p, F.lit(2)).try_cast("int") if hasattr(Column, "try_cast") else F.try_element_at(p, F.lit(2)).cast("int"),
            "codec": codec_id(F.coalesce(F.try_element_at(p, F.lit(3)), F.lit("h264")))}


def _units(data: bytes) -> list[bytes]:
    """Payloads between 00 00 01 start codes (a zero before one belongs to the code)."""
    starts, at = [], data.find(b"\0\0\1")
    while at >= 0:
        starts.append(at)
        at = data.find(b"\0\0\1", at + 3)
    out = []
    for a, b in zip(starts, [*starts[1:], len(data)]):
        end = b - 1 if b < len(data) and b > a + 3 and data[b - 1] == 0 else b
        if end > a + 3:
            out.append(data[a + 3:end])
    return out


#: Units, or bytes of them, whichever come first, that a worker holds before it hands them on.
UNITS, UNIT_BYTES = 8192, 1 << 20


def _explode(df: DataFrame, id: str, payload: str, cut) -> DataFrame:
    """(id, no, unit): what cut makes of each payload. A worker holds one payload's units and a bounded batch, however many there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, no, units, size = [], [], [], 0

            def rows() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array(no, pa.int32()), pa.array(units, pa.binary())], ["id", "no", "unit"])
            for i, p in enumerate(b.column(1)):
                for n, x in enumerate(cut(p.as_buffer().to_pybytes()) if p.is_valid else ()):
                    owner.append(i)
                    no.append(n)
                    units.append(x)
                    size += len(x)
                    if len(owner) >= UNITS or size >= UNIT_BYTES:
                        yield rows()
                        owner, no, units, size = [], [], [], 0
            if owner:
                yield rows()
    conf, most = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(most)) <= 256:
        conf.set(most, "256")
    kind = df.schema[id].dataType.simpleString()
    return df.select(id, payload).mapInArrow(run, f"id {kind}, no int, unit binary")


def unit_type(unit: Column, h265: bool = False) -> Column:
    first = F.conv(F.hex(F.substring(unit, 1, 1)), 16, 10).cast("int")
    return F.shiftright(first, 1).bitwiseAND(0x3F) if h265 else first.bitwiseAND(0x1F)


def split_units(df: DataFrame, id: str = "id", payload: str = "payload", h265: bool = False) -> DataFrame:
    """(id, no, type, is_vcl, unit): units between three- or four-byte start codes, the last one whole."""
    u = _explode(df, id, payload, _units).withColumn("type", unit_type(F.col("unit"), h265))
    vcl = F.col("type") < 32 if h265 else F.col("type").between(1, 5)
    return u.select("id", "no", "type", vcl.alias("is_vcl"), "unit")


def vcl_units(units: DataFrame) -> DataFrame:
    return units.where("is_vcl")


def is_key_unit(type_: Column, h265: bool = False) -> Column:
    return type_.isin(19, 20) if h265 else type_ == 5


def parameter_sets(units: DataFrame, h265: bool = False) -> DataFrame:
    """Parameter-set units that stand before the first picture unit of their stream."""
    kinds = (32, 33, 34) if h265 else (7, 8)
    first = units.where("is_vcl").groupBy("id").agg(F.min("no").alias("_first"))
    return units.where(F.col("type").isin(*kinds)).join(first, "id", "left").where(F.col("_first").isNull() | (F.col("no") < F.col("_first"))).drop("_first")


def length_to_start_codes(data: bytes) -> bytes:
    """Units behind four-byte big-endian lengths as units behind start codes; a length past the end stops."""
    out, at = bytearray(), 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + n > len(data):
            break
        out += b"\0\0\0\1" + data[at + 4:at + 4 + n]
        at += 4 + n
    return bytes(out)


def reframe(df: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    """(id, payload) with start codes instead of lengths."""
    return _explode(df, id, payload, lambda p: [length_to_start_codes(p)]).select("id", F.col("unit").alias("payload"))


def avc_parameter_sets(data: bytes) -> list[bytes]:
    """Sequence and picture parameter sets of an avcC record."""
    out, at = [], 6
    if len(data) < 7:
        return out
    for n in (data[5] & 31, None):
        if n is None:
            n, at = (data[at], at + 1) if at < len(data) else (0, at)
        for _ in range(n):
            size = int.from_bytes(data[at:at + 2], "big")
            out.append(data[at + 2:at + 2 + size])
            at += 2 + size
    return out


def hevc_parameter_sets(data: bytes) -> list[bytes]:
    """Video, sequence and picture parameter sets (types 32 to 34) of an hvcC record."""
    out, at = [], 23
    for _ in range(data[22] if len(data) > 22 else 0):
        if at + 3 > len(data):
            break
        kind, n, at = data[at] & 63, int.from_bytes(data[at + 1:at + 3], "big"), at + 3
        for _ in range(n):
            size = int.from_bytes(data[at:at + 2], "big")
            if at + 2 > len(data) or at + 2 + size > len(data):
                break
            if kind in (32, 33, 34):
                out.append(data[at + 2:at + 2 + size])
            at += 2 + size
    return out


def with_parameter_sets(records: DataFrame, samples: DataFrame, hevc: bool = False) -> DataFrame:
    """(id, no, unit): a file's samples (id, no, unit) after the parameter sets of its record (id, payload), numbered from 0."""
    sets = _explode(records, "id", "payload", hevc_parameter_sets if hevc else avc_parameter_sets).select("id", F.lit(0).alias("_part"), "no", "unit")
    both = sets.unionByName(samples.select("id", F.lit(1).alias("_part"), "no", "unit"))
    no = F.row_number().over(Window.partitionBy("id").orderBy("_part", "no")) - 1
    return both.select("id", no.alias("no"), "unit")


def ivf_frames(data: bytes) -> list[tuple[int, bytes]]:
    """(pts, frame) of an IVF file: 32-byte header, then little-endian sizes and 8-byte times."""
    if data[:4] != b"DKIF":
        return []
    out, at = [], 32
    while at + 12 <= len(data):
        n, pts = struct.unpack_from("<IQ", data, at)
        if at + 12 + n > len(data):
            break
        out.append((pts, data[at + 12:at + 12 + n]))
        at += 12 + n
    return out


def split_ivf(df: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    return _explode(df, id, payload, lambda p: [x for _, x in ivf_frames(p)])


def mp4_boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes in data[at:end]."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at:at + 4], "big"), data[at + 4:at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8:at + 16], "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def mp4_video(data: bytes) -> tuple[float, list[bytes]] | None:
    """(frames a second, samples) of the first video track, if the file has one."""
    def find(path: list[bytes], a: int, b: int) -> tuple[int, int] | None:
        for kind, s, e in mp4_boxes(data, a, b):
            if kind == path[0]:
                return (s, e) if len(path) == 1 else find(path[1:], s, e)
        return None

    u32 = lambda i: int.from_bytes(data[i:i + 4], "big")
    moov = find([b"moov"], 0, len(data))
    for kind, s, e in mp4_boxes(data, *moov) if moov else ():
        handler = find([b"mdia", b"hdlr"], s, e) if kind == b"trak" else None
        if not handler or data[handler[0] + 8:handler[0] + 12] != b"vide":
            continue
        table = find([b"mdia", b"minf", b"stbl"], s, e)
        head = find([b"mdia", b"mdhd"], s, e)
        sizes, chunks, runs = (find([n], *table) for n in (b"stsz", b"stco", b"stsc"))
        wide = chunks is None
        chunks = chunks or find([b"co64"], *table)
        if not (head and sizes and chunks and runs):
            return None
        v = data[head[0]]
        scale, length = (u32(head[0] + 20), int.from_bytes(data[head[0] + 24:head[0] + 32], "big")) if v == 1 else (u32(head[0] + 12), u32(head[0] + 16))
        n, same = u32(sizes[0] + 8), u32(sizes[0] + 4)
        size = [same or u32(sizes[0] + 12 + 4 * i) for i in range(n)]
        step = 8 if wide else 4
        offset = [int.from_bytes(data[chunks[0] + 8 + step * i:chunks[0] + 8 + step * (i + 1)], "big") for i in range(u32(chunks[0] + 4))]
        plan = [(u32(runs[0] + 8 + 12 * i), u32(runs[0] + 12 + 12 * i)) for i in range(u32(runs[0] + 4))]
        out, i = [], 0
        for c, at in enumerate(offset, 1):
            for _ in range([k for first, k in plan if first <= c][-1]):
                if i < n:
                    out.append(data[at:at + size[i]])
                    at, i = at + size[i], i + 1
        return (n * scale / length if length else 0.0), out
    return None


def split_mp4(df: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    """(id, no, unit): samples of each file's first video track."""
    return _explode(df, id, payload, lambda p: (mp4_video(p) or (0, []))[1])


def raw_frames(df: DataFrame, w: int, h: int, id: str = "id", payload: str = "payload") -> DataFrame:
    """(id, no, unit): raw luma and half-size chroma frames; a payload that isn't a whole number of frames raises."""
    n = w * h * 3 // 2
    size = F.octet_length(payload)
    ok = F.when(size % n == 0, size).otherwise(F.raise_error(F.lit("payload is not a whole number of frames")).cast("int"))
    at = F.explode(F.when(ok > 0, F.sequence(F.lit(0), F.floor(ok / n).cast("int") - 1)).otherwise(F.array().cast("array<int>")))
    return df.select(id, payload, at.alias("no")).select(F.col(id).alias("id"), "no", F.substring(payload, 1, 1).alias("_u"), F.expr(f"substring(`{payload}`, no * {n} + 1, {n})").alias("unit")).drop("_u")


def pcm16(v: Column, gain: float = 1.0) -> Column:
    """A float sample with gain, cut to -1..1, as a 16-bit integer towards zero."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * gain)) * 32767
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")


def wav_header(samples: int, rate: int = 48000, channels: int = 1) -> bytes:
    n = samples * channels * 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", n)


def edit_list(segments: DataFrame, cuts: DataFrame, marks: DataFrame, fps: float = 30.0) -> DataFrame:
    """(type, frame, time_s, label) lines of a recording, in order of frames."""
    rows = (segments.select(F.lit("segment").alias("type"), "frame", "label")
            .unionByName(cuts.select(F.lit("cut").alias("type"), "frame", "label")).unionByName(marks.select(F.lit("mark").alias("type"), "frame", "label")))
    return rows.select("type", "frame", F.format_string("%.2f", F.col("frame") / F.lit(fps)).alias("time_s"), "label")


def write_edit_list(rows: DataFrame, path: str) -> None:
    rows.orderBy("frame", "type").coalesce(1).write.csv(path, header=True)


def concatenate(segments: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """(key, payload): kept segments of a recording joined in order; a recording has to fit in a row."""
    s = F.array_sort(F.collect_list(F.struct(order, F.hex(payload).alias("h"))))
    return segments.where("kept").groupBy(key).agg(F.unhex(F.concat_ws("", F.transform(s, lambda x: x["h"]))).alias("payload"))
