"""Containers as a data source: files are split by ranges of samples, and written frames appear whole or not at all.

    register(spark)
    spark.read.format("framelake.samples").load("/videos")                       # mp4, mov, m4v, ivf, and folders that frames were written to
    spark.read.format("framelake.samples").option("w", 64).option("h", 48).load("/videos/a.yuv")   # raw luma and half-size chroma
    frames.write.format("framelake.samples").mode("append").save("/out")         # (no, unit)

A plan reads indexes only: the tables of an MP4 file, the frame headers of an IVF file, the size of a raw one, the list
of parts of a written folder. A partition is a range of samples of one file, which its task seeks and reads one by one.
Paths may be of any file system that Arrow opens.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, no long, pts long, unit binary"
NAME = "framelake.samples"
#: Files that a written folder holds: parts of samples one after another, each with its index, and the list of parts that count.
MANIFEST = "_parts.json"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    """Files of a path that isn't a written folder, in order; names that begin with _ or . are passed over."""
    from pyarrow import fs

    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class Sample:
    """A sample's place in its file."""

    no: int
    pts: int
    start: int
    size: int


@dataclass
class Range(InputPartition):
    """Samples of one file that a task reads."""

    path: str
    name: str
    samples: list[tuple[int, int, int, int]]


def _boxes(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes between two places of a file; only their headers are read."""
    while at + 8 <= end:
        f.seek(at)
        head = f.read(16)
        size, kind, skip = int.from_bytes(head[:4], "big"), head[4:8], 8
        if size == 1:
            size, skip = int.from_bytes(head[8:16], "big"), 16
        size = size or end - at
        if size < skip or at + size > end:
            return
        yield kind, at + skip, at + size
        at += size


def _within(f, path: tuple[bytes, ...], at: int, end: int) -> tuple[int, int] | None:
    for kind, a, b in _boxes(f, at, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else _within(f, path[1:], a, b)
    return None


def mp4_index(f, length: int) -> list[Sample]:
    """Samples of the first video track, with decoding times in the track's units, from its tables alone."""
    def table(name: bytes, item: str, head: int = 4) -> list[tuple] | None:
        found = _within(f, (name,), *stbl)
        if found is None:
            return None
        f.seek(found[0] + head)
        (n,) = struct.unpack(">I", f.read(4))
        return list(struct.iter_unpack(item, f.read(n * struct.calcsize(item))))

    moov = _within(f, (b"moov",), 0, length)
    for kind, a, b in _boxes(f, *moov) if moov else ():
        handler = _within(f, (b"mdia", b"hdlr"), a, b) if kind == b"trak" else None
        if not handler:
            continue
        f.seek(handler[0] + 8)
        if f.read(4) != b"vide":
            continue
        stbl = _within(f, (b"mdia", b"minf", b"stbl"), a, b)
        if not stbl:
            return []
        at = _within(f, (b"stsz",), *stbl)
        chunks = table(b"stco", ">I") or table(b"co64", ">Q")
        runs, times = table(b"stsc", ">III"), table(b"stts", ">II")
        if not (at and chunks and runs):
            return []
        f.seek(at[0] + 4)
        same, n = struct.unpack(">II", f.read(8))
        sizes = [same] * n if same else [x for (x,) in struct.iter_unpack(">I", f.read(4 * n))]
        steps = (d for count, d in times or [] for _ in range(count))
        out, no, pts, run = [], 0, 0, 0
        for c, (start,) in enumerate(chunks, 1):
            while run + 1 < len(runs) and runs[run + 1][0] <= c:
                run += 1
            for _ in range(runs[run][1]):
                if no < n:
                    out.append(Sample(no, pts, start, sizes[no]))
                    start, no, pts = start + sizes[no], no + 1, pts + next(steps, 0)
        return out
    return []


def ivf_index(f, length: int) -> list[Sample]:
    """Frames of an IVF file: little-endian sizes and 8-byte times, walked from header to header; a frame that isn't whole ends the walk."""
    f.seek(0)
    if f.read(4) != b"DKIF":
        return []
    out, at = [], 32
    while at + 12 <= length:
        f.seek(at)
        size, pts = struct.unpack("<IQ", f.read(12))
        if at + 12 + size > length:
            break
        out.append(Sample(len(out), pts, at + 12, size))
        at += 12 + size
    return out


class SamplesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.frame = int(options.get("w", 0)) * int(options.get("h", 0)) * 3 // 2
        self.bytes = int(options.get("bytesperpartition", 64 << 20))

    def _index(self, system, path: str) -> list[Sample]:
        kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
        with system.open_input_file(path) as f:
            length = f.size()
            if kind in ("mp4", "mov", "m4v"):
                return mp4_index(f, length)
            if kind == "ivf":
                return ivf_index(f, length)
        if not self.frame:
            raise ValueError(f"{path}: raw frames need the options w and h")
        if length % self.frame:
            raise ValueError(f"{path}: {length} bytes are not a whole number of frames of {self.frame}")
        return [Sample(i, i, i * self.frame, self.frame) for i in range(length // self.frame)]

    def _files(self) -> Iterator[tuple[str, str, list[Sample]]]:
        """(file, name in the result, samples) of all files, or of the parts of a written folder."""
        system, at = _opened(self.path)
        manifest = f"{at.rstrip('/')}/{MANIFEST}"
        if system.get_file_info(manifest).is_file:
            with system.open_input_file(manifest) as f:
                parts = json.loads(f.read())
            for part in parts:
                with system.open_input_file(f"{at.rstrip('/')}/{part}.index") as f:
                    rows = list(struct.iter_unpack("<qqq", f.read()))
                places, start = [], 0
                for no, pts, size in rows:
                    places.append(Sample(no, pts, start, size))
                    start += size
                yield f"{at.rstrip('/')}/{part}", self.path, places
            return
        for path in _listed(self.path):
            yield path, path, self._index(system, path)

    def partitions(self) -> list[Range]:
        return self.ranges({}, None)

    def ranges(self, start: dict[str, int], end: dict[str, int] | None) -> list[Range]:
        """Ranges of the samples of each file from a number on, up to another."""
        out = []
        for path, name, samples in self._files():
            held, size = [], 0
            for s in samples[start.get(path, 0):None if end is None else end.get(path, 0)]:
                if held and size + s.size > self.bytes:
                    out.append(Range(path, name, held))
                    held, size = [], 0
                held.append((s.no, s.pts, s.start, s.size))
                size += s.size
            if held:
                out.append(Range(path, name, held))
        return out or [Range("", "", [])]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.samples:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.path) as f:
            for no, pts, start, size in partition.samples:
                f.seek(start)
                unit = f.read(size)
                if len(unit) != size:
                    raise EOFError(f"{partition.path}: sample {no} ends early")
                yield partition.name, no, pts, unit


class SamplesStream(DataSourceStreamReader):
    """The same as a stream: a cursor for each file counts the samples that were read, and files may grow and come."""

    def __init__(self, options: dict[str, str]):
        self.files = SamplesReader(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: len(samples) for path, _, samples in self.files._files()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.files.ranges(start, end)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.files.read(partition)


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class SamplesWriter(DataSourceWriter):
    """Parts are written under names of their own and count once the manifest names them; the manifest is moved into place at the end, in one step.

    What tasks of a failed job left goes with it, and what they still write afterwards has a name that readers pass over.
    """

    def __init__(self, options: dict[str, str], schema, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.fields = {f.name: i for i, f in enumerate(schema.fields)}
        if not {"no", "unit"} <= set(self.fields):
            raise ValueError("samples need the columns no and unit")

    def write(self, rows) -> Part:
        from pyspark import TaskContext

        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        task = TaskContext.get()
        name = f"_part-{task.partitionId():05}-{self.job}-{task.taskAttemptId()}"
        index, no, pts, unit = [], self.fields["no"], self.fields.get("pts"), self.fields["unit"]
        out = None
        for r in rows:
            if r[unit] is None or r[no] is None:
                raise ValueError("no and unit are never null")
            out = out or system.open_output_stream(f"{at}/{name}")
            out.write(bytes(r[unit]))
            index.append(struct.pack("<qqq", r[no], r[pts] if pts is not None and r[pts] is not None else r[no], len(r[unit])))
        if out is None:
            return Part(None)
        out.close()
        with system.open_output_stream(f"{at}/{name}.index") as f:
            f.write(b"".join(index))
        return Part(name)

    def _manifest(self, system, at: str) -> list[str]:
        if not system.get_file_info(f"{at}/{MANIFEST}").is_file:
            return []
        with system.open_input_file(f"{at}/{MANIFEST}") as f:
            return json.loads(f.read())

    def commit(self, messages: list[Part | None]) -> None:
        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        old = self._manifest(system, at)
        new = [m.name for m in messages if m is not None and m.name]
        with system.open_output_stream(f"{at}/_{self.job}.json") as f:
            f.write(json.dumps(new if self.overwrite else old + new).encode())
        system.move(f"{at}/_{self.job}.json", f"{at}/{MANIFEST}")
        if self.overwrite:
            self._remove(system, at, old)

    def abort(self, messages: list[Part | None]) -> None:
        system, at = _opened(self.path)
        from pyarrow import fs

        self._remove(system, at, [f.base_name for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if self.job in f.base_name])

    def _remove(self, system, at: str, names: list[str]) -> None:
        for n in names:
            for path in (f"{at}/{n}", f"{at}/{n}.index"):
                if system.get_file_info(path).is_file:
                    system.delete_file(path)


class Samples(DataSource):
    """(path, no, pts, unit): the samples of containers, raw frames and written folders."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SamplesReader:
        return SamplesReader(dict(self.options))

    def streamReader(self, schema) -> SamplesStream:
        return SamplesStream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> SamplesWriter:
        return SamplesWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Samples)
