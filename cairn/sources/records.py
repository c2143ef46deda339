"""Point files as a Spark data source: PLY, PCD, BIN and LAS, read by byte ranges, and PLY, PCD and LAS written.

Files of records of one length (binary PLY and PCD, BIN, LAS) are cut into ranges of `split` bytes by their sizes alone; the
task of a range reads the header and then the records that begin in its range, in pieces, and of these only the columns that
the schema asks for. So no task holds a file, there is no limit on a file's size, and pid, a record's place in its file, is
the same however the file is cut. Small files share a task. Text files are read as a stream by one task.

Any store that pyarrow has a file system for will do (local or mounted folders, s3, gs, abfss, hdfs).
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: PLY property types as numpy names them.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
#: Fixed values of the LAS standard: bytes of a record by point format, and where time and colours begin in it.
LAS_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
LAS_TIME = {1: 20, 3: 20, 4: 20, 5: 20, 6: 22, 7: 22, 8: 22, 9: 22, 10: 22}
LAS_COLOURS = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
KINDS = ("ply", "pcd", "bin", "las")
#: Bytes of a range, of one read and of the longest header; rows of an Arrow batch; points of a written file.
SPLIT, PIECE, HEADER, ROWS, FILE_ROWS = 64 << 20, 8 << 20, 16 << 20, 100_000, 1_000_000


class Layout(NamedTuple):
    """Where a file's points are. record: a record's numpy type (None: lines of text); start: byte of the first one; count:
    how many; fields: for each column its field (text: its place in a line), factor and shift; skip: lines before the first."""

    record: np.dtype | None
    start: int
    count: int
    fields: dict[str, tuple[str | int, float, float]]
    skip: int = 0


class PlyHeader(NamedTuple):
    """kind: the format; start: bytes of the header; elements: (name, count, properties), a property is (name, type) or, for
    lists, (name, type of the length, type of the items)."""

    kind: str
    start: int
    elements: list[tuple[str, int, list[tuple[str, ...]]]]


def ply_header(head: bytes) -> PlyHeader | None:
    """The header at the beginning of a PLY file; None if it goes on beyond these bytes."""
    if not head.startswith(b"ply"):
        raise ValueError("not a PLY file")
    end = head.find(b"end_header")
    feed = head.find(b"\n", end)
    if end < 0 or feed < 0:
        return None
    kind, elements = "", []
    for words in (x.split() for x in head[:end].decode("ascii", "replace").splitlines()):
        match words:
            case ["format", kind, *_]:
                pass
            case ["element", name, n]:
                elements.append((name, int(n), []))
            case ["property", "list", length, item, name]:
                elements[-1][2].append((name, PLY_TYPES[length], PLY_TYPES[item]))
            case ["property", of, name]:
                elements[-1][2].append((name, PLY_TYPES[of]))
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"PLY format {kind!r} is not read")
    return PlyHeader(kind, feed + 1, elements)


def _flat_type(properties: list[tuple[str, ...]]) -> np.dtype:
    if any(len(p) == 3 for p in properties):
        raise ValueError("lists among or before the vertices are not read")
    return np.dtype([(name, f"<{of}") for name, of in properties])


def _ply(head: bytes, size: int) -> Layout | None:
    if (header := ply_header(head)) is None:
        return None
    before, skip = header.start, 0
    for name, count, properties in header.elements:
        if name == "vertex":
            fields = {p[0]: (k if header.kind == "ascii" else p[0], 1.0, 0.0) for k, p in enumerate(properties)}
            if header.kind == "ascii":
                return Layout(None, header.start, count, fields, skip)
            return Layout(_flat_type(properties), before, count, fields)
        skip += count
        before += count * _flat_type(properties).itemsize if header.kind != "ascii" else 0
    return Layout(None, header.start, 0, {})


def _pcd(head: bytes, size: int) -> Layout | None:
    said: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in said:
        end = head.find(b"\n", at)
        if end < 0:
            if len(head) >= size:
                raise ValueError("PCD header without DATA")
            return None
        words = head[at:end].decode("ascii", "replace").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            said[words[0]] = words[1:]
    names, sizes, kinds = said["FIELDS"], said["SIZE"], said["TYPE"]
    repeats = list(map(int, said.get("COUNT", ["1"] * len(names))))
    n = int(said["POINTS"][0])
    if said["DATA"] == ["ascii"]:
        places = np.cumsum([0, *repeats]).tolist()
        return Layout(None, at, n, {c: (places[k], 1.0, 0.0) for k, c in enumerate(names)})
    if said["DATA"] != ["binary"]:
        raise ValueError(f"PCD data {' '.join(said['DATA'])!r} is not read")
    record = np.dtype([(f"{c}{k}", f"<{of.lower()}{s}", (r,)) for k, (c, of, s, r) in enumerate(zip(names, kinds, sizes, repeats, strict=True))])
    return Layout(record, at, n, {c: (f"{c}{k}", 1.0, 0.0) for k, c in enumerate(names)})


def _bin(head: bytes, size: int) -> Layout:
    record = np.dtype([(c, "<f4") for c in ("x", "y", "z", "intensity")])
    return Layout(record, 0, size // record.itemsize, {c: (c, 1.0, 0.0) for c in record.names})


def _las(head: bytes, size: int) -> Layout | None:
    if not head.startswith(b"LASF"):
        raise ValueError("not a LAS file")
    if len(head) < 227 or (head[25] >= 4 and len(head) < 255):
        if len(head) >= size:
            raise ValueError("LAS header cut short")
        return None
    minor, form = head[25], head[104]
    start, (length,), (count,) = struct.unpack_from("<I", head, 96)[0], struct.unpack_from("<H", head, 105), struct.unpack_from("<I", head, 107)
    if head[24] != 1 or minor not in (2, 3, 4):
        raise ValueError(f"LAS version {head[24]}.{minor} is not read")
    if form & 0xC0:
        raise ValueError("compressed points (LAZ) are not read: there is no codec for them here")
    if form not in LAS_BYTES or length < LAS_BYTES[form]:
        raise ValueError(f"LAS point format {form} with records of {length} bytes is not read")
    if minor >= 4:
        count = struct.unpack_from("<Q", head, 247)[0] or count
    factors, shifts = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    at = {"X": (0, "<i4"), "Y": (4, "<i4"), "Z": (8, "<i4"), "intensity": (12, "<u2"), "classification": (16 if form >= 6 else 15, "u1")}
    if form in LAS_TIME:
        at["gps_time"] = (LAS_TIME[form], "<f8")
    if form in LAS_COLOURS:
        at |= {c: (LAS_COLOURS[form] + 2 * k, "<u2") for k, c in enumerate(("red", "green", "blue"))}
    record = np.dtype({"names": list(at), "formats": [f for _, f in at.values()], "offsets": [o for o, _ in at.values()], "itemsize": length})
    fields = {c.lower(): (c, factors[k], shifts[k]) for k, c in enumerate("XYZ")} | {c: (c, 1.0, 0.0) for c in at if c not in "XYZ"}
    return Layout(record, start, count, fields)


LAYOUTS = {"ply": _ply, "pcd": _pcd, "bin": _bin, "las": _las}


def layout(kind: str, file, size: int) -> Layout:
    """The layout of an open file, from as much of its beginning as the header takes."""
    take = 1 << 16
    while True:
        file.seek(0)
        head = file.read(min(take, size))
        if (found := LAYOUTS[kind](head, size)) is not None:
            break
        if take >= min(size, HEADER):
            raise ValueError(f"a {kind} header without an end")
        take *= 8
    if found.record is not None and found.start + found.count * found.record.itemsize > size:
        raise ValueError(f"{found.count} points announced, there is room for {max(0, size - found.start) // max(1, found.record.itemsize)}")
    return found


def _lines(file, start: int) -> Iterator[bytes]:
    file.seek(start)
    rest = b""
    while piece := file.read(PIECE):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _text(file, found: Layout, wanted: list[str]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    own, at, left = [c for c in wanted if c in found.fields], 0, found.skip
    rows: list[list[float]] = []
    for line in _lines(file, found.start) if found.count else ():
        words = line.split()
        if not words:
            continue
        if left:
            left -= 1
            continue
        if own and len(words) <= max(found.fields[c][0] for c in own):
            raise ValueError(f"point {at + len(rows)} is cut short")
        rows.append([float(words[found.fields[c][0]]) for c in own])
        if len(rows) == ROWS or at + len(rows) == found.count:
            table = np.array(rows, float).reshape(len(rows), len(own))
            yield at, {c: table[:, k] for k, c in enumerate(own)}
            at, rows = at + len(rows), []
        if at == found.count:
            break
    if at < found.count:
        raise ValueError(f"{found.count} points announced, {at + len(rows)} found")


def _fixed(file, found: Layout, wanted: list[str], begin: int, end: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    size = found.record.itemsize
    first = max(0, -(-(begin - found.start) // size))
    last = min(found.count, max(0, -(-(end - found.start) // size)))
    step = max(1, PIECE // size)
    for at in range(first, last, step):
        n = min(step, last - at)
        file.seek(found.start + at * size)
        data = file.read(n * size)
        if len(data) < n * size:
            raise ValueError(f"{found.count} points announced, {at + len(data) // size} found")
        table = np.frombuffer(data, found.record)
        out = {}
        for c in wanted:
            if c in found.fields:
                name, factor, shift = found.fields[c]
                values = table[name]
                values = (values[:, 0] if values.ndim > 1 else values).astype(float)
                out[c] = values if (factor, shift) == (1.0, 0.0) else values * factor + shift
        yield at, out


def points(file, kind: str, size: int, wanted: list[str], begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(place of the first point, number of points, wanted columns that the file has) of the records that begin in the bytes from
    begin to end; those of a text file all belong to its first byte."""
    found = layout(kind, file, size)
    end = size if end is None else end
    if found.record is not None:
        pieces = _fixed(file, found, wanted, begin, end)
    else:
        pieces = _text(file, found, wanted) if begin == 0 else iter(())
    for at, columns in pieces:
        n = len(next(iter(columns.values()))) if columns else (found.count if found.record is None else 0)
        yield at, n, columns


def parsed(data: bytes, kind: str, wanted: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The wanted columns of a whole file in memory."""
    pieces = [c for _, _, c in points(io.BytesIO(data), kind, len(data), list(wanted))]
    if not pieces:
        return {c: np.empty(0) for c in wanted if c in layout(kind, io.BytesIO(data), len(data)).fields}
    return {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path within it; ValueError where pyarrow has none for it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def reachable(path: str) -> bool:
    """Whether pyarrow has a file system for the path."""
    try:
        store(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def listed(path: str, kinds: tuple[str, ...] = KINDS, strict: bool = False) -> list[tuple[str, int]]:
    """(path, size) of the files of these kinds under path, by name. A path that is not there, a single file of another kind, and
    with `strict` any file of another kind, raise an error."""
    system, base = store(path)
    info = system.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    single = info.type == pafs.FileType.File
    entries = [info] if single else system.get_file_info(pafs.FileSelector(base, recursive=True))
    found = []
    for x in sorted((x for x in entries if x.type == pafs.FileType.File), key=lambda x: x.path):
        if not single and any(part[:1] in "._" for part in x.path.removeprefix(base).strip("/").split("/")):
            continue  # what writers leave beside their files
        if x.extension.lower() in kinds:
            found.append((x.path, x.size))
        elif single or strict:
            raise ValueError(f"{x.path}: files are read whose names end in {', '.join(kinds)}")
    return found


class Ranges(InputPartition):
    """Byte ranges (path, size, begin, end) of one task."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.ranges = ranges


def planned(files: list[tuple[str, int]], split: int) -> list[Ranges]:
    """Ranges of `split` bytes at most, small ones together up to as much."""
    tasks, room = [], 0
    for path, size in files:
        for begin in range(0, max(size, 1), split):
            end = min(begin + split, size)
            if not tasks or room < end - begin:
                tasks.append([])
                room = split
            tasks[-1].append((path, size, begin, end))
            room -= end - begin
    return [Ranges(x) for x in tasks] or [Ranges([])]


class PointReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.names, options["path"]
        self.split = int(options.get("split", SPLIT))
        self.strict = options.get("strict", "false").lower() == "true"
        self.required = [c for c in options.get("required", "").split(",") if c]
        if self.split < 1:
            raise ValueError("split must be positive")

    def partitions(self) -> list[Ranges]:
        files = listed(self.path, strict=self.strict)
        if not files:
            raise ValueError(f"no point files under {self.path}")
        return planned(files, self.split)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = store(self.path)
        wanted = [c for c in self.names if c not in ("path", "pid")]
        checked = list(dict.fromkeys([*wanted, "x", "y", "z"]))  # a point that is nowhere is none, whatever is asked for
        named = "" if not isinstance(system, pafs.LocalFileSystem) else "file:"
        for path, size, begin, end in partition.ranges:
            with system.open_input_file(path) as file:
                if self.required:
                    have = layout(path.rsplit(".", 1)[1].lower(), file, size).fields
                    if missing := [c for c in self.required if c not in have]:
                        raise ValueError(f"{path}: no {', '.join(missing)}")
                for at, n, columns in points(file, path.rsplit(".", 1)[1].lower(), size, checked, begin, end):
                    ok = np.flatnonzero(np.all([np.isfinite(v) for v in columns.values()], axis=0)) if columns else np.arange(n)
                    for k in range(0, len(ok), ROWS):
                        own = ok[k : k + ROWS]
                        values = {"path": lambda own=own: pa.array([f"{named}{path}"] * len(own)), "pid": lambda own=own: pa.array(own.astype(np.int64) + at)}
                        yield pa.RecordBatch.from_arrays([values[c]() if c in values else pa.array(columns[c][own]) if c in columns else pa.nulls(len(own), pa.float64()) for c in self.names], self.names)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


def ply_header_of(n: int) -> bytes:
    fields = "".join(f"property double {c}\n" for c in "xyz")
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n{fields}end_header\n".encode()


def pcd_header_of(n: int) -> bytes:
    return f"VERSION .7\nFIELDS x y z\nSIZE 8 8 8\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n".encode()


def las_bytes(x: np.ndarray) -> bytes:
    """LAS 1.4, point format 0, of rows of three coordinates: steps of 1e-6, or of the power of ten that their extent needs."""
    low, high = x.min(axis=0), x.max(axis=0)
    step = 1e-6
    while ((high - low) / step).max() > 2**31 - 2:
        step *= 10
    record = np.zeros(len(x), np.dtype([("p", "<i4", (3,)), ("rest", "u1", (8,))]))
    record["p"] = np.rint((x - low) / step)
    head = bytearray(375)
    head[:4] = b"LASF"
    struct.pack_into("<BB", head, 24, 1, 4)
    struct.pack_into("<HII", head, 94, 375, 375, 0)
    struct.pack_into("<BHI5I", head, 104, 0, 20, len(x), len(x), 0, 0, 0, 0)
    struct.pack_into("<12d", head, 131, step, step, step, *low, *[v for pair in zip(high, low, strict=True) for v in pair])
    struct.pack_into("<2Q", head, 247, len(x), len(x))
    return bytes(head) + record.tobytes()


def file_bytes(kind: str, x: np.ndarray) -> bytes:
    """A file of the kind with the rows of x as its points."""
    if kind == "las":
        return las_bytes(x)
    return (ply_header_of if kind == "ply" else pcd_header_of)(len(x)) + np.ascontiguousarray(x, "<f8").tobytes()


class PointWriter(DataSourceArrowWriter):
    """Files of `rows` points at most beside the target first; they move there once all tasks are done."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.kind, self.rows = options.get("kind", "ply").lower(), int(options.get("rows", FILE_ROWS))
        if self.kind not in ("ply", "pcd", "las"):
            raise ValueError(f"points are written as ply, pcd or las, not as {self.kind!r}")
        if not {"x", "y", "z"} <= set(schema.names):
            raise ValueError("points have x, y and z")
        self.stage = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = store(self.path)
        task = TaskContext.get()
        system.create_dir(f"{base}/{self.stage}")
        held, n, files = [], 0, []

        def put(x: np.ndarray) -> None:
            name = f"part-{task.partitionId():05d}-{len(files):04d}-{task.taskAttemptId()}.{self.kind}"
            with system.open_output_stream(f"{base}/{self.stage}/{name}") as out:
                out.write(file_bytes(self.kind, x))
            files.append(name)

        for batch in iterator:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
            x = x[np.isfinite(x).all(axis=1)]
            held.append(x)
            n += len(x)
            while n >= self.rows:
                every = np.concatenate(held)
                put(every[: self.rows])
                held, n = [every[self.rows :]], n - self.rows
        if n:
            put(np.concatenate(held))
        return Written(files)

    def commit(self, messages) -> None:
        system, base = store(self.path)
        if self.overwrite:
            for x in system.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
                if not x.base_name.startswith("_writing-"):
                    (system.delete_dir if x.type == pafs.FileType.Directory else system.delete_file)(x.path)
        for name in (f for m in messages if m for f in m.files):
            system.move(f"{base}/{self.stage}/{name}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, base = store(self.path)
        if system.get_file_info(f"{base}/{self.stage}").type == pafs.FileType.Directory:
            system.delete_dir(f"{base}/{self.stage}")


class PointFiles(DataSource):
    """Format `points`. Read: path, pid and columns of doubles, null where a file has none; rows whose columns or place are not
    finite are left out. Options: split, strict, required. Written: x, y, z; options kind and rows (of a file)."""

    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> str:
        return "path string, pid long, x double, y double, z double"

    def reader(self, schema: StructType) -> PointReader:
        return PointReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PointWriter:
        return PointWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats of this package known to the session."""
    from cairn.sources.meshes import FaceFiles

    spark.dataSource.register(PointFiles)
    spark.dataSource.register(FaceFiles)
