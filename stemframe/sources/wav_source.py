"""WAV as a data source of Spark: ranged reads, header-only scans, and a writer that commits.

``wav`` (reading): a file is cut into ranges of bytes by its size alone, and each range is a partition; its task reads
the header and then those blocks of samples that begin in its range, block by block. So a long file is many
tasks, and no task holds more than a block. Short files share a task, which is told the first and the last of them. ``wav_info`` reads the headers only, a few kilobytes of a file of any size.

``wav`` (writing): rows are blocks of files, which a task appends to files in a temporary folder next to the target.
The driver moves the files of the tasks that succeeded into place when all have, and writes ``_SUCCESS`` last; a
failed task or job leaves no file.

Files are reached through pyarrow's file systems (local, S3, GCS, HDFS, ...).
"""

from __future__ import annotations

import io
import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK = 65_536
BLOCK_SCHEMA = "track string, channel int, block int, start long, n int, sr int, samples array<float>, error string"
INFO_SCHEMA = "path string, stream int, sr int, duration double, error string"
WRITE_SCHEMA = "file string, block int, sr int, channels int, total long, samples array<double>"
_INFO_ARROW = pa.schema([("path", pa.string()), ("stream", pa.int32()), ("sr", pa.int32()), ("duration", pa.float64()), ("error", pa.string())])

#: read(offset, length) of a file's bytes.
Read = Callable[[int, int], bytes]


def header(read: Read, size: int) -> tuple[dict, int, int]:
    """(format, start and length of the data) of a PCM WAV of ``size`` bytes; chunks may come in any order, and only their heads are read.

    The extensible format says what its samples are in the first two bytes of the sub-format.
    """
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, data = 12, {}, (0, 0)
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            body = read(at + 8, min(length, 40))
            kind, channels, sr, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if kind == 0xFFFE and length >= 26:
                kind = struct.unpack_from("<H", body, 24)[0]
            fmt = {"kind": kind, "channels": channels, "sr": sr, "bits": bits}
        elif name == b"data":
            data = (at + 8, min(length, size - at - 8))
        at += 8 + length + length % 2
    if not fmt:
        raise ValueError("a WAV file without a format")
    if fmt["kind"] not in (1, 3) or not fmt["channels"] or not fmt["sr"]:
        raise ValueError(f"format {fmt['kind']} with {fmt['channels']} channels is not PCM")
    if (fmt["kind"], fmt["bits"]) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        raise ValueError(f"{fmt['bits']} bits of kind {fmt['kind']}")
    return fmt, *data


def samples_of(raw: bytes, fmt: dict) -> np.ndarray:
    """Samples by channels in [-1, 1]: integers of 8 (unsigned), 16, 24 and 32 bits, floats of 32 and 64."""
    bits, width = fmt["bits"], fmt["bits"] // 8
    raw = raw[: len(raw) // (width * fmt["channels"]) * width * fmt["channels"]]
    if fmt["kind"] == 3:
        x = np.frombuffer(raw, f"<f{width}").astype(float)
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 127
    elif bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000) / float((1 << 23) - 1)
    else:
        x = np.frombuffer(raw, f"<i{width}") / float((1 << (bits - 1)) - 1)
    return x.reshape(-1, fmt["channels"])


def codes_of(x: np.ndarray, bits: int) -> bytes:
    """PCM bytes of samples in [-1, 1] (clipped), truncated to 8, 16, 24 or 32 bits; bits -32 and -64 are floats as they are."""
    if bits < 0:
        return x.astype(f"<f{-bits // 8}").tobytes()
    top = (1 << (bits - 1)) - 1
    whole = np.trunc(np.clip(x, -1, 1) * top).astype("<i8").reshape(-1)
    return (whole + 128).astype(np.uint8).tobytes() if bits == 8 else whole.view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()


def head_bytes(size: int, channels: int, sr: int, bits: int) -> bytes:
    """The 44 bytes before ``size`` bytes of samples; bits below 0 are floats."""
    width, kind = abs(bits) // 8, 3 if bits < 0 else 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, kind, channels, sr, sr * channels * width, channels * width, abs(bits), b"data", size)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; a ValueError for stores that pyarrow doesn't know."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


#: The names from the root to a file; files are in the order of these.
Place = tuple[str, ...]


def _listed(store: pafs.FileSystem, folder: str) -> list[tuple[str, int | None]]:
    """Names in a folder in order, with their sizes: -1 for a folder, None where it isn't known yet."""
    if isinstance(store, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            return sorted((f.name, -1 if f.is_dir() else None) for f in found)
    return sorted((f.base_name, -1 if f.type == pafs.FileType.Directory else f.size) for f in store.get_file_info(pafs.FileSelector(folder)))


def _walk(store: pafs.FileSystem, folder: str, above: Place = (), first: Place = (), last: Place = ()) -> Iterator[tuple[Place, str, int]]:
    """(place, path, size) of the WAV files from ``first`` to ``last`` (all, if they are empty) in order; of no more than one folder by level all names are held."""
    for name, size in _listed(store, folder):
        place = (*above, name)
        if name.startswith(("_", ".")) or place < first[: len(place)]:
            continue
        if last and place > last[: len(place)]:
            return
        path = f"{folder.rstrip('/')}/{name}"
        if size == -1:
            yield from _walk(store, path, place, first, last)
        elif name.endswith(".wav"):
            info = store.get_file_info(path) if size is None else None
            if info is None or info.is_file:
                yield place, path, info.size if info else size


def _root(path: str) -> tuple[pafs.FileSystem, str, bool]:
    """The store, the place in it, and whether it is a folder."""
    store, place = file_system(path)
    found = store.get_file_info(place)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return store, place, found.type == pafs.FileType.Directory


@dataclass
class Span(InputPartition):
    """Short files that follow each other: the first and the last one, and how many. Its task looks for them itself, so the driver doesn't hold their names."""

    first: Place
    last: Place
    count: int

    def files(self, path: str, longest: float) -> Iterator[tuple[str, int]]:
        """Path and size of those of at most ``longest`` bytes; an error if they are not as many as they were."""
        store, place = file_system(path)
        found = 0
        for _, file, size in _walk(store, place, (), self.first, self.last) if self.count else ():
            if size <= longest:
                found += 1
                yield file, size
        if found != self.count:
            raise OSError(f"files below {path} came or went while they were read: {found} instead of {self.count}")


def _spans(files: Iterator[tuple[Place, int]], most: int) -> Iterator[Span]:
    """Spans of files (place, weight) that weigh ``most`` together at most, or are one file."""
    first, last, count, held = (), (), 0, 0
    for place, weight in files:
        if count and held + weight > most:
            yield Span(first, last, count)
            count, held = 0, 0
        first, last, count, held = first if count else place, place, count + 1, held + weight
    if count:
        yield Span(first, last, count)


@dataclass
class Ranges(InputPartition):
    """(path, size of the file, start, end) of a range of bytes of a long file."""

    part: tuple[str, int, int, int]


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", BLOCK))
        self.double = options.get("double", "false").lower() == "true"
        self.mono, self.range = options.get("mono", "false").lower() == "true", int(options.get("rangebytes", 32 << 20))

    def partitions(self) -> list[Ranges | Span]:
        store, place, folder = _root(self.path)
        long: list[Ranges] = []

        def cut(path: str, size: int) -> None:
            long.extend(Ranges((path, size, at, at + self.range)) for at in range(0, max(size, 1), self.range))

        def short() -> Iterator[tuple[Place, int]]:
            for at, path, size in _walk(store, place):
                if size > self.range:
                    cut(path, size)
                else:
                    yield at, max(size, 4096)  # an open costs something as well

        if not folder:
            cut(place, store.get_file_info(place).size)
            return long
        spans = list(_spans(short(), self.range))
        return [*long, *spans] or [Span((), (), 0)]

    def read(self, partition: Ranges | Span) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Ranges):
            yield from self._blocks(*partition.part)
        else:
            for path, size in partition.files(self.path, self.range):
                yield from self._blocks(path, size, 0, max(size, 1))

    def _blocks(self, path: str, file_size: int, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        """Blocks that begin in bytes begin..end; the first range of a file also reports what is wrong with it."""
        store, root = file_system(self.path)
        root = root.rstrip("/")
        track = (path[len(root) + 1 :] if path.startswith(f"{root}/") else path.rsplit("/", 1)[-1]).removesuffix(".wav")
        with store.open_input_file(path) as file:
            read = lambda at, n: file.read_at(n, at)
            try:
                fmt, start, size = header(read, file_size)
            except (ValueError, struct.error) as e:
                if not begin:
                    yield self._batch([(track, None, None, None, 0, None, [], str(e))])
                return
            wide = fmt["bits"] // 8 * fmt["channels"]
            total = size // wide
            first = max(0, -(-(begin - start) // (wide * self.block)))
            for number in range(first, -(-total // self.block)):
                at = start + number * self.block * wide
                if at >= end:
                    break
                x = samples_of(read(at, min(self.block, total - number * self.block) * wide), fmt)
                x = x.mean(axis=1, keepdims=True) if self.mono else x[:, :2]
                yield self._batch([(track, c, number, number * self.block, len(x), fmt["sr"], x[:, c] if self.double else x[:, c].astype(np.float32), None) for c in range(x.shape[1])])

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        value = pa.float64() if self.double else pa.float32()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(value), pa.string()]
        names = [field.split()[0] for field in BLOCK_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)], names=names)


class InfoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.files = options["path"], int(options.get("files", 256))

    def partitions(self) -> list[Span]:
        store, place, folder = _root(self.path)
        if not folder:
            return [Span((), (), 1)]
        return list(_spans(((at, 1) for at, _, _ in _walk(store, place)), self.files)) or [Span((), (), 0)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        store, place, folder = _root(self.path)
        rows = []
        for path, size in part.files(self.path, float("inf")) if folder else [(place, store.get_file_info(place).size)]:
            with store.open_input_file(path) as file:
                try:
                    fmt, _, length = header(lambda at, n: file.read_at(n, at), size)  # noqa: B023
                    rows.append((path, 0, fmt["sr"], length / (fmt["channels"] * fmt["bits"] / 8) / fmt["sr"], None))
                except (ValueError, struct.error) as e:
                    rows.append((path, None, None, None, str(e)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows), _INFO_ARROW.types)], schema=_INFO_ARROW)


@dataclass
class Written(WriterCommitMessage):
    """Files 0.wav, 1.wav, ... of a task's temporary folder, whose names below the target are the lines of ``_names`` there."""

    folder: str
    count: int


#: Names of files that the driver holds at once when a job commits.
SOME = 100_000


def _batched(items: Iterator, size: int = 10_000) -> Iterator[list]:
    while some := list(itertools.islice(items, size)):
        yield some


class FileWriter(DataSourceArrowWriter):
    """Blocks of a file come to one task, in order (``wav.write_wav`` sees to that); files whose peak is below ``least`` are left out.

    A task tells the driver its folder and how many files it wrote; their names lie in that folder.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.bits, self.overwrite = options["path"], int(options.get("bits", 16)), overwrite
        self.least = float(options.get("least", 0))
        self.run = f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, place = file_system(self.path)
        own = f"{place}/{self.run}/{uuid.uuid4().hex}"
        done: set[str] = set()
        now, out, names, left, top, count = None, None, None, 0, 0.0, 0

        def close() -> None:
            nonlocal out, count
            if out is not None:
                out.close()
                out = None
            if left:
                raise ValueError(f"{left} bytes of {now} are missing")
            if now is not None and top < self.least:
                store.delete_file(f"{own}/{count}.wav")
            elif now is not None:
                names.write(f"{json.dumps(now)}\n".encode())
                count += 1

        try:
            for batch in batches:
                for name, _, sr, channels, total, samples in zip(*(batch.column(k).to_pylist() if k < 5 else batch.column(k) for k in range(6))):
                    if name != now:
                        close()
                        if name in done:
                            raise ValueError(f"blocks of {name} did not come together")
                        done.add(name)
                        now, left, top = name, total * channels * abs(self.bits) // 8, 0.0
                        if left > 0xFFFFFFFF - 36:
                            raise ValueError(f"{name} is too long for a WAV file")
                        if names is None:
                            store.create_dir(own, recursive=True)
                            names = store.open_output_stream(f"{own}/_names")
                        out = store.open_output_stream(f"{own}/{count}.wav")
                        out.write(head_bytes(left, channels, sr, self.bits))
                    x = samples.values.to_numpy(zero_copy_only=False)
                    if self.least and x.size:
                        top = np.maximum(top, np.abs(x).max())  # not a number counts as loud
                    codes = codes_of(x, self.bits)
                    out.write(codes)
                    left -= len(codes)
            close()
            if names is not None:
                names.close()
        except BaseException:
            for open_ in (out, names):
                if open_ is not None:
                    open_.close()
            self._drop(store, own)
            raise
        return Written(own, count)

    @staticmethod
    def _drop(store: pafs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)

    def commit(self, messages: list[Written | None]) -> None:
        store, place = file_system(self.path)
        tasks = [m for m in messages if m and m.count]
        if not self.overwrite:
            there, first = 0, None
            for some in _batched(to for _, to in self._moves(store, place, tasks)):
                known = [f.path for f in store.get_file_info(some) if f.type != pafs.FileType.NotFound]
                there, first = there + len(known), first or next(iter(known), None)
            if there:
                self._drop(store, f"{place}/{self.run}")
                raise FileExistsError(f"{there} files are there already, the first is {first}")
        # Names are compared in parts by their hash, so that at most about SOME of them are held at once.
        parts = sum(m.count for m in tasks) // SOME + 1
        for part in range(parts):
            seen: set[str] = set()
            for _, to in self._moves(store, place, tasks):
                if zlib.crc32(to.encode()) % parts == part:
                    if to in seen:
                        self._drop(store, f"{place}/{self.run}")
                        raise FileExistsError("blocks of a file came to several tasks")
                    seen.add(to)
        with ThreadPoolExecutor(16) as pool:
            for some in _batched(self._moves(store, place, tasks)):
                for folder in {to.rsplit("/", 1)[0] for _, to in some}:
                    store.create_dir(folder, recursive=True)
                list(pool.map(lambda m: store.move(*m), some, chunksize=64))
        self._drop(store, f"{place}/{self.run}")
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/_SUCCESS"):
            pass

    @staticmethod
    def _moves(store: pafs.FileSystem, place: str, tasks: list[Written]) -> Iterator[tuple[str, str]]:
        """Temporary and lasting path of every file, one task's list after the other, line by line."""
        for m in tasks:
            with store.open_input_stream(f"{m.folder}/_names", buffer_size=1 << 16) as raw, io.TextIOWrapper(raw, "utf-8", newline="\n") as names:
                for number, line in enumerate(names):
                    yield f"{m.folder}/{number}.wav", f"{place}/{json.loads(line)}"

    def abort(self, messages: list[Written | None]) -> None:
        store, place = file_system(self.path)
        self._drop(store, f"{place}/{self.run}")


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return BLOCK_SCHEMA.replace("float", "double") if self.options.get("double", "false").lower() == "true" else BLOCK_SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


class WavInfoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_info"

    def schema(self) -> str:
        return INFO_SCHEMA

    def reader(self, schema) -> InfoReader:
        return InfoReader(self.options)
