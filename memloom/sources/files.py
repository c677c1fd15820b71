"""Large JSON files read in byte ranges: the elements of one array in parallel, and lines as they are appended.

Workers open files by pyarrow's file systems, so paths are local ones that all executors see or URIs that those
know.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range. A task holds a range, or an element if that is longer.
RANGE_BYTES = 8 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files by name, hidden ones left out."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = sorted((f for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found]


def _read(path: str, start: int, size: int) -> bytes:
    system, inner = _opened(path)
    with system.open_input_file(inner) as f:
        f.seek(start)
        return f.read(size)


def _signs(raw: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets outside strings, +1 or -1 for each, whether the end lies inside a string), for bytes
    that begin inside a string or not, and not behind a backslash."""
    x = np.frombuffer(raw, np.uint8)
    slash = x == 0x5C
    # a byte is escaped behind an odd run of backslashes
    at = np.arange(len(x))
    last_other = np.maximum.accumulate(np.where(slash, -1, at))
    run = np.where(slash, at - last_other, 0)
    escaped = np.concatenate([[False], run[:-1] % 2 == 1]) if len(x) else np.zeros(0, bool)
    quotes = np.cumsum((x == 0x22) & ~escaped) + inside
    value = np.zeros(len(x), np.int8)
    value[(x == 0x7B) | (x == 0x5B)] = 1
    value[(x == 0x7D) | (x == 0x5D)] = -1
    value[quotes % 2 == 1] = 0
    places = np.flatnonzero(value)
    return places, value[places].astype(np.int64), int(quotes[-1] % 2) if len(x) else inside


def _range(path: str, start: int, size: int, total: int) -> tuple[int, bytes]:
    """(first byte, bytes) of a range whose ends are moved behind backslashes."""
    def moved(at: int) -> int:
        while 0 < at < total and _read(path, at - 1, 1) == b"\\":
            at += 1
        return at

    first, last = moved(start), moved(min(total, start + size))
    return first, _read(path, first, last - first) if last > first else b""


def array_elements(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """(file, at, value): the objects of the JSON array that each file is, as text, and where they begin.

    Ranges of bytes are read twice. The first time each tells how many quotes it holds and how deep its brackets go,
    for either case of its beginning; running sums over a file's ranges then tell the case and the depth. The
    second time each range gives the objects that begin in it, whole. Scalars in the array are left out.
    """
    rows = [(name, i, i * size, total) for name, total in listed(path) for i in range(-(-total // size))]
    ranges = spark.createDataFrame(rows, "file string, i long, start long, total long").repartition(max(1, min(len(rows), 10_000)), "file", "i")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                _, raw = _range(r["file"], r["start"], size, r["total"])
                (_, outside, flips), (_, inside, _) = _signs(raw, 0), _signs(raw, 1)
                out.append(r | {"flips": flips, "outside": int(outside.sum()), "inside": int(inside.sum())})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), *[(n, pa.int64()) for n in ("i", "start", "total", "flips", "outside", "inside")]]))

    before = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    cases = ranges.mapInArrow(ends, "file string, i long, start long, total long, flips long, outside long, inside long")
    cases = cases.withColumn("within", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    cases = cases.withColumn("depth", F.coalesce(F.sum(F.when(F.col("within") == 1, F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from _objects(r["file"], r["start"], size, r["total"], r["within"], r["depth"])

    return cases.select("file", "start", "total", "within", "depth").mapInArrow(objects, "file string, at long, value string")


def _objects(path: str, start: int, size: int, total: int, within: int, depth: int) -> Iterator[pa.RecordBatch]:
    first, raw = _range(path, start, size, total)
    places, signs, inside = _signs(raw, within)
    after = depth + np.cumsum(signs)
    begins = places[(signs == 1) & (after == 2) & (np.frombuffer(raw, np.uint8)[places] == 0x7B)] if len(places) else places
    stops = places[(signs == -1) & (after == 1)] if len(places) else places
    values, ats = [], []
    for at in begins.tolist():
        k = np.searchsorted(stops, at)
        if k < len(stops):
            values.append(raw[at : stops[k] + 1])
            ats.append(first + at)
        else:  # the object ends in a later range
            parts, place, level, state = [raw[at:]], first + len(raw), int(after[-1]), inside
            while place < total:
                lead, more = _range(path, place, size, total)
                p, s, state = _signs(more, state)
                done = np.flatnonzero(level + np.cumsum(s) == 1)
                if len(done):
                    parts.append(more[: p[done[0]] + 1])
                    break
                parts.append(more)
                level, place = level + int(s.sum()), lead + len(more)
            values.append(b"".join(parts))
            ats.append(first + at)
    if values:
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(values)), pa.array(ats, pa.int64()), pa.array([v.decode() for v in values])], names=["file", "at", "value"])


class _Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class _AppendedReader(DataSourceStreamReader):
    """Offsets are the bytes of whole lines seen in each file."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: n for name, total in (listed(self.path) if self._there() else []) if (n := self._whole(name, total))}

    def _there(self) -> bool:
        system, inner = _opened(self.path)
        return system.get_file_info(inner).type != fs.FileType.NotFound

    def _whole(self, name: str, total: int) -> int:
        """Bytes up to the last line end."""
        at = total
        while at > 0:
            lo = max(0, at - (1 << 16))
            found = _read(name, lo, at - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            at = lo
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(name, at, min(stop, at + self.size)) for name, stop in sorted(end.items()) for at in range(start.get(name, 0), stop, self.size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """The lines that begin in the range: behind a line end, or at the file's beginning."""
        at = partition.start
        if at and _read(partition.file, at - 1, 1) != b"\n":
            at = _next_line(partition.file, at)
        while at < partition.stop:
            stop = _next_line(partition.file, at)
            raw = _read(partition.file, at, stop - at)
            yield partition.file, at, raw.rstrip(b"\r\n").decode()
            at = stop

    def commit(self, end: dict) -> None:
        pass


def _next_line(path: str, at: int) -> int:
    """Where the line after the one that holds byte `at` begins."""
    while raw := _read(path, at, 1 << 16):
        found = raw.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(raw)
    return at


class AppendedLines(DataSource):
    """Format `appended_lines`, for readStream: (file, at, value) for each whole line of the files at `path`, as they
    grow. A restarted stream goes on behind the last byte it has read."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _AppendedReader(dict(self.options))


def appended_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the JSON objects that are appended to the files at path; lines that are none are dropped."""
    spark.dataSource.register(AppendedLines)
    rows = spark.readStream.format("appended_lines").option("path", path).load()
    bad = "_corrupt_record"
    parsed = rows.select(F.from_json("value", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    return parsed.filter(f"r IS NOT NULL AND r.{bad} IS NULL").select("r.*").drop(bad)


__all__ = ["AppendedLines", "appended_json", "array_elements", "listed"]
