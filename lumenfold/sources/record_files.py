"""Recordings of planes as files of fixed records, as a data source: a read takes byte ranges, a write ends in one commit.

A record is a plane at a time: rows x columns x channels unsigned 16-bit numbers, little-endian, channels next to each other, then columns; a number
is stored as 65535 less its value. Records follow each other by time, then plane. A recording is one such file, or a folder of them in the order of
their names, which is what a write makes. Folders have to be where driver and executors both reach them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

TOP = 65535
SCHEMA = "t long, z int, planes array<array<int>>"
#: Bytes that a partition reads, about.
PART_BYTES = 32 << 20
DONE = "recording.json"


@dataclass(frozen=True)
class Layout:
    rows: int
    columns: int
    channels: int
    planes: int

    @classmethod
    def of(cls, options: dict) -> Layout:
        found = cls(*(int(options[k]) for k in ("rows", "columns", "channels", "planes")))
        if min(found.rows, found.columns, found.channels, found.planes) < 1:
            raise ValueError(f"no planes of this layout: {found}")
        return found

    @property
    def record(self) -> int:
        return 2 * self.rows * self.columns * self.channels

    @property
    def volume(self) -> int:
        return self.record * self.planes


def files_of(path: str, layout: Layout) -> list[tuple[str, int]]:
    """The recording's files and how many times each holds. A missing, unfinished or cut file is named in the error."""
    if os.path.isdir(path):
        marker = os.path.join(path, DONE)
        if not os.path.exists(marker):
            raise ValueError(f"{path} holds no finished recording: {DONE} is missing")
        with open(marker) as f:
            listed = json.load(f)
        names = [(os.path.join(path, n), size) for n, size in listed["files"]]
        if listed["layout"] != vars(layout):
            raise ValueError(f"{path} was written as {listed['layout']}, not as {vars(layout)}")
    else:
        names = [(path, None)]
    found = []
    for name, size in names:
        if not os.path.exists(name):
            raise ValueError(f"{name} is missing")
        there = os.path.getsize(name)
        if there % layout.volume or (size is not None and there != size):
            raise ValueError(f"{name} is cut off or damaged: {there} bytes, {size if size is not None else f'not a multiple of {layout.volume}'}")
        found.append((name, there // layout.volume))
    return found


@dataclass
class Range(InputPartition):
    path: str
    first: int
    offset: int
    times: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.layout, self.path = Layout.of(options), options["path"]
        self.first, self.end = int(options.get("first", 0)), int(options.get("end", 1 << 62))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of the time cut the byte ranges; Spark applies them once more."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and tuple(f.attribute) == ("t",) and isinstance(f.value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.end = min(self.end, f.value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[Range]:
        each, out, start = max(1, PART_BYTES // self.layout.volume), [], 0
        for name, times in files_of(self.path, self.layout):
            a, b = max(start, self.first), min(start + times, self.end)
            out += [Range(name, t, (t - start) * self.layout.volume, min(each, b - t)) for t in range(a, b, each)]
            start += times
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        n = self.layout
        with open(part.path, "rb") as f:
            f.seek(part.offset)
            for t in range(part.first, part.first + part.times):
                raw = np.frombuffer(f.read(n.volume), "<u2")
                if len(raw) * 2 != n.volume:
                    raise ValueError(f"{part.path} ends within time {t}")
                values = (TOP - raw.astype("int32")).reshape(n.planes, n.rows * n.columns, n.channels).transpose(0, 2, 1)
                flat = pa.array(np.ascontiguousarray(values).ravel(), pa.int32())
                planes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n.rows * n.columns), pa.int32()), flat)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n.planes * n.channels + 1, n.channels), pa.int32()), planes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n.planes, t, "int64")), pa.array(np.arange(n.planes, dtype="int32")), lists], ["t", "z", "planes"])


@dataclass
class Part(WriterCommitMessage):
    first: int | None
    name: str
    size: int


class _Writer(DataSourceArrowWriter):
    """Every task writes a file of its own into a folder beside the recording; the commit puts them in the order of time and in place."""

    def __init__(self, options: dict, overwrite: bool):
        self.layout, self.path = Layout.of(options), options["path"].rstrip("/")
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.parts = f"{self.path}.{uuid.uuid4().hex}.partial"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        n = self.layout
        os.makedirs(self.parts, exist_ok=True)
        name, first, at, size = f"{uuid.uuid4().hex}", None, 0, 0
        with open(os.path.join(self.parts, name), "wb") as f:
            for batch in batches:
                for t, z, planes in zip(batch["t"].to_pylist(), batch["z"].to_pylist(), batch["planes"].to_pylist(), strict=True):
                    first = t if first is None else first
                    if (t, z) != (first + at // n.planes, at % n.planes):
                        raise ValueError(f"time {t}, plane {z} is where time {first + at // n.planes}, plane {at % n.planes} should be")
                    if len(planes) != n.channels or any(len(p) != n.rows * n.columns for p in planes):
                        raise ValueError(f"time {t}, plane {z} isn't of {n.channels} channels of {n.rows} x {n.columns}")
                    f.write((TOP - np.clip(np.array(planes), 0, TOP)).T.astype("<u2").tobytes())
                    at += 1
                    size += n.record
        if size % n.volume:
            raise ValueError(f"time {first + at // n.planes} has {at % n.planes} planes of {n.planes}")
        return Part(first, name, size)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.size), key=lambda m: m.first)
        end = 0
        for m in parts:
            if m.first != end:
                raise ValueError(f"times from {end} to {m.first} are missing or repeated")
            end += m.size // self.layout.volume
        os.makedirs(self.parts, exist_ok=True)
        names = []
        for m in parts:
            names.append((f"times-{m.first:012d}.rec", m.size))
            os.rename(os.path.join(self.parts, m.name), os.path.join(self.parts, names[-1][0]))
        with open(os.path.join(self.parts, DONE), "w") as f:
            json.dump({"layout": vars(self.layout), "files": names}, f)
        if os.path.exists(self.path):
            os.rename(self.path, f"{self.path}.{uuid.uuid4().hex}.old")
        os.rename(self.parts, self.path)

    def abort(self, messages: list[Part | None]) -> None:
        """What tasks wrote stays in the folder that ends in .partial, which no read takes for a recording."""


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def _options(layout: Layout) -> dict[str, str]:
    return {k: str(v) for k, v in vars(layout).items()}


def read_recording(spark: SparkSession, path: str, layout: Layout, first: int = 0, end: int | None = None) -> DataFrame:
    """(t, z, planes: one array by row and column for each channel) of the times first <= t < end; other times' bytes aren't read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordFiles)
    times = {"first": str(first)} | ({"end": str(end)} if end is not None else {})
    return spark.read.format("recording").options(**_options(layout), **times).load(path)


def write_recording(volumes: DataFrame, path: str, layout: Layout, overwrite: bool = False) -> None:
    """Writes volumes(t, z, planes) below path. Times have to be 0, 1, 2, ... with every plane once; values are held to 0..65535.

    Runs of times are dealt to as many files as there are shuffle partitions, at most; a wrong or incomplete volume stops the write and leaves nothing
    that could be read. A recording that is overwritten is moved aside.
    """
    spark = volumes.sparkSession
    spark.dataSource.register(RecordFiles)
    ordered = volumes.select(F.col("t").cast("long").alias("t"), F.col("z").cast("int").alias("z"), F.col("planes").cast("array<array<int>>").alias("planes")).repartitionByRange("t").sortWithinPartitions("t", "z")
    ordered.write.format("recording").mode("overwrite" if overwrite else "append").options(**_options(layout)).save(path)


def pixels(volumes: DataFrame, columns: int) -> DataFrame:
    """(t, z, c, y, x, v) of volumes."""
    each = volumes.select("t", "z", F.posexplode("planes").alias("c", "plane")).select("t", "z", "c", F.posexplode("plane").alias("i", "v"))
    return each.select("t", "z", "c", F.floor(F.col("i") / columns).alias("y"), (F.col("i") % columns).cast("long").alias("x"), "v")
