"""A library of bits as a data source: packed files by part, with a manifest and a gate against faults.

Rows are (part, unit, bits). Every task writes files of its own into a folder of the job and
reports them in its commit message; the driver then removes what else is there, from
attempts that failed, and writes the manifest last. A reader makes a task for each file
of the parts asked for. Before that it holds the folder against the manifest: a file that is
missing or not listed, an expected part that is missing, and a part not expected are errors, and so
are bytes whose digest differs when a task reads them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "part string, unit long, bits array<boolean>"
MANIFEST = "manifest.json"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if not urlsplit(uri).scheme:
        uri = f"file://{uri}"
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def pack(units: np.ndarray, bits: np.ndarray) -> bytes:
    """Rows and width, the units, and each row's bits from the highest on, filled up to a byte."""
    return np.array(bits.shape, dtype="<i8").tobytes() + units.astype("<i8").tobytes() + np.packbits(bits, axis=1).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = np.frombuffer(data, "<i8", 2)
    units = np.frombuffer(data, "<i8", n, 16)
    packed = np.frombuffer(data, np.uint8, offset=16 + 8 * n).reshape(n, -1)
    return units, np.unpackbits(packed, axis=1, count=int(width)).astype(bool)


@dataclass
class Files(WriterCommitMessage):
    entries: list[dict]


@dataclass
class OneFile(InputPartition):
    entry: dict


class BitWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, rows: int, overwrite: bool):
        self.folder, self.rows, self.overwrite, self.job = folder, rows, overwrite, f"job-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        store, path = _store(self.folder)
        store.create_dir(f"{path}/{self.job}", recursive=True)
        entries: list[dict] = []
        waiting: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(key: tuple[str, int]) -> None:
            units, bits = (np.concatenate(x) for x in zip(*waiting.pop(key), strict=True))
            data, name = pack(units, bits), f"{self.job}/bits-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
            entries.append({"file": name, "part": key[0], "rows": len(units), "width": key[1], "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})

        for batch in batches:
            part, unit, bits = (batch.column(c) for c in ("part", "unit", "bits"))
            if part.null_count or unit.null_count or bits.null_count or bits.flatten().null_count:
                raise ValueError("a library of bits holds no nulls")
            flat, n = bits.flatten().to_numpy(zero_copy_only=False), bits.value_lengths().to_numpy(zero_copy_only=False)
            ends, names, units = np.cumsum(n), part.to_numpy(zero_copy_only=False), unit.to_numpy()
            for key in sorted({*zip(names.tolist(), n.tolist(), strict=True)}):
                own = np.flatnonzero((names == key[0]) & (n == key[1]))
                at = (ends[own] - key[1])[:, None] + np.arange(key[1])
                waiting.setdefault(key, []).append((units[own], flat[at].astype(bool)))
                if sum(len(u) for u, _ in waiting[key]) >= self.rows:
                    flush(key)
        for key in list(waiting):
            flush(key)
        return Files(entries)

    def commit(self, messages: list) -> None:
        store, path = _store(self.folder)
        entries = [e for m in messages if m for e in m.entries]
        listed = {e["file"] for e in entries}
        store.create_dir(f"{path}/{self.job}", recursive=True)
        for info in store.get_file_info(fs.FileSelector(f"{path}/{self.job}")):
            if f"{self.job}/{info.base_name}" not in listed:
                store.delete_file(info.path)
        old = _manifest(store, path)
        if old is not None and not self.overwrite:
            entries = old + entries
        temporary = f"{path}/_{MANIFEST}-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            out.write(json.dumps(sorted(entries, key=lambda e: (e["part"], e["file"]))).encode())
        store.move(temporary, f"{path}/{MANIFEST}")
        if self.overwrite:
            for e in old or []:
                store.delete_file(f"{path}/{e['file']}")

    def abort(self, messages: list) -> None:
        store, path = _store(self.folder)
        if store.get_file_info(f"{path}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/{self.job}")


def _manifest(store: fs.FileSystem, path: str) -> list[dict] | None:
    if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with store.open_input_file(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


class BitReader(DataSourceReader):
    def __init__(self, folder: str, parts: list[str] | None, expected: list[str] | None):
        self.folder, self.parts, self.expected = folder, parts, expected

    def partitions(self) -> list[OneFile]:
        store, path = _store(self.folder)
        entries = _manifest(store, path)
        if entries is None:
            raise ValueError(f"{self.folder} has no manifest")
        there = {i.path.removeprefix(path).lstrip("/") for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File}
        there = {name for name in there if "/bits-" in name or name.startswith("bits-")}
        listed, parts = {e["file"] for e in entries}, {e["part"] for e in entries}
        faults = {"missing files": listed - there, "stray files": there - listed}
        if self.expected is not None:
            faults |= {"missing parts": set(self.expected) - parts, "unexpected parts": parts - set(self.expected)}
        if self.parts is not None:
            faults["unknown parts"] = set(self.parts) - parts
        if any(faults.values()):
            raise ValueError("; ".join(f"{k}: {', '.join(sorted(v))}" for k, v in faults.items() if v))
        return [OneFile(e) for e in entries if self.parts is None or e["part"] in self.parts]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, path = _store(self.folder)
        entry = partition.entry
        with store.open_input_file(f"{path}/{entry['file']}") as f:
            data = f.read()
        if len(data) != entry["bytes"] or hashlib.sha256(data).hexdigest() != entry["sha256"]:
            raise ValueError(f"damaged file: {entry['file']}")
        units, bits = unpack(data)
        offsets = pa.array(np.arange(len(units) + 1) * bits.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.repeat(entry["part"], len(units)), pa.array(units, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(bits.reshape(-1)))], ["part", "unit", "bits"])


class BitLibrary(DataSource):
    """Options: path; rows (of a file, for writing); parts and expect (JSON lists, for reading)."""

    @classmethod
    def name(cls) -> str:
        return "bit_library"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BitReader:
        lists = {k: json.loads(self.options[k]) if k in self.options else None for k in ("parts", "expect")}
        return BitReader(self.options["path"], lists["parts"], lists["expect"])

    def writer(self, schema: StructType, overwrite: bool) -> BitWriter:
        return BitWriter(self.options["path"], int(self.options.get("rows", 65536)), overwrite)


def write_bits(df: DataFrame, path: str, rows: int = 65536, mode: str = "append") -> None:
    """Write part, unit, bits of ``df``; a task puts a part's rows of one width into files of up to about ``rows``."""
    df.sparkSession.dataSource.register(BitLibrary)
    df.select("part", df["unit"].cast("long"), "bits").write.format("bit_library").mode(mode).option("path", path).option("rows", str(rows)).save()


def read_bits(spark: SparkSession, path: str, parts: list[str] | None = None, expected: list[str] | None = None) -> DataFrame:
    """part, unit, bits of the asked ``parts`` (all, if None), whose files alone are read; ``expected`` are the parts that a whole library has."""
    spark.dataSource.register(BitLibrary)
    reader = spark.read.format("bit_library").option("path", path)
    for name, value in (("parts", parts), ("expect", expected)):
        if value is not None:
            reader = reader.option(name, json.dumps(value))
    return reader.load()
