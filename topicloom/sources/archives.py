"""Python data sources for files that Spark's own readers take whole: members of zip archives (S7) and features of GeoJSON collections (S10, S11), each file read by many tasks.

Paths are local ones or any URI that pyarrow's file systems open; a folder stands for all files in it.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range of a collection, and of the members of an archive that one task reads.
RANGE_BYTES = 32 << 20
#: Ranges smaller than RANGE_BYTES grow where a folder would have more than so many.
MOST_RANGES = 1024
_BLOCK = 1 << 20
#: How a feature begins in the files of common writers; raw quotes cannot stand in a JSON string, so no text matches.
_FEATURE = re.compile(rb'\{\s*"type"\s*:\s*"Feature"\s*[,}]')
_FEATURES = re.compile(rb'"features"\s*:\s*\[')
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}]', re.S)
_GAP = re.compile(rb"[\s,]*")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:(/+)", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes, names that begin with . or _ left out."""
    system, inner = _located(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    shown = [f for f in found if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(inner) :].split("/") if p)]
    prefix = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((prefix + f.path, f.size) for f in shown)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class _Members(InputPartition):
    path: str
    names: tuple[str, ...]


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[_Range]:
        files = _files(self.path)
        step = max(self.bytes, min(RANGE_BYTES, -(-sum(size for _, size in files) // MOST_RANGES))) if self.bytes else 1 << 62
        return [_Range(path, at, min(at + step, size)) for path, size in files for at in range(0, max(size, 1), step)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """The features of a range: from the first recognised start in it to the first one behind it. A feature that is written otherwise belongs to the range of the one before."""
        if not partition.path:
            return
        system, inner = _located(partition.path)
        with system.open_input_file(inner) as f:
            size, held, at, place, searched = f.size(), b"", partition.start, 0, 0  # held: the bytes from `at` on, of which `place` are done with
            block_bytes = min(_BLOCK, max(1 << 16, partition.stop - partition.start))

            def more() -> bool:
                nonlocal held, at, place
                f.seek(at + len(held))
                block = f.read(block_bytes)
                held, at, place = held[place:] + block, at + place, 0
                return bool(block)

            pattern = _FEATURES if partition.start == 0 else _FEATURE
            while not (first := pattern.search(held, searched)):
                searched = max(0, len(held) - 256)
                if at + searched >= partition.stop and partition.start or not more():
                    return
            if partition.start and at + first.start() >= partition.stop:
                return
            place = first.end() if partition.start == 0 else first.start()
            while True:
                place = _GAP.match(held, place).end()
                while place == len(held):
                    if not more():
                        return
                    place = _GAP.match(held, place).end()
                if held[place : place + 1] != b"{":
                    return  # the end of the collection
                if at + place >= partition.stop:
                    while len(held) - place < 512 and more():
                        pass
                    if _FEATURE.match(held, place):
                        return
                end = self._end(held, place)
                while end is None:
                    if not more():
                        raise ValueError(f"{partition.path}: a feature is cut short")
                    end = self._end(held, place)
                yield (partition.path, at + place, held[place:end].decode())
                place = end
                if place == len(held) and at + place >= size:
                    return

    @staticmethod
    def _end(held: bytes, place: int) -> int | None:
        """Where the object at a place ends, None if that is not among these bytes."""
        depth = 0
        for token in _TOKEN.finditer(held, place):
            depth += {b"{": 1, b"}": -1}.get(token.group(), 0)
            if depth == 0:
                return token.end()
        return None


class FeatureSource(DataSource):
    """path, position (byte) and feature (JSON text). Option rangebytes: 0 reads each file in one task, which files need whose features hold objects of type Feature themselves."""

    @classmethod
    def name(cls) -> str:
        return "geojson_features"

    def schema(self) -> str:
        return "path string, position long, feature string"

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(self.options)


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[_Members]:
        """Members of some `rangebytes` together; the driver reads the archives' directories alone."""
        out = []
        for path, _ in _files(self.path):
            system, inner = _located(path)
            with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                held, size = [], 0
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    held.append(info.filename)
                    size += info.file_size
                    if size >= self.bytes:
                        out.append(_Members(path, tuple(held)))
                        held, size = [], 0
                if held:
                    out.append(_Members(path, tuple(held)))
        return out or [_Members("", ())]

    def read(self, partition: _Members) -> Iterator[tuple]:
        if not partition.names:
            return
        system, inner = _located(partition.path)
        with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
            for name in partition.names:
                yield (partition.path, name, z.read(name))


class MemberSource(DataSource):
    """archive, member and content of every member."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(FeatureSource)
    spark.dataSource.register(MemberSource)


def write_zips(members, path: str, name: str, content: str):
    """A job that writes each partition of a DataFrame as one archive path/part-<number>.zip of its rows (name, content), and gives archive and number of members of each. A repeated task replaces its own archive."""
    import pyarrow as pa
    from pyspark import TaskContext

    def write(batches):
        number = TaskContext.get().partitionId()
        system, inner = _located(path)
        system.create_dir(inner, recursive=True)
        target, count = f"{inner.rstrip('/')}/part-{number:05}.zip", 0
        with system.open_output_stream(f"{target}.{TaskContext.get().taskAttemptId()}_") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    z.writestr(n, c or b"")
                    count += 1
        system.move(f"{target}.{TaskContext.get().taskAttemptId()}_", target)
        yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([count], pa.int64())], ["archive", "members"])

    return members.selectExpr(f"`{name}` AS name", f"CAST(`{content}` AS BINARY) AS content").mapInArrow(write, "archive string, members long")
