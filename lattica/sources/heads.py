"""A data source of file heads: what a file's first bytes say, of any number of files, without reading the files.

    spark.dataSource.register(FileHeads)
    spark.read.format("file_heads").load(folder)

Partitions are lists of files. A task opens each, reads the first bytes, and of images the few more that say how large they are: it
seeks from header to header, so what is read does not grow with the file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD = 32
SCHEMA = "path string, length long, head binary, width int, height int"
# fixed values: JPEG markers without a body, and those that begin a frame, which says its size
BARE = {0x01, *range(0xD0, 0xD9)}
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or an address, and the path there."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(path)


def image_size(file, head: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, WebP or JPEG image, or None for anything else and for what is cut off. file: open, can seek."""
    try:
        if head.startswith(b"\x89PNG\r\n\x1a\n") and head[12:16] == b"IHDR":
            return struct.unpack(">II", head[16:24])
        if head.startswith((b"GIF87a", b"GIF89a")):
            return struct.unpack("<HH", head[6:10])
        if head.startswith(b"RIFF") and head[8:12] == b"WEBP":
            return webp_size(head)
        if head.startswith(b"\xff\xd8\xff"):
            return jpeg_size(file)
    except (struct.error, IndexError):
        pass
    return None


def webp_size(head: bytes) -> tuple[int, int] | None:
    """Of the three kinds of WebP: lossy, lossless, extended."""
    kind = head[12:16]
    if kind == b"VP8 " and head[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", head[26:30])
        return width & 0x3FFF, height & 0x3FFF
    if kind == b"VP8L" and head[20] == 0x2F:
        (bits,) = struct.unpack("<I", head[21:25])
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X":
        return tuple(int.from_bytes(head[k : k + 3].ljust(3, b"\0"), "little") + 1 for k in (24, 27))
    return None


def jpeg_size(file) -> tuple[int, int] | None:
    """From the first frame's header; segments before it, however long, are skipped by seeking."""
    at = 2
    while True:
        file.seek(at)
        mark = file.read(4)
        if len(mark) < 4 or mark[0] != 0xFF:
            return None
        if mark[1] == 0xFF or mark[1] in BARE:  # a filling byte, or a marker alone
            at += 1 if mark[1] == 0xFF else 2
            continue
        if mark[1] in FRAMES:
            height, width = struct.unpack(">HH", file.read(5)[1:])
            return width, height
        if mark[1] in (0xD9, 0xDA):  # the end, or data before any frame
            return None
        at += 2 + int.from_bytes(mark[2:], "big")


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("file_heads needs a path")
        self.path = options["path"]
        self.deep = options.get("recursive", "false").lower() == "true"
        self.most = max(1, int(options.get("filespartition", options.get("filesPerPartition", "256"))))

    def partitions(self) -> list[Files]:
        """Names and lengths, as the store lists them; hidden files, whose names begin with . or _, are left out."""
        store, path = file_system(self.path)
        info = store.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(path, recursive=self.deep))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[:1] not in "._")
        return [Files(files[k : k + self.most]) for k in range(0, len(files), self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        rows = []
        for path, length in partition.files:
            with store.open_input_file(path) as file:
                head = file.read(HEAD)
                rows.append((path, length, head, *(image_size(file, head) or (None, None))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32()))], names=["path", "length", "head", "width", "height"])


class FileHeads(DataSource):
    """Options: path (a file or a folder), recursive (false), filesPerPartition (256). Rows: path, length, head (the first 32 bytes),
    width and height (of images)."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadReader:
        return HeadReader({k: v for k, v in self.options.items()})


def file_heads(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("recursive", str(recursive).lower()).load(path)


def write_files(df: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """A file for each row in the folder, with a binary column's bytes. A file appears whole or not at all: it is written under a
    hidden name and moved, so a task that runs again leaves the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        store.create_dir(folder, recursive=True)
        n = 0
        for batch in batches:
            for own, raw in zip(*(c.to_pylist() for c in batch.columns)):
                hidden = f"{folder}/.{own}.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(raw or b"")
                store.move(hidden, f"{folder}/{own}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
