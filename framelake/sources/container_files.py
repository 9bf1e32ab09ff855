"""Container files as a data source that reads and writes, `framelake_container`.

Reading: a file is cut into splits of `splitBytes` (64 MB). A split looks for the first page that begins in it, by its magic and its checksum, and reads the
pages that begin before its end; a packet belongs to the split in which it begins, which follows it as far as it goes, so that every packet is read
once wherever the cuts are. Rows: path, serial, at (place in the file of the page on which the packet ends), place (its number among those
that end there), flags and granule of that page, payload, error. Damage is a row with an error and null for the rest: `invalid page` where no
page begins or `wrong checksum`; reading goes on with the next whole page. A tail that is too short to be a page ends the file.
Of several streams in a file the first one is read (`streams` = `first`), or each (`all`). Packets that never end, that the next page of their stream does not
continue, and continuations of nothing are left out; empty packets are rows. (A page that stands whole inside a packet may be taken
for one where a split begins within that packet.)

Writing: rows (stream_id, page_seq, page), all of a stream in one task and ascending, to one file for each stream, `<stream_id>.ogg`. Tasks write below a
temporary folder; the commit moves the files into place, and an abort deletes what was written, so that no reader sees a part of a file."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from framelake.functions.container import CONTINUED, FIRST, HEADER_BYTES, PAGE

NAME = "framelake_container"
ROWS = "path string, serial long, at long, place int, flags int, granule decimal(20,0), payload binary, error string"
_SCHEMA = pa.schema([
    ("path", pa.string()), ("serial", pa.int64()), ("at", pa.int64()), ("place", pa.int32()), ("flags", pa.int32()), ("granule", pa.decimal128(20, 0)), ("payload", pa.binary()), ("error", pa.string()),
])
_MAGIC = PAGE.encode()
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
LONGEST_PAGE = HEADER_BYTES + 255 + 255 * 255


def checksum(page: bytes) -> int:
    """Of a page, as if its checksum bytes were zero: the remainder of zlib with the bits of every byte and of the result mirrored, from 0 on."""
    bare = (page[:22] + bytes(4) + page[26:]).translate(_MIRROR)
    return int(f"{zlib.crc32(bare, 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


@dataclass
class Page:
    at: int
    end: int
    flags: int
    granule: int
    serial: int
    segments: bytes
    payload: bytes


class Pages:
    """Pages of one open file."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size = file, size
        self.held, self.start = b"", 0

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place, through a buffer of some pages."""
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(min(self.size - at, max(n, 4 * LONGEST_PAGE)))
        return self.held[at - self.start : at - self.start + n]

    def page(self, at: int) -> Page | str | None:
        """The page that begins here, what is wrong with it, or None where the file ends within it."""
        head = self.read(at, HEADER_BYTES)
        if head[:4] != _MAGIC[: len(head)]:
            return "invalid page"
        if len(head) < HEADER_BYTES:
            return None
        segments = self.read(at + HEADER_BYTES, head[26])
        end = at + HEADER_BYTES + head[26] + sum(segments)
        if end > self.size or len(segments) < head[26]:
            return None
        whole = self.read(at, end - at)
        number = lambda a, b: int.from_bytes(whole[a:b], "little")
        if checksum(whole) != number(22, 26):
            return "wrong checksum"
        return Page(at, end, whole[5], number(6, 14), number(14, 18), segments, whole[HEADER_BYTES + head[26] :])

    def next(self, at: int, end: int) -> int | None:
        """Where the first whole page begins from a place on, before the end."""
        while at < end:
            found = self.read(at, min(LONGEST_PAGE, self.size - at)).find(_MAGIC)
            if found < 0:
                at += LONGEST_PAGE - 3
                continue
            at += found
            if at >= end:
                return None
            if isinstance(self.page(at), Page):
                return at
            at += 1
        return None


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    size: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    local = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes, self.all = options["path"], int(options.get("splitBytes", 64 << 20)), options.get("streams", "first") == "all"

    def partitions(self) -> list[Split]:
        system, path = opened(self.path)
        found = system.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f for f in files if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(path) :].split("/"))), key=lambda f: f.path)
        return [Split(f.path, a, min(a + self.bytes, f.size), f.size) for f in files for a in range(0, f.size, self.bytes)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as file:
            rows, held = [], 0
            for row in packets(Pages(file, partition.size), partition.start, partition.end, self.all):
                rows.append((partition.path, *row))
                held += len(row[5] or b"") + 100
                if held > 1 << 22:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def packets(pages: Pages, start: int, end: int, every: bool) -> Iterator[tuple]:
    """The packets that begin on a page that begins in [start, end): serial, at, place, flags, granule, payload, error."""
    wrong = lambda at, why: (None, at, None, None, None, None, why)
    first = pages.page(0)
    if not isinstance(first, Page) or not first.flags & FIRST:
        if start == 0 and pages.size and first is not None:
            yield wrong(0, first if isinstance(first, str) else "invalid page")
        if not every:
            return
    at = 0 if start == 0 and isinstance(first, Page) else pages.next(start, end)
    opened_: dict[int, list[bytes]] = {}  # what has begun and not yet ended, by stream
    while at is not None and (at < end or opened_):
        page = pages.page(at)
        if page is None:
            return
        if isinstance(page, str):
            if at < end:
                yield wrong(at, page)
            at = pages.next(at + 1, end if not opened_ else pages.size)
            continue
        at = page.end
        if page.at >= end and page.serial not in opened_:
            continue
        if not every and page.serial != first.serial:
            continue
        body = opened_.pop(page.serial, None)
        continues = bool(page.flags & CONTINUED)
        if not continues:
            body = None  # what the page doesn't continue is dropped
        skip = continues and body is None
        whose, place, byte, current = body is not None, 0, 0, body if body is not None else []
        for n in page.segments:
            current.append(page.payload[byte : byte + n])
            byte += n
            if n < 255:
                if not skip and (whose or page.at < end):
                    yield page.serial, page.at, place, page.flags, page.granule, b"".join(current), None
                skip, whose, current, place = False, False, [], place + 1
        if current and not skip and (whose or page.at < end):
            opened_[page.serial] = current


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # stream, file


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.temporary = f"{opened(self.path)[1].rstrip('/')}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, _ = opened(self.path)
        system.create_dir(self.temporary, recursive=True)
        files: list[tuple[str, str]] = []
        out, stream, last = None, None, -1
        try:
            for stream_id, page_seq, page in iterator:
                if stream_id is None or page is None:
                    raise ValueError("a page or its stream is null")
                if out is None or str(stream_id) != stream:
                    if out:
                        out.close()
                    if any(str(stream_id) == s for s, _ in files):
                        raise ValueError(f"the pages of stream {stream_id} aren't together")
                    stream, last = str(stream_id), -1
                    files.append((stream, f"{self.temporary}/{uuid.uuid4().hex}"))
                    out = system.open_output_stream(files[-1][1])
                if page_seq <= last:
                    raise ValueError(f"the pages of stream {stream_id} don't ascend")
                last = page_seq
                out.write(bytes(page))
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        streams = [s for s, _ in files]
        if len(set(streams)) < len(streams):
            self.abort(messages)
            raise ValueError("pages of one stream came from several tasks")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        system.create_dir(path, recursive=True)
        for stream, file in files:
            system.move(file, f"{path.rstrip('/')}/{stream}.ogg")
        self._clear(system)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(opened(self.path)[0])

    def _clear(self, system: fs.FileSystem) -> None:
        if system.get_file_info(self.temporary).type == fs.FileType.Directory:
            system.delete_dir(self.temporary)


class Container(DataSource):
    """Options: path; splitBytes and streams for reading."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        if [f.name for f in schema] != ["stream_id", "page_seq", "page"]:
            raise ValueError("rows to write are stream_id, page_seq and page")
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> str:
    """Make the source known to a session; its name."""
    spark.dataSource.register(Container)
    return NAME
