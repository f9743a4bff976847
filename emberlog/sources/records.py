"""Files of fixed-length records, and xz files of several streams, as data sources that many tasks read."""

from __future__ import annotations

import lzma
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this module
UTMP = 384  # bytes of a record of a login database
_KINDS = ("EMPTY", "RUN_LVL", "BOOT_TIME", "NEW_TIME", "OLD_TIME", "INIT_PROCESS", "LOGIN_PROCESS", "USER_PROCESS", "DEAD_PROCESS")
_PIECE = 1 << 20
_TASKS, _RECORDS = 1000, 1 << 20  # tasks from which a task reads more records than asked for, and up to how many


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[fs.FileInfo]:
    """A file, or the files of a folder and of those in it, in order of their names."""
    store, at = _store(path)
    info = store.get_file_info(at)
    found = store.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class Stretch(InputPartition):
    """Bytes ``start`` to ``stop`` of a file; ``first``: the number of the first record or stream there; ``streams``: where
    each of several streams there starts and stops."""

    path: str
    start: int
    stop: int
    first: int
    streams: tuple[tuple[int, int], ...] = ()

    def __post_init__(self) -> None:
        super().__init__(None)


class _Ranges(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def _open(self, part: Stretch) -> pa.NativeFile:
        store, _ = _store(self.path)
        return store.open_input_file(part.path)


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


class UtmpReader(_Ranges):
    def __init__(self, path: str, records: int, rotated: bool) -> None:
        super().__init__(path)
        self.records, self.rotated = records, rotated

    def partitions(self) -> list[Stretch]:
        """A partition for so many records, or for more where these would be very many partitions; records are read in pieces
        whatever their number. What is left of a torn record at the end of a file isn't read."""
        out, before = [], {}
        files = _files(self.path)
        records = max(self.records, min(-(-sum(f.size // UTMP for f in files) // _TASKS), _RECORDS))
        for f in files:
            n, folder = f.size // UTMP, f.path.rpartition("/")[0]
            first = before.get(folder, 0) if self.rotated else 0
            out += [Stretch(f.path, a * UTMP, min(a + records, n) * UTMP, first + a) for a in range(0, n, records)]
            before[folder] = first + n
        return out

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        with self._open(part) as file:
            file.seek(part.start)
            left, number = (part.stop - part.start) // UTMP, part.first
            while left:
                raw = file.read(min(left, _PIECE // UTMP) * UTMP)
                rows = []
                for i in range(0, len(raw) - UTMP + 1, UTMP):
                    rec = raw[i : i + UTMP]
                    kind, sec = struct.unpack_from("<h", rec)[0], struct.unpack_from("<I", rec, 340)[0]
                    user = _text(rec[44:76])
                    if user:
                        name = _KINDS[kind] if 0 <= kind < len(_KINDS) else str(kind & 0xFFFF)
                        rows.append((part.path, number + i // UTMP, sec * 1_000_000, user, name, _text(rec[8:40]), _text(rec[76:332])))
                read = len(raw) // UTMP
                number += read
                left = left - read if read else 0
                kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), *[pa.string()] * 4)
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "n", "time_utc", "user", "type", "line", "host"])


class UtmpSource(DataSource):
    """Login databases: ``spark.read.format("utmp").load(path)``; option ``records``: how many a task reads, or more
    where that makes over a thousand tasks; ``rotated``: whether files of one folder are one database, in order of their names, so that ``n`` goes on."""

    @classmethod
    def name(cls) -> str:
        return "utmp"

    def schema(self) -> str:
        return "path string, n long, time_utc timestamp, user string, type string, line string, host string"

    def reader(self, schema: object) -> UtmpReader:
        return UtmpReader(self.options["path"], int(self.options.get("records", 100_000)), self.options.get("rotated", "false") == "true")


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not b & 0x80:
            return value, at


def xz_streams(file: pa.NativeFile, size: int) -> list[tuple[int, int]] | None:
    """(start, stop) of the streams of an xz file, from the indexes at their ends; null if the file is damaged or cut."""
    stop, out = size, []
    try:
        while stop > 0:
            file.seek(stop - 12)
            foot = file.read(12)
            if not any(foot[-4:]):
                stop -= 4  # padding between streams
                continue
            if foot[10:] != b"YZ":
                return None
            index = (struct.unpack_from("<I", foot, 4)[0] + 1) * 4
            file.seek(stop - 12 - index)
            raw = file.read(index)
            count, at = _varint(raw, 1)
            blocks = 0
            for _ in range(count):
                unpadded, at = _varint(raw, at)
                _, at = _varint(raw, at)
                blocks += -(-unpadded // 4) * 4
            start = stop - 12 - index - blocks - 12
            if start < 0:
                return None
            file.seek(start)
            if file.read(6) != b"\xfd7zXZ\x00":
                return None
            out.append((start, stop))
            stop = start
    except (IndexError, OSError, struct.error):
        return None
    return out[::-1]


class XzReader(_Ranges):
    def __init__(self, path: str, suffix: str, least: int) -> None:
        super().__init__(path)
        self.suffix, self.least = suffix, least

    def _stretches(self, path: str, streams: list[tuple[int, int]]) -> Iterator[Stretch]:
        a = 0
        for i, (_, stop) in enumerate(streams):
            if stop - streams[a][0] >= self.least or i + 1 == len(streams):
                yield Stretch(path, streams[a][0], stop, a, tuple(streams[a : i + 1]))
                a = i + 1

    def partitions(self) -> list[Stretch]:
        """Streams of a file that follow each other, of so many bytes together or one that has more; a damaged file is one."""
        store, _ = _store(self.path)
        out = []
        for f in _files(self.path):
            if f.path.endswith(self.suffix) and f.size:
                with store.open_input_file(f.path) as file:
                    streams = xz_streams(file, f.size)
                out += self._stretches(f.path, streams or [(0, f.size)])
        return out

    def read(self, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        """Lines of the streams in the stretch, ``whole`` telling whether a line's end was seen; the first line of a stream
        may go on where the one before ended. A damaged stream gives the lines up to the damage."""
        with self._open(stretch) as file:
            for i, (start, stop) in enumerate(stretch.streams):
                yield from self._stream(file, Stretch(stretch.path, start, stop, stretch.first + i))

    def _stream(self, file: pa.NativeFile, part: Stretch) -> Iterator[pa.RecordBatch]:
        file.seek(part.start)
        left, rest, n, reader = part.stop - part.start, b"", 0, lzma.LZMADecompressor()
        pending = b""
        while left > 0 or pending:
            raw = pending or file.read(min(left, _PIECE))
            left -= 0 if pending else len(raw)
            if not raw:
                break
            pending = b""
            try:
                pieces = (rest + reader.decompress(raw)).split(b"\n")
            except (lzma.LZMAError, EOFError):
                break
            if reader.eof:  # only where a file is read as a whole
                pending, reader = reader.unused_data.lstrip(b"\0"), lzma.LZMADecompressor()
            rest = pieces.pop()
            yield self._batch(part, n, pieces, True)
            n += len(pieces)
        if rest:
            yield self._batch(part, n, [rest], False)

    def _batch(self, part: Stretch, n: int, lines: list[bytes], whole: bool) -> pa.RecordBatch:
        k = len(lines)
        columns = [pa.array([part.path] * k, pa.string()), pa.array([part.first] * k, pa.int32()), pa.array(range(n, n + k), pa.int64()), pa.array(lines, pa.binary()), pa.array([whole] * k, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["path", "stream", "n", "line", "whole"])


class XzSource(DataSource):
    """Lines of xz files by stream: ``spark.read.format("xz_lines").option("suffix", suffix).load(path)``; option ``bytes``:
    how many a task reads at least, if the file has as many."""

    @classmethod
    def name(cls) -> str:
        return "xz_lines"

    def schema(self) -> str:
        return "path string, stream int, n long, line binary, whole boolean"

    def reader(self, schema: object) -> XzReader:
        return XzReader(self.options["path"], self.options.get("suffix", ".xz"), int(self.options.get("bytes", 4 << 20)))


def read_utmp(spark: SparkSession, path: str, records: int = 100_000, rotated: bool = False) -> DataFrame:
    """(path, n, time_utc, user, type, line, host) of login databases of any size, ``records`` records a task, or as
    many more as make a thousand tasks; records without a user are left out, as is a torn one at the end. ``rotated``: files of one folder, in order of their names, are
    one database, whose numbers go on. Paths are local or URIs that Arrow's file systems know."""
    spark.dataSource.register(UtmpSource)
    return spark.read.format("utmp").option("records", records).option("rotated", str(rotated).lower()).load(path)


def read_xz(spark: SparkSession, path: str, suffix: str = ".xz") -> DataFrame:
    """(path, line_no, line) of xz files, a task for each 4 MB of streams, or for a longer one. A line that goes over the border of two streams is put
    together again; files that are damaged give the lines up to the damage."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    spark.dataSource.register(XzSource)
    rows = spark.read.format("xz_lines").option("suffix", suffix).load(path).withColumn("line", F.col("line").cast("string"))  # bytes as they are, until lines are whole
    # what a stream ends with, without a line break, belongs before the first line of the next; the few such rows are looked at alone
    sizes = rows.groupBy("path", "stream").agg(F.count_if("whole").alias("ends"), F.max(F.when(~F.col("whole"), F.col("line"))).alias("tail"))
    by_stream = Window.partitionBy("path").orderBy("stream")
    broken = F.sum("ends").over(by_stream.rowsBetween(Window.unboundedPreceding, -1))
    run = sizes.withColumn("before", F.coalesce(broken, F.lit(0)))
    # tails gather over streams that hold no line break, up to the one whose first line ends
    tails = run.where("tail is not null").select("path", F.col("before") + F.col("ends"), F.struct("stream", "tail")).toDF("path", "line_at", "part")
    glued = tails.groupBy("path", "line_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["tail"]), "").alias("head"))
    counted = rows.where("whole").join(run.select("path", "stream", "before"), ["path", "stream"]).select("path", (F.col("before") + F.col("n")).alias("at"), "line")
    got = counted.join(glued, (counted["path"] == glued["path"]) & (counted["at"] == glued["line_at"]), "full")
    line = F.regexp_replace(F.make_valid_utf8(F.concat(F.coalesce("head", F.lit("")), F.coalesce("line", F.lit("")))), "\\r$", "")
    return got.select(F.coalesce(counted["path"], glued["path"]).alias("path"), (F.coalesce("at", "line_at") + 1).alias("line_no"), line.alias("line"))
