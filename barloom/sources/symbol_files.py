"""Text files by symbol as a data source of its own: `spark.read.format("barloom_csv")`.

It gives (symbol, line) from both layouts, `<SYMBOL>.csv` and `symbol=<SYMBOL>/*.csv`, and writes the second. What
lines mean stays with `csv_bars`, whose parsing and cleaning run on top, JVM-side.

* Reading. Filters on `symbol` (=, IN, LIKE 'x%') choose files before any is opened. Large files are cut at `splitBytes`
  (128 MB) into ranges of whole lines, small ones share a task. Names that begin with "_" or "." are hidden.
* Writing. Each task writes to a hidden folder; when all are done, the driver moves the files in place, and a failed write leaves
  nothing behind. Rows sorted by symbol give one open file at a time. `header` names a first line for every file. NULL
  symbols are an error, NULL lines are empty ones. Overwriting removes the files that were there before.

Paths are those of Arrow's file systems (local, file:, hdfs:, s3:, gs:). `register` makes the format known to a session.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull,
    StringStartsWith, WriterCommitMessage,
)

from barloom.functions.parsing import trimmed
from barloom.schemas import MINOR_UNITS
from barloom.sources import csv_bars

NAME = "barloom_csv"
SPLIT = 128 << 20  # bytes of a task
OPENING = 4 << 20  # bytes that opening a file counts for, as in Spark's own sources
CHUNK = 4 << 20  # bytes read at once


def _opened(path: str):
    """(file system, path on it)."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def _listed(fs, root: str) -> list[tuple[str, int]]:
    """(file, bytes) of every visible text file below a folder, or the file itself."""
    from pyarrow.fs import FileSelector, FileType

    info = fs.get_file_info(root)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(root)
    found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
    hidden = lambda p: any(x[:1] in ("_", ".") for x in p[len(root) :].strip("/").split("/") if x)
    return sorted((i.path, i.size) for i in found if i.type == FileType.File and i.path.endswith(".csv") and not hidden(i.path))


def symbol_of(file: str) -> str:
    folder, name = posixpath.split(file)
    key, _, value = posixpath.basename(folder).partition("=")
    return unquote(value) if key == "symbol" and value else name.removesuffix(".csv")


def _after_line(f, at: int, size: int) -> int:
    """Where the line that holds the byte `at` ends."""
    while at < size:
        f.seek(at)
        some = f.read(1 << 16)
        cut = some.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(some)
    return size


def _lines(f, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines that begin in a range of bytes, some at a time."""
    size = f.size()
    at = _after_line(f, start - 1, size) if start else 0
    stop, rest = _after_line(f, end - 1, size), b""
    while at < stop:
        f.seek(at)
        some = f.read(min(CHUNK, stop - at))
        at += len(some)
        whole, newline, tail = some.rpartition(b"\n")
        if newline:
            yield (rest + whole + newline).splitlines()
            rest = tail
        else:
            rest += some
    if rest:
        yield rest.splitlines()


@dataclass
class Ranges(InputPartition):
    """(file, symbol, first byte, end) of each range of a task."""

    pieces: list[tuple[str, str, int, int]]


class Reader(DataSourceReader):
    def __init__(self, path: str, symbol: str | None, split: int) -> None:
        self.path, self.symbol, self.split = path, symbol, split
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, IsNotNull)) and f.attribute == ("symbol",):
                self.wanted.append(f)
            else:
                yield f

    def _keeps(self, symbol: str) -> bool:
        for f in self.wanted:
            if isinstance(f, In):
                held = symbol in f.value
            elif isinstance(f, StringStartsWith):
                held = symbol.startswith(f.value)
            else:
                held = isinstance(f, IsNotNull) or symbol == f.value
            if not held:
                return False
        return True

    def partitions(self) -> list[Ranges]:
        out, held, size = [], [], 0
        for file, n in _listed(*_opened(self.path)):
            symbol = self.symbol or symbol_of(file)
            if not n or not self._keeps(symbol):
                continue
            for start in range(0, n, self.split):
                end = min(n, start + self.split)
                if held and size + end - start + OPENING > self.split:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((file, symbol, start, end))
                size += end - start + OPENING
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        fs, _ = _opened(self.path)
        for file, symbol, start, end in partition.pieces:
            with fs.open_input_file(file) as f:
                for lines in _lines(f, start, end):
                    try:
                        text = pa.array(lines, pa.binary()).cast(pa.string())
                    except pa.ArrowInvalid:
                        text = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
                    yield pa.record_batch([pa.array([symbol] * len(lines), pa.string()), text], ["symbol", "line"])


@dataclass
class Staged(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, header: str | None, overwrite: bool) -> None:
        self.path, self.header, self.overwrite = path, header, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = _opened(self.path)
        files, now, out = [], None, None
        try:
            for batch in iterator:
                for symbol, line in zip(*(batch.column(c).to_pylist() for c in ("symbol", "line"))):
                    if symbol is None:
                        raise ValueError("a symbol is NULL")
                    if out is None or symbol != now:
                        if out is not None:
                            out.close()
                        folder = f"symbol={quote(symbol, safe='')}"
                        fs.create_dir(f"{root}/{self.staging}/{folder}")
                        files.append(f"{folder}/{uuid.uuid4().hex}.csv")
                        now, out = symbol, fs.open_output_stream(f"{root}/{self.staging}/{files[-1]}", buffer_size=1 << 20)
                        if self.header:
                            out.write(self.header.encode() + b"\n")
                    out.write((line or "").encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = _opened(self.path)
        fs.create_dir(root)
        before = _listed(fs, root) if self.overwrite else []
        for file in (f for m in messages if m for f in m.files):
            fs.create_dir(posixpath.dirname(f"{root}/{file}"))
            fs.move(f"{root}/{self.staging}/{file}", f"{root}/{file}")
        for file, _ in before:
            fs.delete_file(file)
        self._clean(fs, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean(*_opened(self.path))

    def _clean(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/{self.staging}").type != FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


class SymbolFiles(DataSource):
    """Options: path; reading: symbol (of all files), splitBytes; writing: header."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "symbol string, line string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"].rstrip("/"), self.options.get("symbol"), int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"].rstrip("/"), self.options.get("header"), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SymbolFiles)


def load(spark: SparkSession, path: str, symbol: str | None = None, **options) -> DataFrame:
    """`csv_bars.load` from this source; a filter on the symbols of the result prunes files."""
    register(spark)
    reader = spark.read.format(NAME)
    raw = (reader.option("symbol", symbol) if symbol else reader).load(path)
    return csv_bars.bars(csv_bars.parsed(raw.filter(F.length(trimmed(F.col("line"))) > 0), **options))


def save(bars_in_minor_units: DataFrame, path: str, units: int = MINOR_UNITS, mode: str = "overwrite") -> None:
    """Write bars as text: whole or not at all, one folder per symbol."""
    register(bars_in_minor_units.sparkSession)
    out = csv_bars.printed(bars_in_minor_units, units)
    header = [c for c in out.columns if c != "symbol"]
    lines = out.sort("symbol", "Date").select("symbol", F.concat_ws(",", *header).alias("line"))
    lines.write.format(NAME).option("header", ",".join(header)).mode(mode).save(path)
