"""Registries and turn files as Spark data sources, for batches and streams.

    register(spark)
    spark.read.format("registry").load(folder)
    spark.readStream.format("rttm").load(folder)

A file is read in one piece by one task (a quoted cell may hold line breaks, so a registry cannot be cut), line by
line; small files share a task. Streams take files in the order of their modification times, then paths, and
remember the last one: files must be moved into the folder complete, and not dated back.
"""

from __future__ import annotations

import csv
import io
import sys

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from earshot.sources.registry import COLUMNS

TASK_BYTES = 32 << 20
ROWS = 2_000
TURNS = "file_id string, speaker_id string, start double, end double"


def _listed(path: str) -> list[tuple[int, str, int]]:
    """(modification time, path, size) of the files under path, oldest first; names that begin with . or _ are left out."""
    system, at = fs.FileSystem.from_uri(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


class Bundle(InputPartition):
    """Files of one task."""

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def _bundles(files: list[tuple[int, str, int]]) -> list[Bundle]:
    out, held = [], 0
    for _, path, size in files:
        if not out or held + size > TASK_BYTES:
            out.append(Bundle([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


def records(lines, sep: str = "|"):
    """Cells of each record, trimmed. Blank lines and lines that begin with # are left out, but not inside a quoted cell."""
    csv.field_size_limit(sys.maxsize)
    inside = False

    def counted():
        nonlocal inside
        for line in lines:
            if inside or (line.strip() and not line.lstrip().startswith("#")):
                inside = True
                yield line

    for cells in csv.reader(counted(), delimiter=sep, skipinitialspace=True):
        inside = False
        yield [c.strip() for c in cells]


def _registry_rows(lines, path: str, names: list[str], options: dict):
    """Values of the schema's columns by the file's own header; missing ones are ''."""
    header = None
    for cells in records(lines, options.get("sep", "|")):
        if header is None:
            header = {c: k for k, c in reversed(list(enumerate(cells)))}
            continue
        at = (header.get(n) for n in names)
        yield tuple(cells[k] if k is not None and k < len(cells) else "" for k in at)


def _number(cell: str) -> float | None:
    try:
        return float(cell)
    except ValueError:
        return None


def _turns(lines, path: str, names: list[str], options: dict):
    """SPEAKER lines with two numbers and a speaker; end is start plus duration."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for line in lines:
        cells = line.split()
        if len(cells) > 7 and cells[0] == "SPEAKER":
            start, length = _number(cells[3]), _number(cells[4])
            if start is not None and length is not None:
                yield stem, cells[7], start, start + length


class _Rows:
    """What readers of batches and of streams share: the rows of a bundle as Arrow batches."""

    def __init__(self, schema, options: dict, rows):
        self.schema, self.options, self.rows, self.path = schema, dict(options), rows, options["path"]

    def read(self, bundle: Bundle):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, names = to_arrow_schema(self.schema), self.schema.names
        system, _ = fs.FileSystem.from_uri(self.path)
        held: list = []
        for path in bundle.paths:
            with system.open_input_stream(path) as raw, io.TextIOWrapper(io.BufferedReader(raw), "utf-8-sig", errors="replace", newline="") as lines:
                for row in self.rows(lines, path, names, self.options):
                    held.append(row)
                    if len(held) == ROWS:
                        yield self._batch(held, schema)
                        held = []
        if held:
            yield self._batch(held, schema)

    def _batch(self, rows: list, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class _Reader(_Rows, DataSourceReader):
    def partitions(self):
        return _bundles(_listed(self.path)) or [Bundle([])]


class _StreamReader(_Rows, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.path)
        return {"modified": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        after, upto = ((x["modified"], x["path"]) for x in (start, end))
        return _bundles([f for f in _listed(self.path) if after < f[:2] <= upto])


class _Source(DataSource):
    def reader(self, schema):
        return _Reader(schema, self.options, self.rows)

    def streamReader(self, schema):
        return _StreamReader(schema, self.options, self.rows)


class RegistrySource(_Source):
    """Delimited files with a header each. Columns: those of the given schema (texts), else COLUMNS. Option: sep."""

    rows = staticmethod(_registry_rows)

    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)


class TurnSource(_Source):
    """(file_id, speaker_id, start, end) of RTTM files."""

    rows = staticmethod(_turns)

    @classmethod
    def name(cls) -> str:
        return "rttm"

    def schema(self) -> str:
        return TURNS


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RegistrySource)
    spark.dataSource.register(TurnSource)
