"""Data sources of result cells: ``spark.read.format("result_cells")`` and a sink that writes once or verifies.

A cell is a folder ``<model>__<planner>__<harness>`` with a ``summary.json``. The paths are
those of a file system that the driver and all executors mount, also written ``file:``.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

NAMES = ("model", "planner", "harness")
CELL_DDL = "model string, planner string, harness string, path string, summary string, issue string"
MANIFEST = "_manifest.json"


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path} is not a path of a mounted file system")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _parts(folder: str) -> dict[str, str | None]:
    """The three parts of a cell's name; what is missing is null, what is too much stays in the last."""
    found = os.path.basename(folder).split("__", len(NAMES) - 1)
    return dict(zip(NAMES, [*found, *[None] * (len(NAMES) - len(found))]))


@dataclass
class CellFile(InputPartition):
    path: str


class CellReader(DataSourceReader):
    """A partition for each cell; filters on the parts of its name choose cells before any file is opened."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("result_cells needs a path")
        self.root, self.wanted = _local(options["path"]), {}

    def pushFilters(self, filters):
        for f in filters:
            names = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if names in NAMES:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[names] = self.wanted.get(names, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        cells = sorted(glob.glob(f"{glob.escape(self.root)}/*/summary.json"))
        kept = [p for p in cells if all(_parts(os.path.dirname(p))[n] in values for n, values in self.wanted.items())]
        return [CellFile(p) for p in kept] or [CellFile("")]

    def read(self, partition: CellFile) -> Iterator[tuple]:
        if not partition.path:
            return
        issue, text = None, None
        try:
            with open(partition.path, encoding="utf-8") as f:
                text = f.read()
            if not isinstance(json.loads(text), dict):
                issue = "no_object"
        except ValueError:
            issue = "invalid_json"
        yield (*_parts(os.path.dirname(partition.path)).values(), partition.path, text, issue)


class ResultCells(DataSource):
    """Rows (``model``, ``planner``, ``harness``, ``path``, ``summary``, ``issue``); a file that holds no JSON object is a row with an issue."""

    @classmethod
    def name(cls) -> str:
        return "result_cells"

    def schema(self) -> str:
        return CELL_DDL

    def reader(self, schema) -> DataSourceReader:
        return CellReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    digest: int


def row_digest(batch: pa.RecordBatch) -> int:
    """Sum of the rows' SHA-256, as a number: the same for the same rows in any order and any batches."""
    total = 0
    for row in batch.to_pylist():
        text = json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
        total += int.from_bytes(hashlib.sha256(text.encode()).digest(), "big")
    return total % (1 << 256)


class OnceWriter(DataSourceArrowWriter):
    """Tasks write lines into a folder of this attempt and digest them; the commit moves it into place, or compares.

    Where the target exists, the rows just written must be those that its manifest names:
    then it stays as it is, otherwise the job fails. Either way the attempt's folder goes.
    """

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("write_once needs a path")
        self.target = _local(options["path"]).rstrip("/")
        self.pending = f"{self.target}.{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.pending, exist_ok=True)
        name, rows, digest = f"part-{uuid.uuid4().hex}.json", 0, 0
        with open(f"{self.pending}/{name}", "w", encoding="utf-8") as f:
            for batch in batches:
                rows, digest = rows + batch.num_rows, (digest + row_digest(batch)) % (1 << 256)
                for row in batch.to_pylist():
                    f.write(json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str) + "\n")
        return Written(name, rows, digest)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        manifest = {"rows": sum(m.rows for m in done), "sha256_sum": f"{sum(m.digest for m in done) % (1 << 256):064x}"}
        if os.path.exists(self.target):
            try:
                with open(f"{self.target}/{MANIFEST}", encoding="utf-8") as f:
                    old = json.load(f)
            finally:
                shutil.rmtree(self.pending, ignore_errors=True)
            if old != manifest:
                raise ValueError(f"{self.target} holds other rows")
            return
        os.makedirs(self.pending, exist_ok=True)
        kept = {m.name for m in done}
        for left in set(os.listdir(self.pending)) - kept:  # of attempts that were lost
            os.remove(f"{self.pending}/{left}")
        with open(f"{self.pending}/{MANIFEST}", "w", encoding="utf-8") as f:
            json.dump(manifest, f, sort_keys=True)
        os.rename(self.pending, self.target)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class WriteOnce(DataSource):
    """``df.write.format("write_once").mode("append").save(path)``: JSON lines that are never overwritten, only confirmed."""

    @classmethod
    def name(cls) -> str:
        return "write_once"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("write_once does not overwrite")
        return OnceWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Both formats in this session; filters reach the reader where the session pushes them to Python sources."""
    spark.dataSource.register(ResultCells)
    spark.dataSource.register(WriteOnce)
