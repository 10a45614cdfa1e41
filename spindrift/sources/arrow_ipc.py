"""Arrow IPC (Feather) files as a Spark source, a partition for each record batch, columns pruned on request."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema


class _Batches(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def _open(path: str):
    return ipc.open_file(pa.memory_map(path))


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str] | None, per: int):
        self.path, self.columns, self.per = path, columns, per

    def partitions(self):
        n = _open(self.path).num_record_batches
        return [_Batches(self.path, i, min(n, i + self.per)) for i in range(0, n, self.per)] or [_Batches(self.path, 0, 0)]

    def read(self, part):
        file = _open(part.path)
        for i in range(part.first, part.last):
            batch = file.get_batch(i)
            yield batch.select(self.columns) if self.columns else batch


class ArrowIpc(DataSource):
    """Options: path (which all executors must see), columns (comma list), batches (record batches per partition, 1)."""

    @classmethod
    def name(cls):
        return "arrow_ipc"

    def _columns(self):
        listed = self.options.get("columns")
        return [c.strip() for c in listed.split(",")] if listed else None

    def schema(self):
        found = _open(self.options["path"]).schema
        wanted = self._columns()
        return from_arrow_schema(pa.schema([found.field(c) for c in wanted]) if wanted else found)

    def reader(self, schema):
        return _Reader(self.options["path"], self._columns(), int(self.options.get("batches", 1)))


def read(spark: SparkSession, path: str, columns: list[str] | None = None, batches: int = 1) -> DataFrame:
    spark.dataSource.register(ArrowIpc)
    reader = spark.read.format("arrow_ipc").option("path", path).option("batches", batches)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def row_count(path: str) -> int:
    """From the batches' headers."""
    file = _open(path)
    return sum(file.get_batch(i).num_rows for i in range(file.num_record_batches))
