"""What the text operators share: tables on shared storage, bounded Arrow slices, column hygiene."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators.storage import discard, materialize  # noqa: F401  for the operators here

#: Bytes of text that one Arrow slice may hold; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo: the folds of the query contracts. A null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def slices(batch: pa.RecordBatch, text: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds at most budget bytes of text, or one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + budget, side="right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def texts_of(batch: pa.RecordBatch, text: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(text)).to_pylist()


def bytes_of(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]


def add_columns(df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list[pa.Array]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) with columns computed from Arrow slices. A column of the same name gives way."""
    from pyspark.sql.pandas.types import to_arrow_schema

    taken = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                old = [part.column(part.schema.get_field_index(c)) for c in kept]
                new = compute(part)
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip([*old, *new], out, strict=True)], schema=out)
        old = new = part = batch = None
        tidy()

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def tidy() -> None:
    """Give freed memory back to the system: idle workers wait on beside the JVM for their next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class TwoGenerations(dict):
    """A memo of bounded size: when the young half is full it becomes the old one; what is asked for again comes back."""

    def __init__(self, compute: Callable, capacity: int, longest: int = 256):
        super().__init__()
        self.compute, self.capacity, self.longest, self.old = compute, capacity, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.capacity:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


_memos: dict[str, Callable[[], None]] = {}


def sole_memo(owner: str, drop: Callable[[], None]) -> None:
    """Have only one operator's memo in a worker process: workers live on from stage to stage, and their memory is bounded together."""
    if owner not in _memos:
        for other in list(_memos.values()):
            other()
        _memos.clear()
        tidy()
        _memos[owner] = drop
