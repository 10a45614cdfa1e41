"""Flat arrays and .npy files of any size, read in splits: a task for each stretch of bytes, whatever file system holds them.

Spark's reader of binary files makes a file one row of at most 2 GB. Here fixed-length records of the Hadoop file system are read
instead: a record is a block of whole elements, of a length that divides the file's, and its offset gives the elements' positions.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a record, at most; of a file whose elements can't be dealt in records of at least LEAST bytes, to be read as one row.
RECORD, LEAST, WHOLE = 1 << 20, 1 << 12, 256 << 20


@dataclass(frozen=True)
class Header:
    """What a .npy file says of itself: element type, shape, and where the elements begin."""

    dtype: np.dtype
    shape: tuple[int, ...]
    start: int


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def size(spark: SparkSession, path: str) -> int:
    where, system = _file(spark, path)
    return system.getFileStatus(where).getLen()


def header(spark: SparkSession, path: str) -> Header:
    """Read once, on the driver, from the file's first bytes. Object arrays, Fortran order and a size that isn't the shape's raise."""
    where, system = _file(spark, path)
    length = system.getFileStatus(where).getLen()
    stream = system.open(where)
    try:
        first = io.BytesIO(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(length, 1 << 14))))
    finally:
        stream.close()
    version = np.lib.format.read_magic(first)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(first)
    if dtype.hasobject or dtype.names or dtype.kind not in "iufb":
        raise ValueError(f"{path}: elements of {dtype} are no numbers")
    if fortran and len(shape) > 1:
        raise ValueError(f"{path}: Fortran order")
    if first.tell() + math.prod(shape) * dtype.itemsize != length:
        raise ValueError(f"{path}: {length} bytes, but shape {shape} of {dtype} after {first.tell()} bytes")
    return Header(dtype, shape, first.tell())


def _record(units: int, itemsize: int) -> int:
    """Elements of a record: the largest number up to RECORD bytes that divides a file of units elements."""
    for d in range(min(units, max(1, RECORD // itemsize)), 1, -1):
        if units % d == 0:
            return d
    return 1


def blocks(spark: SparkSession, path: str, itemsize: int, split_bytes: int = 64 << 20) -> DataFrame:
    """(start, data): the file's bytes in records of whole elements, start being a record's first byte."""
    length = size(spark, path)
    if length % itemsize:
        raise ValueError(f"{path}: {length} bytes aren't whole elements of {itemsize}")
    schema = "start long, data binary"
    if not length:
        return spark.createDataFrame([], schema)
    record = _record(length // itemsize, itemsize) * itemsize
    if record < LEAST and length <= WHOLE:  # elements of an awkward number: one row
        return spark.read.format("binaryFile").load(path).selectExpr("0L AS start", "content AS data")
    conf = {"fixedlengthinputformat.record.length": str(record), "mapreduce.input.fileinputformat.split.maxsize": str(split_bytes)}
    lib, writable = "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io"
    read = spark.sparkContext.newAPIHadoopFile(path, lib, f"{writable}.LongWritable", f"{writable}.BytesWritable", conf=conf)
    return spark.createDataFrame(read.map(lambda row: (row[0], bytes(row[1]))), schema, verifySchema=False)


def _values(found: DataFrame, dtype: np.dtype, start: int) -> DataFrame:
    """(position, value) of the elements from byte start on; whole numbers and truth values as long, others as double."""
    whole = dtype.kind in "iub"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_buffer()
                skip = min(max(0, start - at), len(raw))
                values = np.frombuffer(raw, dtype, offset=skip) if len(raw) > skip else np.empty(0, dtype)
                first = (at + skip - start) // dtype.itemsize
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(values))), pa.array(values.astype(np.int64 if whole else np.float64))], names=["position", "value"])

    return found.mapInArrow(run, f"position long, value {'long' if whole else 'double'}")


def flat(spark: SparkSession, path: str, dtype: str, split_bytes: int = 64 << 20) -> DataFrame:
    """(position, value) of a file of numbers such as <u4 or u1. A size that isn't whole elements raises; an empty file has no rows."""
    kind = np.dtype(dtype)
    return _values(blocks(spark, path, kind.itemsize, split_bytes), kind, 0)


def npy(spark: SparkSession, path: str, dtype: str | None = None, shape: tuple[int | None, ...] | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """(position, value) of a .npy file's elements in C order.

    dtype and shape are what the caller relies on, None in shape standing for any length; a file that departs from them raises at once.
    """
    found = header(spark, path)
    if dtype is not None and found.dtype != np.dtype(dtype):
        raise TypeError(f"{path}: {found.dtype}, not {np.dtype(dtype)}")
    if shape is not None and (len(shape) != len(found.shape) or any(want is not None and want != have for want, have in zip(shape, found.shape, strict=True))):
        raise ValueError(f"{path}: shape {found.shape}, not {shape}")
    return _values(blocks(spark, path, found.dtype.itemsize, split_bytes), found.dtype, found.start)


def indexed(values: DataFrame, shape: tuple[int, ...], *names: str) -> DataFrame:
    """(names, value): positions as an index for each of the shape's sides."""
    if len(names) != len(shape):
        raise ValueError(f"{len(names)} names for shape {shape}")
    columns, rest = [], 1
    for side, name in zip(reversed(shape), reversed(names), strict=True):
        columns.append(f"cast((position div {rest}) % {max(side, 1)} AS int) AS `{name}`")
        rest *= max(side, 1)
    return values.selectExpr(*reversed(columns), "value")
