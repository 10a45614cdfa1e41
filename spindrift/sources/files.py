"""Small structured files: workbooks, direction tables, pixel sequences, flat binary arrays, JSON documents."""

from __future__ import annotations

import io
import math
import re
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.scalars import LABEL

#: Sheets of a column workbook that hold data, and their sides. Fixed values.
SHEETS = {"Right OL": "R", "Left OL": "L"}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _letters(reference: str) -> int:
    """0-based column of a cell reference such as AB12."""
    at = 0
    for c in re.match("[A-Z]+", reference)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def workbook_rows(data: bytes) -> dict[str, list[list[str | None]]]:
    """Cells of every sheet as text; cells that aren't there are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(_MAIN + "t")) for item in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_MAIN + "si")]
        target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(_PACKAGE + "Relationship")}
        sheets = {}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
            where = target[sheet.get(_REL)]
            where = where.lstrip("/") if where.startswith("/") else f"xl/{where}"
            rows = []
            for row in ET.fromstring(z.read(where)).iter(_MAIN + "row"):
                cells: list[str | None] = []
                for i, cell in enumerate(row.iter(_MAIN + "c")):
                    at = _letters(cell.get("r")) if cell.get("r") else i
                    cells += [None] * (at + 1 - len(cells))
                    value = cell.find(_MAIN + "v")
                    if cell.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                rows.append(cells)
            sheets[sheet.get("name")] = rows
        return sheets


COLUMN_FIELDS = "column string, side string, grid_row int, grid_column int, l1 long, r7 long, r8 long, column_type string"


def optic_columns(spark: SparkSession, path: str) -> DataFrame:
    """COLUMN_FIELDS of a column workbook (columns: column, L1, R7, R8, column_type). Negative ids mean none; repeated labels and a missing or empty sheet of an eye raise."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]  # one workbook
    found = []
    for name, rows in workbook_rows(bytes(data)).items():
        if name not in SHEETS or not rows:
            continue
        header = {re.sub("[^a-z0-9]+", "_", (h or "").strip().lower()): i for i, h in enumerate(rows[0])}
        cell = lambda row, key: row[header[key]] if key in header and header[key] < len(row) else None  # noqa: B023, E731
        number = lambda row, key: None if (x := cell(row, key)) in (None, "") or float(x) < 0 else int(float(x))  # noqa: B023, E731
        for row in rows[1:]:
            label = (cell(row, "column") or "").strip()
            if not label:
                continue
            m = re.match(LABEL, label)
            if not m or m[1] != SHEETS[name]:
                raise ValueError(f"{name}: {label!r} is no label of this sheet")
            found.append((label, m[1], int(m[2]), int(m[3]), number(row, "l1"), number(row, "r7"), number(row, "r8"), cell(row, "column_type")))
    if len({f[0] for f in found}) != len(found):
        raise ValueError("a column label occurs twice")
    if {f[1] for f in found} != set(SHEETS.values()):
        raise ValueError(f"a workbook has the sheets {', '.join(SHEETS)}")
    return spark.createDataFrame(sorted(found), COLUMN_FIELDS)


DIRECTIONS = "side string, column string, p int, q int, forward double, right double, up double, elevation_deg double, azimuth_deg double, source_raw_p int, source_raw_q int"


def directions(spark: SparkSession, path: str, tolerance: float = 1e-6) -> DataFrame:
    """Measured unit directions per column, by side, q, p. Rows that contradict themselves or repeat a column raise while they're read."""
    rows = spark.read.csv(path, schema=DIRECTIONS, header=True).withColumn("times", F.count("*").over(Window.partitionBy("column")))
    norm = F.sqrt(F.col("forward") ** 2 + F.col("right") ** 2 + F.col("up") ** 2)
    good = (F.abs(norm - 1) <= tolerance) & (F.abs(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("up"))))) - F.col("elevation_deg")) <= math.degrees(tolerance) * 10) & (F.abs(F.degrees(F.atan2("right", "forward")) - F.col("azimuth_deg")) <= math.degrees(tolerance) * 10)
    good &= F.col("times") == 1
    return rows.withColumn("column", F.when(F.coalesce(good, F.lit(False)), F.col("column")).otherwise(F.raise_error(F.concat(F.lit("inconsistent direction of "), F.coalesce("column", F.lit("?")))).cast("string"))).drop("times").orderBy("side", "q", "p")


def write_directions(df: DataFrame, path: str) -> None:
    """CSV whose doubles read back as they were."""
    df.select(*[f.split()[0] for f in DIRECTIONS.split(", ")]).orderBy("side", "q", "p").write.option("header", True).mode("errorifexists").csv(path)


def pixel_frames(spark: SparkSession, path: str, most_frames: int = 3_600, most_pixels: int = 1 << 22) -> DataFrame:
    """(frame, y, x, intensity) of .npy sequences: frames x height x width (x 3), bytes or 0..1 doubles; one task per file.

    Sequences without a pixel, with more than most_frames images or most_pixels pixels in each raise while they're read.
    """
    if not path.endswith(".npy"):
        raise ValueError("pixel sequences are .npy files")

    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                raw = np.load(io.BytesIO(content), allow_pickle=False)
                if raw.ndim not in (3, 4) or raw.ndim == 4 and raw.shape[3] != 3:
                    raise ValueError(f"shape {raw.shape} is no pixel sequence")
                if not raw.size or len(raw) > most_frames or raw.shape[1] * raw.shape[2] > most_pixels:
                    raise ValueError(f"shape {raw.shape} is beyond the limits")
                values = raw / 255.0 if raw.dtype == np.uint8 else raw.astype(np.float64)
                if not np.isfinite(values).all() or values.min(initial=0) < 0 or values.max(initial=0) > 1:
                    raise ValueError("intensities must lie in 0 to 1")
                for number, image in enumerate(values.mean(3) if raw.ndim == 4 else values):
                    y, x = np.indices(image.shape)
                    yield pd.DataFrame({"frame": np.int32(number), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "intensity": image.ravel()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "frame int, y int, x int, intensity double")


def flat_binary(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """(position, value) of a file of little-endian numbers such as <u4 or u1."""

    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                values = np.frombuffer(content, np.dtype(dtype)).astype(np.int64)
                yield pd.DataFrame({"position": np.arange(len(values)), "value": values})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "position long, value long")


def documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents that span lines; those with a schema_version other than 1 raise while they're read."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(path)
    if "schema_version" not in rows.columns:
        raise ValueError("no schema_version")
    return rows.withColumn("schema_version", F.when(F.col("schema_version") == 1, F.col("schema_version")).otherwise(F.raise_error(F.lit("unknown schema_version")).cast(rows.schema["schema_version"].dataType)))


def vectors(spark: SparkSession, path: str, sided: bool = False) -> DataFrame:
    """(side, p, q, x, y, z) of a CSV file of raw vectors; without sides (columns p, q instead of raw_p, raw_q) side is null.

    A number that isn't one raises while it's read, and an empty table at once.
    """
    rows = spark.read.option("header", True).csv(path)
    if rows.isEmpty():
        raise ValueError(f"no vectors in {path}")
    whole = lambda c, name: F.col(c).cast("int").alias(name)  # noqa: E731  ANSI casts raise
    side = F.col("side") if sided else F.lit(None).cast("string")
    return rows.select(side.alias("side"), whole("raw_p" if sided else "p", "p"), whole("raw_q" if sided else "q", "q"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
