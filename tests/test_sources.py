"""Readers on files made here."""

import hashlib
import io
import json
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.feather as feather
import pytest

from spindrift.operators import storage
from spindrift.sources import arrow_ipc, files, manifest


def test_arrow_ipc(spark, tmp_path):
    path = str(tmp_path / "t.feather")
    feather.write_feather(pa.table({"a": list(range(10)), "b": [None, "x"] * 5}), path, chunksize=3, compression="uncompressed")
    df = arrow_ipc.read(spark, path)
    assert df.count() == 10 == arrow_ipc.row_count(path) and df.rdd.getNumPartitions() == 4
    assert arrow_ipc.read(spark, path, ["b"]).columns == ["b"]
    assert df.where("b is null").count() == 5


def test_manifest(spark, tmp_path):
    sources = []
    for role in manifest.ROLES:
        (tmp_path / f"{role}.bin").write_bytes(role.encode())
        sources.append({"role": role, "filename": f"{role}.bin", "size_bytes": len(role), "sha256": hashlib.sha256(role.encode()).hexdigest()})
    m = manifest.load(json.dumps({"dataset": "d", "sources": sources}))
    assert {r.state for r in manifest.verify(spark, m, str(tmp_path)).collect()} == {"ok"}
    (tmp_path / "connectivity.bin").write_bytes(b"Connectivity")
    (tmp_path / "annotations.bin").write_bytes(b"short")
    (tmp_path / "neurotransmitters.bin").unlink()
    states = {r.role: r.state for r in manifest.verify(spark, m, str(tmp_path)).collect()}
    assert states == {"connectivity": "hash", "annotations": "size", "neurotransmitters": "missing"}
    with pytest.raises(ValueError):
        manifest.require(manifest.verify(spark, m, str(tmp_path)))
    with pytest.raises(ValueError):
        manifest.load(json.dumps({"dataset": "d", "sources": sources[:2]}))


def workbook(sheets: dict) -> bytes:
    """A workbook of sheets (name: rows), with the parts that its file format asks for."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings = sorted({c for rows in sheets.values() for row in rows for c in row if isinstance(c, str)})

    def cell(c, i, j):
        where = f"{chr(65 + j)}{i + 1}"
        return "" if c is None else f'<c r="{where}" t="s"><v>{strings.index(c)}</v></c>' if isinstance(c, str) else f'<c r="{where}"><v>{c}</v></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{name}" r:id="rId{i}"/>' for i, name in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i + 1}">' + "".join(cell(c, i, j) for j, c in enumerate(row)) + "</row>" for i, row in enumerate(rows)) + "</sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    path = tmp_path / "columns.xlsx"
    head = ["Column", "L1", "R7", "R8", "Column type"]
    right = [head, ["ME_R_col_21_07", 310, -1, 64, "dim"], [None, 1, 2, 3, "skipped"], ["ME_R_col_03_33", None, 12, None, None]]
    path.write_bytes(workbook({"Right OL": right, "Notes": [["nothing"]], "Left OL": [head, ["ME_L_col_21_07", 8]]}))
    got = {r.column: r for r in files.optic_columns(spark, str(path)).collect()}
    assert len(got) == 3 and got["ME_R_col_21_07"].l1 == 310 and got["ME_R_col_21_07"].r7 is None and got["ME_R_col_21_07"].column_type == "dim"
    assert (got["ME_R_col_03_33"].grid_row, got["ME_R_col_03_33"].grid_column, got["ME_R_col_03_33"].l1) == (3, 33, None)
    for bad in ({"Right OL": right}, {"Right OL": [["Column"], ["ME_L_col_21_07"]], "Left OL": right}, {"Right OL": right, "Left OL": [head]}):
        path.write_bytes(workbook(bad))
        with pytest.raises(ValueError):
            files.optic_columns(spark, str(path))


def test_directions(spark, tmp_path):
    head = "side,column,p,q,forward,right,up,elevation_deg,azimuth_deg,source_raw_p,source_raw_q\n"
    (tmp_path / "d.csv").write_text(head + "R,b,1,1,1.0,0.0,0.0,0.0,0.0,0,1\nR,a,0,1,0.0,1.0,0.0,0.0,90.0,0,1\n")
    df = files.directions(spark, str(tmp_path / "d.csv"))
    assert [r.column for r in df.collect()] == ["a", "b"]
    files.write_directions(df, str(tmp_path / "out"))
    assert files.directions(spark, str(tmp_path / "out")).collect() == df.collect()
    (tmp_path / "bad.csv").write_text(head + "R,b,1,1,1.0,0.5,0.0,0.0,0.0,0,1\n")
    with pytest.raises(Exception, match="inconsistent"):
        files.directions(spark, str(tmp_path / "bad.csv")).collect()


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.array([[[0, 255], [51, 102]]], np.uint8))
    got = {(r.y, r.x): round(r.intensity, 3) for r in files.pixel_frames(spark, str(tmp_path / "f.npy")).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 1.0, (1, 0): 0.2, (1, 1): 0.4}
    np.array([7, 9], "<u4").tofile(tmp_path / "ids.bin")
    assert [r.value for r in files.flat_binary(spark, str(tmp_path / "ids.bin"), "<u4").orderBy("position").collect()] == [7, 9]


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "x": {"y": [1, 2]}}, indent=1))
    assert files.documents(spark, str(tmp_path / "a.json")).first().x.y == [1, 2]
    (tmp_path / "b.json").write_text(json.dumps({"schema_version": 9}))
    with pytest.raises(Exception, match="schema_version"):
        files.documents(spark, str(tmp_path / "b.json")).collect()


def test_graph_sink(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, 4), (0, 2, 2), (1, 2, 3)], "source_index int, target_index int, synapse_count long")
    storage.write_graph(e, "sink_graph", 2)
    assert spark.table("sink_graph_in").count() == spark.table("sink_graph_out").count() == 3
    with pytest.raises(Exception):
        storage.write_graph(e, "sink_graph", 2)
    storage.write_sorted(e, str(tmp_path / "sorted"), "target_index", "source_index", partitions=1)
    assert [r.target_index for r in spark.read.parquet(str(tmp_path / "sorted")).collect()] == [1, 2, 2]
