import numpy as np
import pytest

from traceloom.sources import packages, stacks, workbooks


def test_workbook_round_trip(spark, tmp_path):
    rows = [["time", "Frame", "Frame Number", "ROI A", "ROI A_corrected", "ROI B"], [0, 1, 1, 10, 11, 5], [0.001, 2, 2, 20, 21, None], [0.002, 3, 3, "bad", 31, 7]]
    workbooks.write_workbook(str(tmp_path / "a.xlsx"), {"Recording 1": rows, "Notes": [["text"], ["x"]]})
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    got = workbooks.workbook_samples(workbooks.read_cells(spark, str(tmp_path))).orderBy("trace_id", "idx").collect()
    assert {r["trace_id"] for r in got} == {"Recording 1 | ROI A", "Recording 1 | ROI B"}
    a = [(r["idx"], r["t"], r["raw"], r["corrected_source"]) for r in got if r["trace_id"].endswith("A")]
    assert a == [(0, 0.0, 10.0, 11.0), (1, 0.001, 20.0, 21.0), (2, 0.002, 31.0, 31.0)]


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int16", "int32", "uint32", "float32"])
def test_tiff_round_trip(spark, tmp_path, kind):
    frames = [np.arange(12).reshape(3, 4).astype(kind) + i for i in range(3)]
    assert stacks.write_tiff(str(tmp_path / "s.tif"), iter(frames)) == 3
    (tmp_path / "bad.tif").write_bytes(b"II*\0")
    got = stacks.read_stacks(spark, str(tmp_path)).orderBy("frame").collect()
    assert [r["pixels"] for r in got] == [f.ravel().astype(float).tolist() for f in frames] and got[0]["dtype"] == kind


def test_masks_and_sidecars(spark, tmp_path):
    np.savez(tmp_path / "m.npz", label_image=np.array([[0, 1], [2, 2]]))
    assert sorted((r["mask"], r["label"], r["y"], r["x"]) for r in stacks.read_masks(spark, str(tmp_path)).collect()) == [(0, "MASK01", 0, 1), (1, "MASK02", 1, 0), (1, "MASK02", 1, 1)]
    (tmp_path / "a.metadata.txt").write_text("Width: 30\n% skipped: 1\nComment: 6rois-500hz\nWidth: 60\n\nnonsense\n")
    assert stacks.read_sidecars(spark, str(tmp_path)).first()["fields"] == {"Width": "60", "Comment": "6rois-500hz"}


def test_package_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("t", 0, 1.0, True), ("t", 1, float("nan"), False)], "trace_id string, idx long, v double, ok boolean")
    packages.write_package({"samples": df}, str(tmp_path / "p"), {"k": 1})
    manifest, tables = packages.read_package(spark, str(tmp_path / "p"))
    assert manifest["settings"] == {"k": 1} and tables["samples"].count() == 2
    packages.export_csv(df, str(tmp_path / "c"), ["v"])
    back = spark.read.option("header", "true").csv(str(tmp_path / "c"))
    assert back.columns == ["v", "trace_id", "idx", "ok"] and back.where("v is null").count() == 1
    packages.wide_traces(df, "v", ["t"]).coalesce(1).write.option("header", "true").csv(str(tmp_path / "w"))
    assert packages.read_csv_long(spark, str(tmp_path / "w"), ["idx"]).count() == 2


def test_arrays_of_traces(spark, tmp_path):
    for name, meta in (("a", '{"trace_name": "Rec | ROI 01", "sampling_rate_hz": 500.0}'), ("b", None), ("bad", "{}"), ("none", "{")):
        (tmp_path / name).mkdir()
        if meta is not None:
            (tmp_path / name / "metadata.json").write_text(meta)
    np.savez(tmp_path / "a" / "arrays.npz", time=[0.0, 2.0, 4.0], corrected=[1.0, 2.0, np.nan], plateau_mask=[True, False])
    np.savez(tmp_path / "b" / "arrays.npz", time=np.zeros(0), raw=np.zeros(0))
    (tmp_path / "bad" / "arrays.npz").write_bytes(b"no archive")
    np.savez(tmp_path / "none" / "arrays.npz", raw=[7.0])
    got = packages.read_trace_arrays(spark, str(tmp_path), ["time", "raw", "plateau_mask"]).orderBy("trace_id", "idx").collect()
    assert [tuple(r) for r in got] == [("Rec | ROI 01", 0, 500.0, 0.0, 1.0, 1.0), ("Rec | ROI 01", 1, 500.0, 2.0, 2.0, 0.0), ("Rec | ROI 01", 2, 500.0, 4.0, None, None), ("none", 0, None, None, 7.0, None)]
