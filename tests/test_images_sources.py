import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assaykit.functions.pixels import apply_lookup, window_level
from assaykit.operators import images as I
from assaykit.sources import images as SI
from assaykit.sources import labels as L
from assaykit.sources import results as R


def png(pixels):
    """An 8-bit gray PNG."""
    h, w = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(row) for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def frame(spark, arrays):
    return spark.createDataFrame([(str(i), [int(x) for x in a.ravel()]) for i, a in enumerate(arrays)], "image_file string, pixels array<int>")


def test_window(spark):
    hu = [-1000.0, -20.0, 39.9, 40.0, 99.99, 100.0, 2000.0]
    got = spark.createDataFrame([(hu,)], "p array<double>").select(window_level(F.col("p")).alias("x")).first().x
    want = np.clip((np.array(hu) - -20.0) * (255.0 / 120.0), 0, 255).astype(np.uint8)
    assert got == want.tolist()


def test_histograms_and_matching(spark):
    rng = np.random.default_rng(0)
    pool = [rng.integers(0, 120, (16, 16)) for _ in range(6)] + [np.zeros((4, 4), int), np.full((4, 4), 255)]
    refs = [rng.integers(90, 256, (16, 16)) for _ in range(5)]
    df, ref = frame(spark, pool), frame(spark, refs)
    hists = {r.image_file: r.hist for r in I.histograms(df).collect()}
    assert all(hists[str(i)] == np.bincount(a.ravel(), minlength=256).tolist() for i, a in enumerate(pool))
    mean = np.mean([np.bincount(a.ravel(), minlength=256) for a in refs], axis=0)
    agg = {r.bin: r["mean"] for r in I.aggregate_histogram(ref.repartition(3)).collect()}
    assert np.allclose([agg[b] for b in range(256)], mean)
    for r in I.harmonise(df, ref).collect():
        before, after = pool[int(r.image_file)].ravel(), np.array(r.matched)
        # one value for each gray level, and in the same order
        order = np.argsort(before, kind="stable")
        assert (np.diff(after[order]) >= 0).all() and len(set(zip(before.tolist(), after.tolist()))) == len(set(before.tolist()))


def matched(spark, reference, image, how):
    return how(frame(spark, [np.array(image)]), frame(spark, [np.array(reference)])).first().matched


def test_matching_by_hand(spark):
    # half the reference is 0, half 200: matched to one image, only these two levels come out
    assert matched(spark, [0, 200], [10, 20], I.match_image) == [0, 200]
    assert matched(spark, [0, 200], [10, 10, 10, 20], I.match_image) == [100, 100, 100, 200]
    # the average curve has a knot at every level: the plateau from 0 to 199 ends at 199, the one from 200 at 255
    assert matched(spark, [0, 200], [10, 20], I.harmonise) == [199, 255]
    same = [3, 7, 7, 250]
    assert matched(spark, same, same, I.match_image) == same


def test_levels_out_of_range_are_errors(spark):
    for bad in ([256], [-1]):
        for job in (I.histograms, I.aggregate_histogram, lambda x: I.match_histogram(x, [1] * 256)):
            with pytest.raises(Exception, match="pixel values"):
                job(frame(spark, [np.array(bad)])).collect()


def test_lookup_is_applied_per_pixel(spark):
    got = spark.range(1).select(apply_lookup(F.array(F.lit(2), F.lit(0)), F.array(F.lit(5), F.lit(6), F.lit(7))).alias("x")).first().x
    assert got == [7, 5]


def test_empty_reference_is_an_error(spark):
    with pytest.raises(ValueError):
        I.reference_levels(frame(spark, [np.zeros((1, 1), int)]).limit(0))


def test_image_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (3, 5)), rng.integers(0, 256, (2, 2))
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.png").write_bytes(png(a))
    (tmp_path / "sub" / "two.PNG").write_bytes(png(b))
    (tmp_path / "three.JPEG").write_bytes(b"x")
    (tmp_path / "notes.txt").write_text("x")
    listed = {(r.image_file, r.stem) for r in SI.list_images(spark, str(tmp_path)).collect()}
    assert listed == {("one.png", "one"), ("two.PNG", "two"), ("three.JPEG", "three")}
    r = SI.read_images(spark, str(tmp_path)).first()
    assert (r.image_file, r.h, r.w, bytes(r.pixels)) == ("one.png", 3, 5, bytes(a.astype(np.uint8).ravel()))
    hist = I.histograms(SI.read_images(spark, str(tmp_path))).first().hist
    assert hist == np.bincount(a.ravel(), minlength=256).tolist()
    total = I.aggregate_histogram(SI.read_images(spark, str(tmp_path))).agg(F.sum("total")).first()[0]
    assert total == a.size


# -- label files --------------------------------------------------------------


def test_wide_labels(spark, tmp_path):
    head = "PatientNumber,SliceNumber,Intraventricular,Intraparenchymal,Subarachnoid,Epidural,Subdural,No_Hemorrhage,Fracture_Yes_No"
    rows = ["49.0,1.0,0,1.0,0,0,1,0,1", "49,2,0,0,0,0,0,1,0", "49,3,0,0,0,0,0,0,0", "49,4,1,0,0,0,0,1,0"]
    path = tmp_path / "wide.csv"
    path.write_bytes(b"\xef\xbb\xbf" + "\n".join([head, *rows]).encode())
    got = {r.slice: r for r in L.read_wide_labels(spark, str(path)).collect()}
    assert (got[1].patient, got[1].IPH, got[1].SDH, got[1].any_hemorrhage, got[1].is_normal, got[1].present_subtypes) == (49, 1, 1, 1, False, "IPH; SDH")
    assert got[2].is_normal and not got[3].is_normal and got[3].any_hemorrhage == 0
    assert not got[4].is_normal and got[4].any_hemorrhage == 1
    assert got[4].IVH == 1


def test_long_labels(spark):
    rows = [("ID_a_b_epidural", 1), ("ID_a_b_any", 1), ("ID_c_subdural", 0), ("ID_c_any", 1)]
    df = spark.createDataFrame(rows, "ID string, Label int")
    got = {r.image_id: r for r in L.long_labels(df).collect()}
    assert got["ID_a_b"].EDH == 1 and got["ID_a_b"].present_subtypes == "EDH" and not got["ID_a_b"].is_normal
    assert got["ID_c"].is_normal and got["ID_c"].any_hemorrhage == 0 and got["ID_c"].IPH == 0
    clash = df.union(spark.createDataFrame([("ID_c_subdural", 1)], df.schema))
    with pytest.raises(PySparkException, match="conflicting"):
        L.long_labels(clash).collect()
    assert {r.image_id: r.SDH for r in L.long_labels(clash, duplicates="keep").collect()}["ID_c"] == 1


def test_listing_and_stems(spark):
    df = spark.createDataFrame([("pngs/pngs/ID_s1/ID_x/IM_0000-ID_7e9-a.b.png",)], "path string")
    r = L.parse_listing(df).withColumn("stem", L.image_stem("path")).first()
    assert (r.study_id, r.image_id, r.stem) == ("ID_s1", "ID_7e9-a.b", "IM_0000-ID_7e9-a.b")


def test_manifest_types_and_duplicates(spark, tmp_path):
    head = "image_file,patient,slice,any_hemorrhage,is_normal,present_subtypes,IPH,IVH,SAH,EDH,SDH,Fracture,No_Hemorrhage"
    (tmp_path / "m.csv").write_text(f"{head}\na.png,1,1,1,False,IPH,1,0,0,0,0,,0\nb.png,1,2,0,True,,0,0,0,0,0,1,1\n")
    got = {r.image_file: r for r in L.read_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert got["a.png"].is_normal is False and got["b.png"].is_normal is True and got["a.png"].Fracture is None
    (tmp_path / "d.csv").write_text(f"{head}\na.png,1,1,1,False,IPH,1,0,0,0,0,,0\na.png,1,2,0,True,,0,0,0,0,0,1,1\n")
    with pytest.raises(PySparkException, match="duplicate key"):
        L.read_manifest(spark, str(tmp_path / "d.csv")).collect()


# -- result logs --------------------------------------------------------------


def test_log_with_blank_broken_and_keyless_lines(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    with open(path, "w") as f:
        f.write('{"image_file": "a"}\n\n{"image_file": "b", "x"\nnot json\n{"run": 1}\n{"image_file": "c", "n": [1]}\n{"image_file": "a"}\n')
    assert sorted(r.image_file for r in R.done_keys(spark, path).collect()) == ["a", "c"]


def test_scoring_keeps_all_rows_and_significance_the_last(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    with open(path, "w") as f:
        for seq, k, p in ((1, "a", 0), (2, "a", 1), (3, "b", None)):
            f.write(json.dumps({"seq": seq, "image_file": k, "pred_any_hem": p}) + "\n\n")
    df = R.read_results(spark, path)
    assert df.count() == 3
    assert {r.image_file: r.pred_any_hem for r in R.last_per_key(df).collect()} == {"a": 1, "b": None}


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_column_subset_writers(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "x", 2.5)], "a int, b string, c double")
    R.write_table(df, str(tmp_path / fmt), ["b", "a"], fmt)
    back = spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt))
    assert sorted(back.columns) == ["a", "b"] and back.count() == 1
    with pytest.raises(ValueError):
        R.write_table(df, str(tmp_path / "z"), ["a"], "xml")


def test_missing_run_is_reported(spark, tmp_path):
    path = str(tmp_path / "runs")
    R.write_results(spark.createDataFrame([("r1", "a")], "run string, image_file string"), path)
    R.write_results(spark.createDataFrame([("r2", "a")], "run string, image_file string"), path)
    assert sorted(d for d in os.listdir(path) if d.startswith("run=")) == ["run=r1", "run=r2"]
    runs = spark.createDataFrame([("r1",), ("r9",)], "run string")
    assert {r.run: r.found for r in R.read_run_table(spark, path, runs).collect()} == {"r1": True, "r9": False}


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [0.6, 0.8])], "image_file string, embedding array<double>")
    R.write_index(df, str(tmp_path / "i"))
    back = R.read_index(spark, str(tmp_path / "i"))
    assert back.schema["embedding"].dataType.simpleString() == "array<float>" and back.count() == 1
