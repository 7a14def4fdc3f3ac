import pytest
from pyspark.sql import functions as F

from platewise.operators import catalog as C
from platewise.operators import correlate as K
from platewise.operators import pixels as P
from platewise.operators import results as R
from platewise.operators import rings as G


def test_pairs(spark):
    rows = [("N1294562768", 1294562768), ("N1294562836", 1294562836), ("W1294562835", 1294562835), ("W1294562949", 1294562949)]
    df = spark.createDataFrame([(0, i, n, k, "BOTSIM") for i, (n, k) in enumerate(rows)], "vol_ord int, row_ord long, img_name string, img_num long, shutter_mode_id string")
    got = [(r["row_ord"], r["grp"], r["place"]) for r in C.pair_exposures(df, keep_unpaired=True).orderBy("row_ord").collect()]
    assert got == [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 3, 0)]
    assert C.pair_exposures(df).count() == 3  # the first is followed by one too far


def test_errors(spark):
    df = spark.createDataFrame([("N1", "V1", 1, 1, 5)], "img_name string, volume string, vol_ord int, row_ord int, img_num long")
    with pytest.raises(ValueError):
        C.volumes(df, ["V9"], ["V1"])
    with pytest.raises(ValueError):
        C.camera(df, "mid")
    with pytest.raises(ValueError):
        P.blocks(df, 2, 2, "mode")
    with pytest.raises(ValueError):
        K.quality(df, df, "best")


def test_tasks(spark):
    f = "struct<image_file_url:string,label_file_url:string,results_path_stub:string>"
    rows = [("n", "sim", [("a", "b", "c")], None), (None, "sim", [], "no_nav_root"), ("n", "x", [], "unknown_dataset"), ("n", "sim", [], "no_files"), ("n", "sim", None, "no_files"), ("n", "sim", [("a", None, None)], "no_label_file_url")]
    df = spark.createDataFrame(rows, f"root string, dataset string, files array<{f}>, want string")
    got = df.select("want", R.task_error(F.col("root"), F.col("dataset"), ("sim",), F.col("files")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_ring_times_and_radii(spark):
    images = spark.createDataFrame([(1, 2009, 90000.0, 150000.0), (2, 2007, 90000.0, 150000.0), (3, 2011, 90000.0, 150000.0)], "image_ord long, obs_year int, min_radius double, max_radius double")
    rows = [(1, 2008, 2010, 100000.0, 101000.0), (2, None, None, 90000.0, 150000.0), (3, None, 2008, 50000.0, 51000.0), (4, 2008, None, 200000.0, None)]
    features = spark.createDataFrame(rows, "feature_key long, start_year int, end_year int, inner_a double, outer_a double")
    found = G.in_time(features, images)
    assert {(r["image_ord"], r["feature_key"]) for r in found.collect()} == {(1, 1), (1, 2), (2, 2), (3, 2), (2, 3), (1, 4), (3, 4)}
    assert {r["feature_key"] for r in G.in_radius(found).collect()} == {1, 2}


def test_shift_finds_itself(spark):
    image = spark.createDataFrame([(0, v, u, float((v * v * 5 + u * u * 3 + v * u) % 17)) for v in range(8) for u in range(8)], "pair long, v long, u long, value double")
    model = image.filter("v BETWEEN 2 AND 5 AND u BETWEEN 2 AND 5").withColumn("v", F.col("v") - 1).withColumn("mask", F.lit(True))
    top = K.surface(image, model, 2).orderBy(F.desc("ncc")).first()
    assert (top["dy"], top["dx"]) == (1, 0) and top["ncc"] == pytest.approx(1.0)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    known = e.queries()
    assert set(e.oracle_sql()) <= set(known)
    assert e.entry(spark).columns[:2] == ["image_ord", "body_ord"]
