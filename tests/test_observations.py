import pytest
from pyspark.sql import functions as F

from platewise.functions import times as T
from platewise.operators import correlate as K
from platewise.operators import planes as A
from platewise.operators import results as R
from platewise.operators import rings as G
from platewise.operators import trials as J


def test_times(spark):
    rows = [("2000-01-01 11:58:55.816", 0.0, "2000-01-01T11:58:55.816"), ("2016-12-31 23:59:59.5", None, "2016-12-31T23:59:59.500"), ("2017-01-01 00:00:00.25", None, "2017-01-01T00:00:00.250"), ("1972-03-01", None, "1972-03-01T00:00:00.000"), ("no time", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, utc string, et double, text string").withColumn("e", T.et_from_utc(F.col("utc"))).withColumn("t", T.utc_from_et(F.col("e")))
    got = df.orderBy("i").collect()
    assert abs(got[0]["e"]) < 1e-3 and [r["t"] for r in got] == [r["text"] for r in got]
    # The second between the second and third time is a leap second.
    assert got[2]["e"] - got[1]["e"] == pytest.approx(1.75)
    leap = spark.createDataFrame([(got[1]["e"] + 1.25,)], "e double").select(T.utc_from_et(F.col("e"))).first()[0]
    assert leap == "2016-12-31T23:59:60.750"
    zone = spark.range(1).select(T.now()).first()[0]
    assert zone[10] == "T"


def test_elapsed(spark):
    us = [0, 1_500_000, 86_400_000_000, 3 * 86_400_000_000 + 3_661_000_001]
    df = spark.createDataFrame([(u,) for u in us], "us long").select(T.elapsed(F.timestamp_micros(F.lit(0).cast("long")), F.timestamp_micros("us")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["0:00:00", "0:00:01.500000", "1 day, 0:00:00", "3 days, 1:01:01.000001"]


def test_configured_features(spark):
    mode = {"mode": 1, "a": 100000, "rms": 1.0, "ae": 2.0, "long_peri": 3.0, "rate_peri": 4.0}
    config = {"epoch": "2000-01-01", "feature_width": 30, "min_fade_width_multiplier": 3, "note": "text", "gap": {"feature_type": "GAP", "name": "A", "inner_data": [mode]}, "odd": {"feature_type": "ARC", "outer_data": [mode]}, "bad": {"feature_type": "RINGLET", "inner_data": []}}
    f = G.configured_features(spark, config)
    assert sorted(r["feature_key"] for r in f.collect()) == ["bad", "gap", "odd"]
    assert [r["feature_key"] for r in G.valid_mode_features(f).collect()] == ["gap"]


def test_edge_fade_is_the_mean_of_the_fade(spark):
    # Against a fine sum over the pixel.
    rows = [(1000.0 + k * 0.35, above, width, res) for k in range(-12, 13) for above in (True, False) for width in (0.5, 3.0) for res in (0.8, 2.0)]
    df = spark.createDataFrame(rows, "r double, above boolean, w double, res double").withColumn("s", G.edge_fade(F.col("r"), F.lit(1000.0), F.col("above"), F.col("w"), F.col("res")))
    for x in df.collect():
        n = 4000
        at = [x["r"] - x["res"] / 2 + (i + 0.5) * x["res"] / n for i in range(n)]
        way = [(a - 1000.0) * (1 if x["above"] else -1) for a in at]
        assert x["s"] == pytest.approx(sum(1 - d / x["w"] for d in way if 0 <= d <= x["w"]) / n, abs=2e-3)


def test_planes_by_configuration_and_documents(spark, tmp_path):
    px = spark.createDataFrame([(1, 0, 0, 5.0)], "image_ord long, v long, u long, value double")
    with pytest.raises(ValueError, match="no units"):
        A.configured_planes(px, [{"name": "x", "method": "m"}], {})
    with pytest.raises(ValueError, match="unknown method"):
        A.configured_planes(px, [{"name": "x", "method": "m", "units": "km"}], {})
    table = A.plane_table(px.withColumn("plane", F.lit("far")), px.withColumn("body_id", F.lit(0)), {"far": "km"})
    A.write_planes(table, f"{tmp_path}/planes")
    back = spark.read.parquet(f"{tmp_path}/planes")
    assert [(r["PLANE"], r["units"], r["value"]) for r in back.collect()] == [("FAR", "km", 5.0)]
    docs = R.result_documents(spark.createDataFrame([("v1/a", "success", None), ("v2/b", "error", "x")], "results_path_stub string, status string, why string"), "set")
    R.write_documents(docs, f"{tmp_path}/docs")
    assert {(r["volume"], r["document"]) for r in spark.read.parquet(f"{tmp_path}/docs").collect()} == {("v1", '{"status":"success"}'), ("v2", '{"status":"error","why":"x"}')}


def test_exact_median(spark):
    for xs in ([3.0], [1.0, 2.0], [5.0, 1.0, 9.0, 9.0, None], [2.0] * 7, [float(i * i % 97) for i in range(100)], [0.0, 1e9, 1.0]):
        clean = sorted(x for x in xs if x is not None)
        want = (clean[(len(clean) - 1) // 2] + clean[len(clean) // 2]) / 2
        assert J.exact_median(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 4).first()[0] == want
    assert J.exact_median(spark.createDataFrame([], "x double"), "x").first()[0] is None


def test_bounded_peaks(spark):
    rows = [(0, y, x, 0.0) for y in range(-3, 4) for x in range(-3, 4)]
    value = {(0, 0): 5.0, (1, 1): 4.0, (2, 0): 3.0, (-2, -2): 2.5, (3, 3): 9.0}
    df = spark.createDataFrame([(p, y, x, value.get((y, x), v)) for p, y, x, v in rows], "pair long, dy int, dx int, ncc double")
    got = [(r["dy"], r["dx"]) for r in K.bounded_peaks(df, (0, 0), (3, 3), 5, 1).orderBy("place").collect()]
    # (3, 3) lies on the border, (1, 1) in the square of (0, 0), (2, 0) next to it; after (-2, -2) no peak is unique.
    assert got == [(0, 0), (-2, -2)]
