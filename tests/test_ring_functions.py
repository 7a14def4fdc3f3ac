import math

import pytest
from pyspark.sql import functions as F

from platewise.functions import rings as R

MODE = "struct<mode:int,a:double,ae:double,long_peri:double,rate_peri:double,amplitude:double,phase:double,pattern_speed:double>"


def test_modes(spark):
    rows = [([(1, 1000.0, 10.0, 180.0, 86400.0, None, None, None), (2, None, None, None, None, 3.0, 90.0, 0.0), (95, None, None, None, None, 1.0, 1.0, 1.0)],), ([(2, 5.0, 1.0, 0.0, 0.0, None, None, None)],), ([],)]
    got = spark.createDataFrame(rows, f"m array<{MODE}>").select(R.radial_modes(F.col("m")).alias("r"), R.base_radius(F.col("m")).alias("b"), R.modes_legal(F.col("m")).alias("ok")).collect()
    assert [len(g["r"]) for g in got] == [2, 1, 0] and [g["b"] for g in got] == [1000.0, None, None] and [g["ok"] for g in got] == [True, False, True]
    assert got[0]["r"][0]["long_peri"] == pytest.approx(math.pi) and got[0]["r"][0]["rate_peri"] == pytest.approx(math.pi / 180) and got[0]["r"][1]["phase"] == pytest.approx(math.pi / 2)


def test_edge_radius_and_units(spark):
    df = spark.createDataFrame([(0.0, 100.0, 10.0, 0.0, 90.0, 0.0), (math.pi / 2, 100.0, 10.0, 0.0, 90.0, 1.0), (1.0, 100.0, 0.0, 5.0, 0.0, 3.0), (0.0, 0.0, 5.0, 0.0, 0.0, 0.0)], "t double, a double, ae double, p double, r double, d double")
    got = [r[0] for r in df.select(R.edge_radius(*(F.col(c) for c in ("t", "a", "ae", "p", "r", "d")))).collect()]
    assert got == pytest.approx([90.0, 90.0, 100.0, 0.0])
    x = spark.createDataFrame([(math.pi, "rad", "x", 699), (math.pi, None, "LONGITUDE", None), (2.0, "km", "RADIUS", None)], "v double, u string, n string, k int")
    rows = x.select(R.in_degrees(F.col("v"), F.col("u"), F.col("n")).alias("d"), R.body_id(F.col("n"), F.col("k"), F.lit(True)).alias("i")).collect()
    assert [r["d"] for r in rows] == pytest.approx([180.0, 180.0, 2.0]) and rows[0]["i"] == 699 and 10000 <= rows[1]["i"] < 30000
    with pytest.raises(Exception, match="unknown body (LONGITUDE|RADIUS)"):
        x.select(R.body_id(F.col("n"), F.col("k")).alias("i")).collect()
