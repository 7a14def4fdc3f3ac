import math

import pytest
from pyspark.sql import functions as F

from platewise.functions import formats as X
from platewise.functions import names as N


def values(spark, rows, schema, f):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(f(F.col("x")).alias("y")).collect()]


def test_strip_zeros(spark):
    assert values(spark, ["", "0000000000", "0000000001", "0000000010", "00000000ff"], "x string", N.strip_zeros) == ["", "0", "1", "10", "ff"]


def test_ra(spark):
    got = values(spark, [math.radians(x) for x in (0, 14, 359, 360, -1)], "x double", X.ra_hms)
    assert got == ["00h00m00.000s", "00h56m00.000s", "23h56m00.000s", "00h00m00.000s", None]


def test_dec(spark):
    got = values(spark, [math.radians(x) for x in (179, 180, -180, -14)], "x double", X.dec_dms)
    assert got == ["+179d00m00.000s", "-180d00m00.000s", "+180d00m00.000s", "-014d00m00.000s"]


def test_texts(spark):
    assert values(spark, [0.5, -1.25, 2.0, 0.1000001], "x double", X.offset_text) == ["0.5", "-1.25", "2", "0.1"]
    assert values(spark, [1.0, None], "x double", X.five_decimals) == ["1.00000", ""]
    assert values(spark, ["gK5III", None, "M2"], "x string", X.spectral_class) == ["K5", "XX", "M2"]
    assert values(spark, ["1294561143w", "N1294561143_1.IMG"], "x string", N.lid_part) == ["294561143w1", "1294561143n"]
    assert values(spark, ["N1294561143", "N12"], "x string", N.bundle_directory) == ["1294xxxxxx/129456xxxx/", ""]


SPECS = [
    ("coiss", "data/1294561143_1295221348/W1294561143_1.IMG", "W1294561143_1", "ok", 1294561143),
    ("coiss", "data/129456_1295221348/W1294561143_1.IMG", None, "error", None),
    ("gossi", "G1/IO/C0349673965R.LBL", "C0349673965R", "ok", 349673965),
    ("gossi", "REDO/EARTH/C0349673965R.LBL", "C0349673965R", "ok", 349673965),
    ("gossi", "EARTH/C0349673965R.TXT", None, "skip", None),
    ("gossi", "NOWHERE/C0349673965R.LBL", None, "error", None),
    ("nhlorri", "data/20150714_029914/lor_0299147641_0x630_sci.lbl", "lor_0299147641", "ok", 299147641),
    ("nhlorri", "data/20150714_029914/lor_0299147641_0x630_sci.fit", None, "error", None),
    ("vgiss", "DATA/C20621XX/C2062133_GEOMED.LBL", "C2062133", "ok", 2062133),
    ("vgiss", "DATA/C20621XX/C2062133_RAW.LBL", None, "skip", None),
]


@pytest.mark.parametrize("instrument,spec,name,state,number", SPECS)
def test_entries(spark, instrument, spec, name, state, number):
    from platewise.operators.catalog import entries

    r = entries(spark.createDataFrame([(instrument, "COISS_2001", spec)], "instrument string, volume string, filespec string")).first()
    assert (r["img_name"], r["outcome"], r["img_num"]) == (name, state, number)
