"""Text forms of numbers, angles and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sexagesimal(total_ms: Column, unit: str, width: int) -> Column:
    whole = F.floor(total_ms / 3600000)
    minutes, ms = F.floor(total_ms / 60000) % 60, total_ms % 60000
    return F.concat(F.lpad(whole.cast("string"), width, "0"), F.lit(unit), F.lpad(minutes.cast("string"), 2, "0"), F.lit("m"), F.format_string("%06.3f", ms / 1000.0), F.lit("s"))


def ra_hms(ra: Column) -> Column:
    """right ascension in radians as hours, with carries; 24 h is 0 h; null for a negative one."""
    ms = F.floor(F.degrees(ra) / 15 * 3600000 + 0.5) % 86400000
    return F.when(ra >= 0, _sexagesimal(ms, "h", 2))


def dec_dms(dec: Column) -> Column:
    """declination in radians as signed degrees; from 180 degrees on the sign turns."""
    deg = F.degrees(dec)
    ms = F.floor(F.abs(deg) * 3600000 + 0.5)
    turned = ms >= 180 * 3600000
    sign = F.when((deg < 0) != turned, "-").otherwise("+")
    size = F.when(turned, 360 * 3600000 - ms).otherwise(ms)
    return F.concat(sign, _sexagesimal(size, "d", 3))


def offset_text(x: Column) -> Column:
    """six decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")


# Fixed value: the form of result files' names.
RESULT_NAME = r"^(.+)_(-?\d+\.?\d*)_(-?\d+\.?\d*)$"


def parsed_name(stub: Column) -> tuple[Column, Column, Column]:
    """template, u and v of a result file's name; nulls if it has another form."""
    ok = stub.rlike(RESULT_NAME)
    part = [F.when(ok, F.regexp_extract(stub, RESULT_NAME, i)) for i in (1, 2, 3)]
    return part[0], part[1].cast("double"), part[2].cast("double")


def five_decimals(x: Column) -> Column:
    """five decimals of the number itself, empty for null.

    A number halfway by its shortest text lies to one side of the half as it is stored, and a true half goes to the even
    digit. Its product with 200,000 is taken in two exact parts and compared with the odd number that stands for the half.
    """
    size = F.abs(x)
    below = F.floor(size * 100000)
    high = size * 134217729.0 - (size * 134217729.0 - size)  # the upper half of its bits
    over = (high * 200000.0 - (2 * below + 1)) + (size - high) * 200000.0
    n = below + F.when((over > 0) | ((over == 0) & (below % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 100000).cast("string"), F.lit("."), F.lpad((n % 100000).cast("string"), 5, "0"))
    return F.when(x.isNull(), "").when((size > 0) & (size < 1e9), text).otherwise(F.format_string("%.5f", x))


def spectral_class(x: Column) -> Column:
    """two characters without a leading g; XX for null."""
    return F.coalesce(F.substring(F.regexp_replace(F.trim(x), "^g", ""), 1, 2), F.lit("XX"))


def display_name(name: Column, number: Column) -> Column:
    """the name with single spaces, or the catalogue number."""
    clean = F.regexp_replace(F.trim(name), " +", " ")
    return F.when(clean.isNull() | (clean == ""), number.cast("string")).otherwise(clean)


def relative_flux(vmag: Column) -> Column:
    """F09."""
    return F.pow(F.lit(2.512), 4 - vmag)


def usable_magnitude(camera: Column, exposure: Column) -> Column:
    """limit for wide (W) and narrow (N) angle cameras."""
    gain = F.log(F.lit(2.512))
    return F.when(camera == "W", 10.7 + F.log(exposure / 26.0) / gain).otherwise(10.5 + F.log(exposure) / gain)


def reliability(vmag: Column, most: Column) -> Column:
    """F11."""
    return 1 - (vmag - 6) / (most - 6) / 2
