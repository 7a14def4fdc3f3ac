"""Columns on the modes of ring edges and on units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400.0
#: Modes above this number describe inclinations and have no radius.
LAST_RADIAL_MODE = 90


def radial_modes(modes: Column) -> Column:
    """the radial modes of an edge with angles in radians and rates in radians a second.

    Modes are structs (mode, a, ae, long_peri, rate_peri, amplitude, phase, pattern_speed) in degrees and degrees a day.
    """
    per_second = lambda x: F.radians(x) / DAY
    kept = F.filter(modes, lambda m: m["mode"] <= LAST_RADIAL_MODE)
    return F.transform(
        kept,
        lambda m: F.struct(
            m["mode"].alias("mode"), m["a"].alias("a"), m["ae"].alias("ae"), F.radians(m["long_peri"]).alias("long_peri"), per_second(m["rate_peri"]).alias("rate_peri"),
            m["amplitude"].alias("amplitude"), F.radians(m["phase"]).alias("phase"), per_second(m["pattern_speed"]).alias("pattern_speed"),
        ),
    )


def modes_legal(modes: Column) -> Column:
    """only mode 1 has a semi-major axis."""
    return ~F.exists(modes, lambda m: m["a"].isNotNull() & (m["mode"] != 1) & (m["mode"] <= LAST_RADIAL_MODE))


def base_radius(modes: Column) -> Column:
    """semi-major axis of the first mode 1; null without one."""
    return F.get(F.filter(modes, lambda m: m["mode"] == 1), F.lit(0))["a"]


def edge_radius(angle: Column, a: Column, ae: Column, long_peri: Column, rate_peri: Column, days: Column) -> Column:
    """F16: radius at an angle (radians) of an ellipse whose pericentre (degrees) precesses (degrees a day)."""
    ratio = F.when(a > 0, ae / F.nullif(a, F.lit(0.0))).otherwise(0.0)
    e = F.when(ratio >= 1, 0.99).otherwise(ratio)
    return a * (1 - e * e) / (1 + e * F.cos(angle - F.radians(long_peri + rate_peri * days)))


def in_degrees(value: Column, units: Column, name: Column) -> Column:
    """radians as degrees, by unit, or by a name of an angle where the unit is null."""
    angular = F.lower(name).rlike("longitude|latitude|angle")
    return F.when((units == "rad") | (units.isNull() & angular), F.degrees(value)).otherwise(value)


def body_id(name: Column, known: Column, simulated: Column | None = None) -> Column:
    """the known number of a body. A simulated body without one gets a number from 10000 to 29999 by a hash of its
    name (two may share it); any other is an error when it is met."""
    made_up = F.pmod(F.xxhash64(name), F.lit(20000)) + 10000
    unknown = F.raise_error(F.concat(F.lit("unknown body "), F.coalesce(name, F.lit("null")))).cast("long")
    return F.coalesce(known.cast("long"), F.when(F.lit(False) if simulated is None else simulated, made_up).otherwise(unknown))
