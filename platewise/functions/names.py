"""Columns derived from file specifications, image names and volumes of the four supported archives.

Nothing here raises on bad data: a derivation that can fail gives two columns, the value and its outcome (ok, skip or
error), and the selection sends what is not ok to its rejected frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories of one archive whose second or third level holds the image.
TWO_LEVELS = ("RAW_CAL", "VENUS", "EARTH", "MOON", "GASPRA", "IDA", "SL9", "EMCONJ", "GOPEX")
THREE_LEVELS = ("C3", "C9", "C10", "C20", "C21", "C22", "C30", "E4", "E6", "E11", "E12", "E14", "E15", "E17", "E18", "E19", "E26", "G1", "G2", "G7", "G8", "G28", "G29", "I24", "I25", "I27", "I31", "I32", "I33", "J0")


@dataclass(frozen=True)
class InstrumentProfile:
    """What tells one archive from another; a new one is a new row."""

    name: str
    label_suffix: str  # pattern that file specifications of the index end with
    label_rewrite: tuple[str, str]
    image_rewrite: tuple[str, str]
    valid_name: str  # pattern of upper-cased names
    number_at: tuple[int, int]  # place and length of the digits
    volume_set: tuple[str, int, str]  # text, place of a volume's digit (0: none), text


PROFILES = {
    p.name: p
    for p in (
        InstrumentProfile("coiss", r"\.IMG$", (".IMG", "_CALIB.LBL"), (".LBL", ".IMG"), r"^[NW]\d{10}(_\d{1,2})?$", (2, 10), ("COISS_", 7, "xxx")),
        InstrumentProfile("gossi", r"\.LBL$", ("", ""), (".LBL", ".IMG"), r"^C\d{10}[RS]$", (2, 10), ("GO_0xxx", 0, "")),
        InstrumentProfile("nhlorri", r"_(sci|eng)\.lbl$", ("", ""), (".lbl", ".fit"), r"^LOR_\d{10}$", (5, 10), ("NHxxLO_xxxx", 0, "")),
        InstrumentProfile("vgiss", r"\.LBL$", ("", ""), (".LBL", ".IMG"), r"^C\d{7}$", (2, 7), ("VGISS_", 7, "xxx")),
    )
}


#: By archive: the form of a good specification (the image name is its group) and what a file of interest ends with.
SHAPES = {
    "coiss": (r"^(?i:data)/[^/]{10}_[^/]{10}/([^./]*)[^/]*$", r""),
    "gossi": (rf"^(?:(?i:REDO)/)?(?:(?i:{'|'.join(TWO_LEVELS)})|(?i:{'|'.join(THREE_LEVELS)})/[^/]*)/([^/]*?)(?:\.[^./]*)?(?:/.*)?$", r"\.LBL$"),
    "nhlorri": (r"^(?i:data)/[^/]{8}_[^/]{6}/([^/]{0,14})[^/]*_(?:sci|eng)\.lbl$", r""),
    "vgiss": (r"^(?i:data)/C[^/]{7}/([^/]*?)(?:_GEOMED[^/]*)?$", r"_GEOMED\.LBL$"),
}


@dataclass(frozen=True)
class Archive:
    """A plug-in for one archive. Its profile, the form of its file specifications, whose group is the image name, and what
    files of interest end with suffice; where they can't say what is needed, builders of columns take their place."""

    profile: InstrumentProfile
    form: str = ""
    of_interest: str = ""
    label: Callable[[Column], Column] | None = None  # of an index specification
    image: Callable[[Column], Column] | None = None  # of a label specification
    name: Callable[[Column], Column] | None = None  # of an index specification; null is a malformed one
    valid: Callable[[Column], Column] | None = None  # of a name
    number: Callable[[Column], Column] | None = None  # of a name
    volume: Callable[[Column], Column] | None = None  # path of a volume
    cameras: dict[str, str] = field(default_factory=lambda: {"nac": "N", "wac": "W"})  # first letters of names by camera
    pair: Callable[[DataFrame], DataFrame] | None = None  # adds grp and place to the rows of this archive
    variables: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)  # label variables of its own


#: The archives that every operator knows; ``plugged`` gives a wider choice, which is passed to the operators.
ARCHIVES: dict[str, Archive] = {name: Archive(p, *SHAPES[name]) for name, p in PROFILES.items()}


def plugged(*more: Archive, known: dict[str, Archive] = ARCHIVES) -> dict[str, Archive]:
    """The known archives and more, as a choice of its own; nothing else changes. A name that is taken is an error."""
    out = dict(known)
    for a in more:
        if a.profile.name in out:
            raise ValueError(f"archive {a.profile.name!r} is known already")
        out[a.profile.name] = a
    return out


def by_instrument(instrument: Column, f: Callable[[Archive], Column], archives: dict[str, Archive] = ARCHIVES) -> Column:
    out = F.lit(None)
    for name, a in archives.items():
        out = F.when(instrument == name, f(a)).otherwise(out)
    return out


def label_spec(instrument: Column, spec: Column, archives: dict[str, Archive] = ARCHIVES) -> tuple[Column, Column]:
    """Label specification of an index row, and whether its suffix is right."""

    def one(a: Archive) -> Column:
        old, new = a.profile.label_rewrite
        return a.label(spec) if a.label else F.replace(spec, F.lit(old), F.lit(new)) if old else spec

    return by_instrument(instrument, one, archives), by_instrument(instrument, lambda a: spec.rlike(a.profile.label_suffix), archives)


def image_spec(instrument: Column, label: Column, archives: dict[str, Archive] = ARCHIVES) -> Column:
    """P02."""
    return by_instrument(instrument, lambda a: a.image(label) if a.image else F.replace(label, *(F.lit(x) for x in a.profile.image_rewrite)), archives)


def image_name(instrument: Column, spec: Column, archives: dict[str, Archive] = ARCHIVES) -> tuple[Column, Column]:
    """The image name, and ok, skip (a file of no interest) or error (a malformed specification)."""
    levels = F.size(F.split(spec, "/"))
    shaped = by_instrument(instrument, lambda a: a.name(spec).isNotNull() if a.name else spec.rlike(a.form), archives) & ((instrument != "gossi") | levels.between(2, 4))
    wanted = by_instrument(instrument, lambda a: spec.rlike(a.of_interest), archives)
    name = by_instrument(instrument, lambda a: a.name(spec) if a.name else F.regexp_extract(spec, a.form, 1), archives)
    return name, F.when(~shaped, "error").when(~wanted, "skip").otherwise("ok")


def name_valid(instrument: Column, name: Column, archives: dict[str, Archive] = ARCHIVES) -> Column:
    """P04."""
    upper = F.replace(F.upper(name), F.lit("_CALIB"), F.lit(""))
    return F.coalesce(by_instrument(instrument, lambda a: a.valid(name) if a.valid else upper.rlike(a.profile.valid_name), archives), F.lit(False))


def image_number(instrument: Column, name: Column, archives: dict[str, Archive] = ARCHIVES) -> Column:
    """The digits of a valid name; null otherwise."""
    return F.when(name_valid(instrument, name, archives), image_digits(instrument, name, archives))


def image_digits(instrument: Column, name: Column, archives: dict[str, Archive] = ARCHIVES) -> Column:
    """P05 for names that are known to be valid."""
    return by_instrument(instrument, lambda a: a.number(name).cast("string") if a.number else F.substring(name, *a.profile.number_at), archives).cast("long")


def volume_path(instrument: Column, volume: Column, archives: dict[str, Archive] = ARCHIVES) -> Column:
    """Volume set and volume."""

    def one(a: Archive) -> Column:
        before, at, after = a.profile.volume_set
        return a.volume(volume) if a.volume else F.concat(F.lit(before), F.substring(volume, at, 1) if at else F.lit(""), F.lit(after), F.lit("/"), volume)

    return by_instrument(instrument, one, archives)


def index_path(instrument: Column, volume: Column, archives: dict[str, Archive] = ARCHIVES) -> Column:
    return F.concat(volume_path(instrument, volume, archives), F.lit("/"), volume, F.lit("_index.lbl"))


def results_path_stub(volume: Column, spec: Column) -> Column:
    """Volume and specification without its extension."""
    return F.regexp_replace(F.concat_ws("/", volume, spec), r"\.[^./]*$", "")


def lid_part(name: Column) -> Column:
    """The name up to its first _ or ., with its first character moved to the end in lower case."""
    base = F.regexp_extract(name, r"^([^_.]*)", 1)
    return F.concat(F.substring(base, F.lit(2), F.length(base)), F.lower(F.substring(base, 1, 1)))


def product_id(name: Column, bundle: str, kind: str, version: str | None = None) -> Column:
    """Kind is data or browse; with a version it is a versioned id."""
    return F.concat(F.lit(f"urn:nasa:pds:{bundle}:{kind}:"), lid_part(name), F.lit(f"::{version}" if version else ""))


def bundle_directory(name: Column) -> Column:
    """Directories by millions and ten thousands of the image number; empty for names under 11 characters."""
    number = F.substring(name, 2, 10).cast("long")
    millions = F.lpad(F.floor(number / 1000000).cast("string"), 4, "0")
    tens = F.lpad(F.floor(number / 10000).cast("string"), 6, "0")
    return F.when(F.length(name) < 11, "").otherwise(F.concat(millions, F.lit("xxxxxx/"), tens, F.lit("xxxx/")))


def bundle_stub(name: Column) -> Column:
    base = F.regexp_extract(name, r"^([^_.]*)", 1)
    return F.concat(bundle_directory(base), lid_part(name))


def strip_zeros(x: Column) -> Column:
    """F01."""
    return F.regexp_replace(x, "^0+(?=.)", "")
