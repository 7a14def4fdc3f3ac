"""Variables of product labels from the rows of an archive index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewise.functions.names import product_id

# Index columns whose label variable is their lower-case name in the mission's namespace and whose
# default is empty.
PLAIN = (
    "MISSION_PHASE_NAME", "SPACECRAFT_CLOCK_COUNT_PARTITION", "SPACECRAFT_CLOCK_START_COUNT", "SPACECRAFT_CLOCK_STOP_COUNT", "ANTIBLOOMING_STATE_FLAG", "BIAS_STRIP_MEAN",
    "CALIBRATION_LAMP_STATE_FLAG", "COMMAND_FILE_NAME", "COMMAND_SEQUENCE_NUMBER", "DARK_STRIP_MEAN", "DATA_CONVERSION_TYPE", "DELAYED_READOUT_FLAG", "DETECTOR_TEMPERATURE",
    "ELECTRONICS_BIAS", "EARTH_RECEIVED_START_TIME", "EARTH_RECEIVED_STOP_TIME", "EXPOSURE_DURATION", "FILTER_TEMPERATURE", "FLIGHT_SOFTWARE_VERSION_ID", "GAIN_MODE_ID",
    "GROUND_SOFTWARE_VERSION_ID", "IMAGE_NUMBER", "IMAGE_TIME", "IMAGE_OBSERVATION_TYPE", "INSTRUMENT_DATA_RATE", "INSTRUMENT_MODE_ID", "INST_CMPRS_TYPE", "INST_CMPRS_RATIO",
    "LIGHT_FLOOD_STATE_FLAG", "OBSERVATION_ID", "PARALLEL_CLOCK_VOLTAGE_INDEX", "PREPARE_CYCLE_INDEX", "READOUT_CYCLE_INDEX", "SEQUENCE_ID", "SEQUENCE_TITLE", "SHUTTER_MODE_ID",
    "SHUTTER_STATE_ID", "START_TIME_DOY", "STOP_TIME_DOY", "TELEMETRY_FORMAT_ID",
)
# The same with another default.
DEFAULTS = {
    "LIMITATIONS": "N/A", "EXPECTED_MAXIMUM_DN_SAT": "-1", "EXPECTED_PACKETS": "-1", "INST_CMPRS_RATE_EXPECTED_BITS": "-1.", "INST_CMPRS_RATE_ACTUAL_BITS": "-1.", "MISSING_LINES": "0",
    "MISSING_PACKET_FLAG": "NO", "OPTICS_TEMPERATURE_BACK": "-999.", "ORDER_NUMBER": "-999", "RECEIVED_PACKETS": "-1", "SEQUENCE_NUMBER": "-1", "VALID_MAXIMUM_FULL_WELL": "-1", "VALID_MAXIMUM_DN_SAT": "-1",
}
# Variables of another name than their index column, with the default.
RENAMED = {
    "expected_maximum_full_well": ("EXPECTED_MAXIMUM", "-1"), "filter_name_1": ("FILTER1", ""), "filter_name_2": ("FILTER2", ""), "image_mid_time": ("IMAGE_TIME", ""), "method_description": ("METHOD_DESC", ""),
    "optics_temperature_front": ("OPTICS_TEMPERATURE", ""), "pds3_product_creation_time": ("PRODUCT_CREATION_TIME", ""), "pds3_product_version_type": ("PRODUCT_VERSION_TYPE", "FINAL"),
    "pds3_target_desc": ("TARGET_DESC", ""), "pds3_target_list": ("TARGET_LIST", "N/A"), "pds3_target_name": ("TARGET_NAME", ""), "pre-pds_version_number": ("PRE_PDS_VERSION_NUMBER", "2"),
    "sensor_head_electronics_temperature": ("SENSOR_HEAD_ELEC_TEMPERATURE", ""),
}
# Variables that don't depend on the row.
CONSTANT = {"inst_cmprs_param_malgo": "999", "inst_cmprs_param_tb": "999", "inst_cmprs_param_blocks": "999", "inst_cmprs_param_quant": "999"}
NAMESPACE = "cassini:"


def row_variables(row: Column) -> dict[str, Column]:
    """P10: variables of the mission's namespace from an index row (a map of texts); a missing column has its default."""
    wanted = {c.lower(): (c, "") for c in PLAIN} | {c.lower(): (c, d) for c, d in DEFAULTS.items()} | RENAMED
    found = {n: F.coalesce(F.try_element_at(row, F.lit(c)), F.lit(d)) for n, (c, d) in wanted.items()}
    return {NAMESPACE + n: x for n, x in (found | {n: F.lit(v) for n, v in CONSTANT.items()}).items()}


def name_variables(file_name: Column, bundle: str) -> dict[str, Column]:
    """P10: camera, identifiers and texts from the file name of an image."""
    letter = F.upper(F.substring(file_name, 1, 1))
    camera = lambda n, w, other: F.when(letter == "N", n).when(letter == "W", w).otherwise(other)
    base = F.regexp_extract(file_name, "^([^_.]*)", 1)
    ids = lambda kind, version=None: product_id(base, bundle, kind, version)
    return {
        "CAMERA_WIDTH": camera("Narrow", "Wide", "Unknown"), "CAMERA_WN_UC": camera("N", "W", ""), "CAMERA_WN_LC": camera("n", "w", ""),
        "BUNDLE_LID": F.lit(f"urn:nasa:pds:{bundle}"), "BUNDLE_LIDVID": F.lit(f"urn:nasa:pds:{bundle}::1.0"),
        "BROWSE_LID": ids("browse"), "BROWSE_LIDVID": ids("browse", "1.0"), "DATA_LID": ids("data"), "DATA_LIDVID": ids("data", "1.0"), "SOURCE_IMAGE_LIDVID": ids("data", "1.0"),
        "TITLE": F.concat(F.lit("Backplanes for "), file_name), "DESCRIPTION": F.concat(F.lit("Backplanes for navigated image "), file_name), "COMMENT": F.lit("Generated from navigated image data"),
    }


def time_variables(start: Column, middle: Column, stop: Column) -> dict[str, Column]:
    """P10: times of the observation, empty where the result document has none."""
    return {n: F.coalesce(c, F.lit("")) for n, c in (("START_DATE_TIME", start), ("IMAGE_MID_TIME", middle), ("STOP_DATE_TIME", stop))}
