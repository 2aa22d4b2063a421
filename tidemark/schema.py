"""Names, column sets and schemas shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# Frequency names, sentinel and modelling columns of the data model.
FREQUENCIES = ("H", "D", "W", "M")
SENTINEL = -999.0
TARGET = "pm25_value"
FEATURES = ("no2_value", "o3_value", "so2_value", "pm10_value")
CHANNELS = ("pm25_value", "no2_value", "o3_value", "so2_value", "pm10_value")
POLLUTANTS = ("pm25", "pm10", "no2", "o3", "so2")
MEASUREMENT_COLUMNS = ("Pollutant", "Value", "Unit", "Validity", "Verification")
METADATA_COLUMNS = ("Samplingpoint", "AggType", "ResultTime", "DataCapture", "FkObservationLog")
INTERVAL = ("Start", "End")

# Public names of the pollutants at the file edge, e.g. ``PM2.5-Value``.
PUBLIC_PREFIX = {"pm25": "PM2.5", "pm10": "PM10", "no2": "NO2", "o3": "O3", "so2": "SO2"}

RAW_SCHEMA = T.StructType(
    [
        T.StructField("Samplingpoint", T.StringType()),
        T.StructField("Pollutant", T.IntegerType()),
        T.StructField("Start", T.TimestampType()),
        T.StructField("End", T.TimestampType()),
        T.StructField("Value", T.DoubleType()),
        T.StructField("Unit", T.StringType()),
        T.StructField("AggType", T.StringType()),
        T.StructField("Validity", T.IntegerType()),
        T.StructField("Verification", T.IntegerType()),
        T.StructField("ResultTime", T.TimestampType()),
        T.StructField("DataCapture", T.DoubleType()),
        T.StructField("FkObservationLog", T.StringType()),
    ]
)


def frequency_schema(freq: str, flavour: str = "datetime") -> T.StructType:
    """Schema of one H/D/W/M table in public column names."""
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency {freq!r}")
    if flavour not in ("datetime", "timestamp"):
        raise ValueError(f"unknown flavour {flavour!r}")
    hourly = freq == "H"
    start = T.StructField("Start", T.TimestampType() if hourly else T.DateType())
    stamp = T.StructField("Start_Timestamp", T.LongType())
    fields = [stamp, start] if hourly else [start, stamp]
    if flavour == "timestamp":
        fields = [stamp]
    code = T.IntegerType() if hourly else T.DoubleType()
    for prefix in PUBLIC_PREFIX.values():
        fields.append(T.StructField(f"{prefix}-Pollutant", code))
        fields.append(T.StructField(f"{prefix}-Value", T.DoubleType()))
        if hourly:
            fields.append(T.StructField(f"{prefix}-Unit", T.StringType()))
        fields.append(T.StructField(f"{prefix}-Validity", code))
        fields.append(T.StructField(f"{prefix}-Verification", code))
    return T.StructType(fields)


def to_internal_name(column: str) -> str:
    """``PM2.5-Value`` -> ``pm25_value``; other names stay as they are."""
    for short, public in PUBLIC_PREFIX.items():
        if column.startswith(public + "-"):
            return f"{short}_{column[len(public) + 1:].lower()}"
    return column


def to_public_name(column: str) -> str:
    """Inverse of :func:`to_internal_name`."""
    for short, public in PUBLIC_PREFIX.items():
        if column.startswith(short + "_"):
            return f"{public}-{column[len(short) + 1:].capitalize()}"
    return column
