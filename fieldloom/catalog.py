"""Seed catalogues: units, hints, concepts, conversions, limits, threats.

Every list here is configuration with a fixed, small size. User-supplied
catalogues have the same shape, come in as DataFrames of any size and are joined.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# --------------------------------------------------------------------------
# Fixed values. They decide the results, so they are stated as plain text in
# the order in which they apply.
# --------------------------------------------------------------------------

PROTOCOLS = ["MQTT", "CoAP", "Modbus", "OPC-UA", "HTTP", "WebSocket"]

# (pattern anchored at the start of the key, unit); first match wins
UNIT_PATTERNS = [
    (r"(temp|temperature).*(_c|_celsius|_centigrade)$", "celsius"),
    (r"(temp|temperature).*(_f|_fahrenheit)$", "fahrenheit"),
    (r"(temp|temperature).*(_k|_kelvin)$", "kelvin"),
    (r"^(tmp|temp|t)$", "celsius"),
    (r"(hum|humidity|rh).*(_pct|_percent|%)?$", "percent"),
    (r"(press|pressure).*(_pa|_pascal)$", "pascal"),
    (r"(press|pressure).*(_bar)$", "bar"),
    (r"(press|pressure).*(_psi)$", "psi"),
    (r"(press|pressure).*(_hpa)$", "hectopascal"),
    (r"(volt|voltage|v)$", "volt"),
    (r"(current|amp|ampere|i)$", "ampere"),
    (r"(power|watt|w)$", "watt"),
    (r"(speed|velocity).*(_mps|_ms)$", "meters_per_second"),
    (r"(speed|velocity).*(_kmh|_kph)$", "kilometers_per_hour"),
    (r"(flow).*(_lpm|_lm)$", "liters_per_minute"),
    (r"(dist|distance|length).*(_m|_meter)$", "meter"),
    (r"(dist|distance|length).*(_cm)$", "centimeter"),
    (r"(dist|distance|length).*(_mm)$", "millimeter"),
    (r"(time|duration).*(_s|_sec|_seconds)$", "seconds"),
    (r"(time|duration).*(_ms|_milliseconds)$", "milliseconds"),
    (r"(weight|mass).*(_kg|_kilogram)$", "kilogram"),
    (r"(weight|mass).*(_g|_gram)$", "gram"),
    (r".*(_pct|_percent|%)$", "percent"),
    (r"^(pct|percent|ratio)$", "percent"),
]

# (pattern found anywhere in the key, hint); first match wins
HINT_PATTERNS = [
    (r"(temp|temperature|tmp)", "temperature"),
    (r"(hum|humidity|rh)", "humidity"),
    (r"(press|pressure|baro)", "pressure"),
    (r"(light|lux|luminosity)", "illuminance"),
    (r"(co2|carbon_dioxide)", "co2_concentration"),
    (r"(pm25|pm2\.5)", "particulate_matter_2_5"),
    (r"(noise|sound|db|decibel)", "noise_level"),
    (r"(accel|acceleration)", "acceleration"),
    (r"(gyro|angular)", "angular_velocity"),
    (r"(lat|latitude)", "latitude"),
    (r"(lon|lng|longitude)", "longitude"),
    (r"(alt|altitude|elevation)", "altitude"),
    (r"(speed|velocity)", "speed"),
    (r"(volt|voltage)", "voltage"),
    (r"(current|ampere|amp)", "current"),
    (r"(power|watt)", "power"),
    (r"(energy|kwh)", "energy"),
    (r"(freq|frequency|hz)", "frequency"),
    (r"(state|status)", "state"),
    (r"(online|connected|alive)", "connectivity"),
    (r"(battery|batt)", "battery_level"),
    (r"(rssi|signal)", "signal_strength"),
    (r"(id|uuid|guid)$", "identifier"),
    (r"(name|label)$", "name"),
    (r"(timestamp|time|ts|datetime)", "timestamp"),
]

# strings that look like a date and time
ISO_PATTERNS = [
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    r"^\d{4}/\d{2}/\d{2}",
]

TIMESTAMP_WORDS = ["timestamp", "time", "ts", "datetime", "created_at", "updated_at", "date"]
IDENTIFIER_WORDS = ["id", "uuid", "guid", "key", "code", "serial", "mac", "imei"]
EVENT_TIME_NAMES = ["timestamp", "ts", "time", "datetime", "created_at"]
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# device id from a topic: first match, first group, case ignored
DEVICE_ID_PATTERNS = [
    r"devices?/([^/]+)",
    r"sensors?/([^/]+)",
    r"things?/([^/]+)",
    r"([^/]+)/telemetry",
    r"([^/]+)/data",
]

SUBSCRIPTIONS = ["sensors/#", "devices/+/telemetry"]

# (concept, description, unit, datatype, aliases)
CONCEPTS = [
    ("temperature_celsius", "Temperature in degrees Celsius", "celsius", "float",
     ["tmp", "temp", "temperature", "t", "thermo"]),
    ("humidity_percent", "Relative humidity percentage", "percent", "float",
     ["hum", "humidity", "rh", "relative_humidity"]),
    ("pressure_pascal", "Atmospheric or process pressure", "pascal", "float",
     ["press", "pressure", "baro", "atm"]),
    ("co2_ppm", "Carbon dioxide concentration", "ppm", "float",
     ["co2", "carbon_dioxide", "co2_level"]),
    ("voltage_volt", "Electrical voltage", "volt", "float",
     ["volt", "voltage", "v", "vdc", "vac"]),
    ("current_ampere", "Electrical current", "ampere", "float",
     ["current", "amp", "ampere", "i", "amps"]),
    ("power_watt", "Electrical power", "watt", "float",
     ["power", "watt", "w", "watts"]),
    ("latitude_degrees", "Geographic latitude", "degrees", "float",
     ["lat", "latitude"]),
    ("longitude_degrees", "Geographic longitude", "degrees", "float",
     ["lon", "lng", "longitude"]),
    ("speed_mps", "Speed in meters per second", "meters_per_second", "float",
     ["speed", "velocity", "spd"]),
    ("battery_percent", "Battery charge level", "percent", "float",
     ["battery", "batt", "bat_level", "charge"]),
    ("signal_rssi", "Signal strength (RSSI)", "dbm", "integer",
     ["rssi", "signal", "signal_strength"]),
    ("connectivity_status", "Online/offline status", "boolean", "boolean",
     ["online", "connected", "alive", "status"]),
]

# (from, to, add before, multiply, divide, add after): the four steps run in
# this order, which gives the same doubles as the usual written formula
CONVERSIONS = [
    ("celsius", "fahrenheit", 0.0, 9.0, 5.0, 32.0),
    ("celsius", "kelvin", 0.0, 1.0, 1.0, 273.15),
    ("fahrenheit", "celsius", -32.0, 5.0, 9.0, 0.0),
    ("fahrenheit", "kelvin", -32.0, 5.0, 9.0, 273.15),
    ("kelvin", "celsius", -273.15, 1.0, 1.0, 0.0),
    ("kelvin", "fahrenheit", -273.15, 9.0, 5.0, 32.0),
    ("pascal", "bar", 0.0, 1.0, 100000.0, 0.0),
    ("pascal", "psi", 0.0, 0.000145038, 1.0, 0.0),
    ("pascal", "hectopascal", 0.0, 1.0, 100.0, 0.0),
    ("bar", "pascal", 0.0, 100000.0, 1.0, 0.0),
    ("bar", "psi", 0.0, 14.5038, 1.0, 0.0),
    ("psi", "pascal", 0.0, 1.0, 0.000145038, 0.0),
    ("psi", "bar", 0.0, 1.0, 14.5038, 0.0),
    ("hectopascal", "pascal", 0.0, 100.0, 1.0, 0.0),
    ("meters_per_second", "kilometers_per_hour", 0.0, 3.6, 1.0, 0.0),
    ("meters_per_second", "miles_per_hour", 0.0, 2.23694, 1.0, 0.0),
    ("kilometers_per_hour", "meters_per_second", 0.0, 1.0, 3.6, 0.0),
    ("kilometers_per_hour", "miles_per_hour", 0.0, 0.621371, 1.0, 0.0),
    ("miles_per_hour", "meters_per_second", 0.0, 1.0, 2.23694, 0.0),
    ("miles_per_hour", "kilometers_per_hour", 0.0, 1.0, 0.621371, 0.0),
    ("meter", "centimeter", 0.0, 100.0, 1.0, 0.0),
    ("meter", "millimeter", 0.0, 1000.0, 1.0, 0.0),
    ("meter", "kilometer", 0.0, 1.0, 1000.0, 0.0),
    ("meter", "feet", 0.0, 3.28084, 1.0, 0.0),
    ("centimeter", "meter", 0.0, 1.0, 100.0, 0.0),
    ("centimeter", "millimeter", 0.0, 10.0, 1.0, 0.0),
    ("millimeter", "meter", 0.0, 1.0, 1000.0, 0.0),
    ("millimeter", "centimeter", 0.0, 1.0, 10.0, 0.0),
    ("kilogram", "gram", 0.0, 1000.0, 1.0, 0.0),
    ("kilogram", "pound", 0.0, 2.20462, 1.0, 0.0),
    ("gram", "kilogram", 0.0, 1.0, 1000.0, 0.0),
    ("liter", "milliliter", 0.0, 1000.0, 1.0, 0.0),
    ("liter", "gallon", 0.0, 0.264172, 1.0, 0.0),
    ("milliliter", "liter", 0.0, 1.0, 1000.0, 0.0),
    ("percent", "ratio", 0.0, 1.0, 100.0, 0.0),
    ("ratio", "percent", 0.0, 100.0, 1.0, 0.0),
    ("seconds", "milliseconds", 0.0, 1000.0, 1.0, 0.0),
    ("seconds", "minutes", 0.0, 1.0, 60.0, 0.0),
    ("milliseconds", "seconds", 0.0, 1.0, 1000.0, 0.0),
    ("minutes", "seconds", 0.0, 60.0, 1.0, 0.0),
]

# (concept, datatype, min, max)
CONSTRAINTS = [
    ("temperature_celsius", "float", -273.15, 1000.0),
    ("humidity_percent", "float", 0.0, 100.0),
    ("battery_percent", "float", 0.0, 100.0),
    ("latitude_degrees", "float", -90.0, 90.0),
    ("longitude_degrees", "float", -180.0, 180.0),
    ("pressure_pascal", "float", 0.0, 1e9),
    ("voltage_volt", "float", -1e6, 1e6),
    ("current_ampere", "float", -1e6, 1e6),
    ("power_watt", "float", 0.0, 1e9),
]

# decimals by word contained in the target name, first match wins
PRECISION = [("float", 6), ("temperature", 2), ("percentage", 1)]
DEFAULT_PRECISION = 6

DEFAULT_VALUES = {"float": 0.0, "integer": 0, "string": "", "boolean": False}

# (family, pattern); searched in lowercased text, first match wins
THREAT_PATTERNS = [
    ("SQL injection", r"(\bor\b|\band\b)\s+\d+\s*=\s*\d+"),
    ("SQL injection", r"union\s+(all\s+)?select"),
    ("SQL injection", r";\s*drop\s+"),
    ("SQL injection", r";\s*delete\s+"),
    ("SQL injection", r";\s*update\s+.*\s+set\s+"),
    ("SQL injection", r"exec(\s+|\().*xp_"),
    ("SQL injection", r"--\s*$"),
    ("Script injection", r"<script"),
    ("Script injection", r"javascript:"),
    ("Script injection", r"on\w+\s*="),
    ("Script injection", r"eval\s*\("),
    ("Script injection", r"document\.(cookie|location|write)"),
    ("Path traversal", r"\.\./"),
    ("Path traversal", r"\.\.\\"),
    ("Path traversal", r"%2e%2e[/\\]"),
    ("Path traversal", r"\.\.%2f"),
]

VALID_FIELD_TYPES = [
    "null", "boolean", "integer", "float", "string", "datetime", "array", "object", "unknown",
]

# weights of the mapping methods in the overall confidence
METHOD_WEIGHTS = {"embedding": 1.0, "llm": 0.9, "cache": 1.1}

SIMILARITY_THRESHOLD = 0.85
RULE_CONFIDENCE = 0.7
REPLY_CONFIDENCE = 0.8
UNKNOWN_TOKEN_WEIGHT = 0.3
REGISTRY_TTL_DAYS = 30
MAX_DEPTH = 10

# histogram bounds in seconds
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

# --------------------------------------------------------------------------


class Alias(NamedTuple):
    alias: str
    concept_id: str
    unit: str


def aliases() -> list[Alias]:
    """All aliases in catalogue order."""
    return [Alias(a, c[0], c[2]) for c in CONCEPTS for a in c[4]]


def vocabulary() -> list[str]:
    """Known tokens in order of first use: the aliases of a concept, then its id."""
    seen: dict[str, None] = {}
    for concept in CONCEPTS:
        for token in [*concept[4], concept[0]]:
            seen.setdefault(token)
    return list(seen)


def concepts(spark: SparkSession) -> DataFrame:
    """The concept table."""
    return spark.createDataFrame(
        [(i, *c) for i, c in enumerate(CONCEPTS)],
        "ordinal int, concept_id string, description string, unit string, datatype string, "
        "aliases array<string>",
    )


def constraints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CONSTRAINTS, "concept_id string, datatype string, min_value double, max_value double"
    )


def unit_conversions(spark: SparkSession) -> DataFrame:
    """Directed unit pairs with the four steps of each conversion."""
    return spark.createDataFrame(
        [(i, *c) for i, c in enumerate(CONVERSIONS)],
        "ordinal int, from_unit string, to_unit string, pre double, mul double, div double, "
        "post double",
    )
