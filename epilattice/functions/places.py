"""County code rules: recoding, merging, splitting and leaving out reporting units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import in_set

# Public county codes (FIPS) with special treatment.

# Renamed counties: old code -> code in use.
RENAMED = {2270: 2158, 46113: 46102}

# Counties reported as one unit: county -> reporting unit.
MERGED = {2282: 2998, 2105: 2998, 2060: 2997, 2164: 2997}

# State of units that a county list does not name.
UNIT_STATE = {2158: "AK", 2998: "AK", 2997: "AK", 46102: "SD"}

# Territories that are left out.
TERRITORIES = [
    60010, 69100, 69110, 69120, 72001, 72007, 72009, 72011, 72013,
    72015, 72017, 72019, 72021, 72023, 72025, 72029, 72031, 72033,
    72035, 72037, 72041, 72043, 72045, 72047, 72051, 72053, 72054,
    72057, 72059, 72061, 72063, 72065, 72067, 72069, 72073, 72075,
    72077, 72079, 72085, 72087, 72089, 72091, 72095, 72097, 72101,
    72103, 72105, 72111, 72113, 72119, 72121, 72123, 72125, 72127,
    72129, 72133, 72135, 72137, 72139, 72141, 72143, 72145, 72149,
    72151, 72153, 78010, 78020, 78030,
]

# Independent cities without mobility data of their own.
CITY_CODES = [51580, 51595, 51600, 51678, 51685, 51690]

# Codes from here on are territories; two more units never enter the coupling.
FIRST_TERRITORY = 66000
UNCOUPLED = [60050, 60010]

# The five counties of New York City, the one that stands for all, and the city-wide report.
NEW_YORK_CITY = [36085, 36005, 36047, 36081, 36061]
NEW_YORK_CITY_KEY = 36085
CITY_REPORT_NAME = "New York City"
CITY_REPORT_CODE = 36061
CITY_REPORT_POPULATION = 8_419_000


def recode(code: Column, mapping: dict) -> Column:
    """Replace codes by a small fixed mapping, inside the projection (no join)."""
    if not mapping:
        return code
    out = code
    for old, new in mapping.items():
        out = F.when(code == old, F.lit(new)).otherwise(out)
    return out


def renamed(code: Column) -> Column:
    return recode(code, RENAMED)


def merged(code: Column) -> Column:
    """Current codes with jointly reported counties folded into their unit."""
    return recode(code, {**RENAMED, **MERGED})


def collapse(code: Column, members, key: int) -> Column:
    """One code for a set of members."""
    return F.when(in_set(code, members), F.lit(key)).otherwise(code)


def split_units(df, column: str = "fips", units: dict | None = None):
    """Give a jointly reported unit's rows to each of its counties."""
    mapping = MERGED if units is None else units
    members: dict = {}
    for county, unit in mapping.items():
        members.setdefault(unit, []).append(county)
    targets = F.array(F.col(column))
    for unit, counties in members.items():
        targets = F.when(F.col(column) == unit, F.array(*[F.lit(c) for c in counties])).otherwise(targets)
    kept = [F.explode(targets).alias(c) if c == column else F.col(c) for c in df.columns]
    return df.select(*kept)


def without(df, codes, column: str = "fips"):
    """Drop listed codes; a missing code is not listed and stays."""
    return df.filter(~in_set(F.col(column), codes)) if codes else df


def unit_state(code: Column, state: Column, defaults: dict | None = None) -> Column:
    """State of a place, with fixed answers for units the county list does not name."""
    out = state
    for unit, name in (UNIT_STATE if defaults is None else defaults).items():
        out = F.when(code == unit, F.lit(name)).otherwise(out)
    return out


def city_report_code(name: Column, code: Column, city: str = CITY_REPORT_NAME, city_code: int = CITY_REPORT_CODE) -> Column:
    """Code for rows that report a whole city under its name instead of a code."""
    return F.when(name == city, F.lit(city_code)).otherwise(code)
