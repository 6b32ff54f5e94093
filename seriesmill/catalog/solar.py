"""Photovoltaic station columns: raw name, display name and tags."""

from __future__ import annotations

from seriesmill.catalog.wind import with_encodings

# Station, time and target columns, raw name, display name, tags.
STATION_COLUMNS = (
    ("date_time", "Timestamp", ("meta",)),
    ("DayOfYear", "DayOfYear", ("forecast_available", "circular")),
    ("MinuteOfDay", "MinuteOfDay", ("forecast_available", "circular")),
    ("dawn", "Dawn", ("meta",)),
    ("sunrise", "Sunrise", ("meta",)),
    ("noon", "Noon", ("meta",)),
    ("sunset", "Sunset", ("meta",)),
    ("dusk", "Dusk", ("meta",)),
    ("is_daytime", "is_daytime", ("meta",)),
    ("Station_ID", "Station ID", ("meta",)),
    ("Capacity", "Capacity", ("meta",)),
    ("PV_Technology", "PV Technology", ("meta",)),
    ("Panel_Size", "Panel Size", ("meta",)),
    ("Module", "Module", ("meta",)),
    ("Inverters", "Inverters", ("meta",)),
    ("Layout", "Layout", ("meta",)),
    ("Panel_Number", "Panel Number", ("meta",)),
    ("Array_Tilt", "Array Tilt", ("meta",)),
    ("Pyranometer", "Pyranometer", ("meta",)),
    ("Longitude", "Longitude", ("meta", "circular")),
    ("Latitude", "Latitude", ("meta",)),
    ("Altitude", "Altitude", ("meta",)),
    ("power", "Power", ("target",)),
    ("nwp_globalirrad", "NWP Global Irradiance", ("forecast_available",)),
    ("nwp_directirrad", "NWP Direct Irradiance", ("forecast_available",)),
    ("nwp_temperature", "NWP Temperature", ("forecast_available",)),
    ("nwp_humidity", "NWP Humidity", ("forecast_available",)),
    ("nwp_windspeed", "NWP Wind Speed", ("forecast_available",)),
    ("nwp_winddirection", "NWP Wind Direction", ("forecast_available", "circular")),
    ("nwp_pressure", "NWP Pressure", ("forecast_available",)),
    ("lmd_totalirrad", "LMD Global Irradiance", ("system_state",)),
    ("lmd_diffuseirrad", "LMD Diffuse Irradiance", ("system_state",)),
    ("lmd_temperature", "LMD Temperature", ("system_state",)),
    ("lmd_pressure", "LMD Pressure", ("system_state",)),
    ("lmd_winddirection", "LMD Wind Direction", ("system_state", "circular")),
    ("lmd_windspeed", "LMD Wind Speed", ("system_state",)),
)

# Computed sky columns of each weather source, raw stem, display stem, circular or not.
SKY_COLUMNS = (
    ("apparent_zenith", "Apparent Zenith", ("circular",)),
    ("zenith", "Zenith", ("circular",)),
    ("apparent_elevation", "Apparent Elevation", ("circular",)),
    ("elevation", "Elevation", ("circular",)),
    ("azimuth", "Azimuth", ("circular",)),
    ("equation_of_time", "Equation of Time", ()),
    ("ghi", "GHI", ()),
    ("dni", "DNI", ()),
    ("dhi", "DHI", ()),
    ("airmass_relative", "Relative Airmass", ()),
    ("airmass_absolute", "Absolute Airmass", ()),
)

# Weather sources and what their columns may be used for.
SOURCES = {"nwp": "forecast_available", "lmd": "system_state"}

# Value ranges of the circular features.
ANGLE_RANGES = {"Azimuth": (0, 360), "Elevation": (0, 90), "Apparent Elevation": (0, 90), "Zenith": (0, 90), "Apparent Zenith": (0, 90)}
CYCLIC_RANGES = {
    "Longitude": (-180, 180),
    "NWP Wind Direction": (0, 360),
    "LMD Wind Direction": (0, 360),
    "MinuteOfDay": (0, 24 * 60 - 1),
    "DayOfYear": (1, 366),
    **{f"{source.upper()} {angle}": limits for source in SOURCES for angle, limits in ANGLE_RANGES.items()},
}


def rename_map() -> dict[str, str]:
    names = {raw: shown for raw, shown, _ in STATION_COLUMNS}
    for source in SOURCES:
        names.update({f"{source}_{raw}": f"{source.upper()} {shown}" for raw, shown, _ in SKY_COLUMNS})
    return names


def feature_tags() -> dict[str, frozenset]:
    plain = {shown: tags for _, shown, tags in STATION_COLUMNS}
    for source, use in SOURCES.items():
        plain.update({f"{source.upper()} {shown}": [use, *kind] for _, shown, kind in SKY_COLUMNS})
    return with_encodings(plain)
