"""Sun position, sun times, airmass and clear-sky irradiance as column expressions.

Formulas: the general solar position equations published by NOAA (Meeus, low
accuracy: a few hundredths of a degree and about one minute between 60N and
60S), refraction after Meeus/Saemundsson scaled by pressure and temperature,
relative airmass after Kasten and Young (1989), clear sky after Ineichen and
Perez (2002) with the Linke turbidity as an input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Twilight depression, sunrise zenith, mean pressure, earth radius.
CIVIL_DEPRESSION = 6.0
SUNRISE_ZENITH = 90.833
SEA_PRESSURE = 101325.0
EARTH_RADIUS = 6356900.0


def _staged(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Add columns stage by stage.  A later stage refers to an earlier one by name, so a term that is
    used ten times is computed once and the expression trees stay small."""
    for stage in stages:
        df = df.withColumns(stage)
    return df


def add_sun_terms(df: DataFrame, ts: Column) -> DataFrame:
    """Add ``__declination`` (degrees) and ``__equation`` of time (minutes) for an instant."""
    t, m, node, lon, tilt = (F.col(f"__{n}") for n in ("t", "anomaly", "node", "mean_longitude", "tilt"))
    days = F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000.0) + 2440587.5
    tilt_mean = F.lit(23.0) + (F.lit(26.0) + (F.lit(21.448) - t * (t * (F.lit(0.00059) - t * 0.001813) + 46.815)) / 60.0) / 60.0
    centre = (
        F.sin(m) * (F.lit(1.914602) - t * (t * 0.000014 + 0.004817))
        + F.sin(m * 2) * (F.lit(0.019993) - t * 0.000101)
        + F.sin(m * 3) * 0.000289
    )
    y, base, ecc = F.col("__y"), F.radians(lon), F.col("__eccentricity")
    equation = F.degrees(
        y * F.sin(base * 2)
        - ecc * F.sin(m) * 2.0
        + ecc * y * F.sin(m) * F.cos(base * 2) * 4.0
        - y * y * F.sin(base * 4) * 0.5
        - ecc * ecc * F.sin(m * 2) * 1.25
    ) * 4.0
    staged = _staged(
        df,
        {"__t": (days - 2451545.0) / 36525.0},
        {
            "__mean_longitude": F.pmod(t * (t * 0.0003032 + 36000.76983) + 280.46646, F.lit(360.0)),
            "__anomaly": F.radians(t * (F.lit(35999.05029) - t * 0.0001537) + 357.52911),
            "__eccentricity": F.lit(0.016708634) - t * (t * 0.0000001267 + 0.000042037),
            "__node": F.radians(F.lit(125.04) - t * 1934.136),
        },
        {
            "__longitude": F.radians(lon + centre - 0.00569 - F.sin(node) * 0.00478),
            "__tilt": F.radians(tilt_mean + F.cos(node) * 0.00256),
        },
        {"__declination": F.degrees(F.asin(F.sin(tilt) * F.sin("__longitude"))), "__y": F.tan(tilt / 2) * F.tan(tilt / 2)},
        {"__equation": equation},
    )
    return staged.drop("__t", "__mean_longitude", "__anomaly", "__eccentricity", "__node", "__longitude", "__tilt", "__y")


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _half_day(latitude: Column, declination: Column, zenith: Column) -> Column:
    """Cosine of the hour angle at which the sun stands at ``zenith``."""
    lat, dec = F.radians(latitude), F.radians(declination)
    return F.cos(F.radians(zenith)) / (F.cos(lat) * F.cos(dec)) - F.tan(lat) * F.tan(dec)


def horizon_dip(elevation: Column) -> Column:
    """Degrees the horizon sinks for an observer ``elevation`` metres up."""
    return F.degrees(F.acos(F.lit(EARTH_RADIUS) / (F.greatest(elevation, F.lit(0.0)) + EARTH_RADIUS)))


SUN_TIMES = ("dawn", "sunrise", "noon", "sunset", "dusk")


def add_sun_minutes(df: DataFrame, date: Column, latitude: str, longitude: str, elevation: str) -> DataFrame:
    """Minutes after UTC midnight of ``date`` for dawn, sunrise, noon, sunset and dusk.

    NULL where the sun does not reach the height that day.
    """
    lat, dec = F.col(latitude), F.col("__declination")
    noon, rise, civil = F.col("noon"), F.col("__rise"), F.col("__civil")

    def minutes(cosine: Column) -> Column:
        return F.when(F.abs(cosine) <= 1, F.degrees(F.acos(cosine)) * 4.0)

    midday = date.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(12))
    return _staged(
        add_sun_terms(df, midday),
        {
            "noon": F.lit(720.0) - F.col(longitude) * 4.0 - F.col("__equation"),
            "__rise": _half_day(lat, dec, F.lit(SUNRISE_ZENITH) + horizon_dip(F.col(elevation))),
            "__civil": _half_day(lat, dec, F.lit(90.0 + CIVIL_DEPRESSION)),
        },
        {"__rise": minutes(rise), "__civil": minutes(civil)},
        {"dawn": noon - civil, "sunrise": noon - rise, "sunset": noon + rise, "dusk": noon + civil},
    ).drop("__declination", "__equation", "__rise", "__civil")


def add_sun_times(df: DataFrame, ts: str, latitude: str, longitude: str, elevation: str, zone: str = "UTC") -> DataFrame:
    """Dawn, sunrise, noon, sunset and dusk for the calendar day (in ``zone``) of each row.

    Column expressions on the row itself: cheaper than a join to the distinct
    (site, day) pairs, because it needs no shuffle.
    """
    local = F.col(ts).cast("timestamp")
    if zone != "UTC":
        local = F.from_utc_timestamp(local, zone)
    timed = add_sun_minutes(df.withColumn("__day", F.to_date(local)), F.col("__day"), latitude, longitude, elevation)
    start = F.unix_seconds(F.col("__day").cast("timestamp"))
    return timed.withColumns({name: F.timestamp_seconds(start + F.round(F.col(name) * 60.0)) for name in SUN_TIMES}).drop("__day")


POSITION = ("apparent_zenith", "zenith", "apparent_elevation", "elevation", "azimuth", "equation_of_time")


def add_solar_position(
    df: DataFrame, ts: str, latitude: str, longitude: str, pressure: str, temperature: str, prefix: str = ""
) -> DataFrame:
    """Zenith, elevation, azimuth (degrees), their refracted forms and the equation of time (minutes).

    ``pressure`` in Pa, ``temperature`` in degrees Celsius.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    minutes = F.pmod(micros, F.lit(86_400_000_000)) / F.lit(60_000_000.0)
    lat, dec, hour = F.radians(F.col(latitude)), F.radians(F.col("__declination")), F.col("__hour")
    true_solar = F.pmod(minutes + F.col("__equation") + F.col(longitude) * 4.0, F.lit(1440.0))
    height = F.col(f"{prefix}elevation")
    towards = F.atan2(F.sin(hour), F.cos(hour) * F.sin(lat) - F.tan(dec) * F.cos(lat))
    air = (F.col(pressure) / 101000.0) * (F.lit(283.0) / (F.col(temperature) + 273.0))
    refraction = F.when(height > -0.83, air * F.lit(1.02) / F.tan(F.radians(height + F.lit(10.3) / (height + 5.11))) / 60.0)
    return _staged(
        add_sun_terms(df, F.col(ts)),
        {"__hour": F.radians(true_solar / 4.0 - 180.0)},
        {
            f"{prefix}elevation": F.degrees(F.asin(_clamp(F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(hour)))),
            f"{prefix}azimuth": F.pmod(F.degrees(towards) + 180.0, F.lit(360.0)),
            f"{prefix}equation_of_time": F.col("__equation"),
        },
        {f"{prefix}apparent_elevation": height + F.coalesce(refraction, F.lit(0.0)), f"{prefix}zenith": F.lit(90.0) - height},
        {f"{prefix}apparent_zenith": F.lit(90.0) - F.col(f"{prefix}apparent_elevation")},
    ).drop("__declination", "__equation", "__hour")


def pressure_at(altitude: Column) -> Column:
    """Standard atmosphere pressure in Pa."""
    return F.pow((F.lit(44331.514) - altitude) / 11880.516, F.lit(1 / 0.1902632)) * 100.0


def relative_airmass(apparent_zenith: Column) -> Column:
    """Kasten and Young; NULL below the horizon."""
    return F.when(
        apparent_zenith < 90,
        F.lit(1.0) / (F.cos(F.radians(apparent_zenith)) + F.lit(0.50572) / F.pow(F.lit(96.07995) - apparent_zenith, F.lit(1.6364))),
    )


def absolute_airmass(relative: Column, pressure: Column) -> Column:
    return relative * pressure / SEA_PRESSURE


def extraterrestrial_irradiance(ts: Column) -> Column:
    """Spencer's series around 1366.1 W/m2."""
    turn = (F.dayofyear(ts) - 1) * F.lit(2 * math.pi / 365.0)
    return F.lit(1366.1) * (
        F.lit(1.00011) + F.cos(turn) * 0.034221 + F.sin(turn) * 0.00128 + F.cos(turn * 2) * 0.000719 + F.sin(turn * 2) * 0.000077
    )


CLEAR_SKY = ("ghi", "dni", "dhi")


def add_clear_sky(
    df: DataFrame, apparent_zenith: str, airmass: str, turbidity: str, altitude: str, extra: Column, prefix: str = ""
) -> DataFrame:
    """Clear-sky ghi, dni and dhi in W/m2; 0 when the sun is down."""
    alt, haze, mass = F.col(altitude), F.col(turbidity), F.col(airmass)
    f1, f2, cosine, power = F.col("__f1"), F.col("__f2"), F.col("__cosine"), F.col("__extra")
    c1, c2 = alt * 5.09e-5 + 0.868, alt * 3.92e-5 + 0.0387
    ghi = c1 * power * cosine * F.exp(-c2 * mass * (f1 + f2 * (haze - 1)))
    beam = F.greatest((F.lit(0.163) / f1 + 0.664) * F.exp(mass * -0.09 * (haze - 1)) * power, F.lit(0.0))
    share = F.when(cosine > 0, (F.lit(1.0) - (F.lit(0.1) - F.exp(-haze) * 0.2) / (F.lit(0.882) / f1 + 0.1)) / cosine)
    flat = F.col(f"{prefix}ghi")
    down = mass.isNull()
    return _staged(
        df,
        {
            "__f1": F.exp(alt / -8000.0),
            "__f2": F.exp(alt / -1250.0),
            "__cosine": F.greatest(F.cos(F.radians(F.col(apparent_zenith))), F.lit(0.0)),
            "__extra": extra,
        },
        {f"{prefix}ghi": F.when(down, F.lit(0.0)).otherwise(ghi)},
        {f"{prefix}dni": F.when(down, F.lit(0.0)).otherwise(F.coalesce(F.least(beam, flat * F.greatest(share, F.lit(0.0))), F.lit(0.0)))},
        {f"{prefix}dhi": flat - F.col(f"{prefix}dni") * cosine},
    ).drop("__f1", "__f2", "__cosine", "__extra")


def add_sky(df: DataFrame, ts: str, latitude: str, longitude: str, altitude: str, turbidity: str, source: str) -> DataFrame:
    """The sky columns of one weather source, named ``<source>_zenith`` and so on.

    Reads ``<source>_pressure`` (Pa) and ``<source>_temperature`` (degrees Celsius).
    """
    prefix = f"{source}_"
    placed = add_solar_position(df, ts, latitude, longitude, f"{prefix}pressure", f"{prefix}temperature", prefix)
    relative = F.col(f"{prefix}airmass_relative")
    placed = _staged(
        placed,
        {f"{prefix}airmass_relative": relative_airmass(F.col(f"{prefix}apparent_zenith"))},
        {f"{prefix}airmass_absolute": absolute_airmass(relative, pressure_at(F.col(altitude)))},
    )
    extra = extraterrestrial_irradiance(F.col(ts))
    return add_clear_sky(placed, f"{prefix}apparent_zenith", f"{prefix}airmass_absolute", turbidity, altitude, extra, prefix)
