"""Wind and power formulas.  Division is guarded: ANSI mode would raise where the data says inf or NaN."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")

# Specific gas constant of dry air, replacement for zero wind speed.
DRY_AIR = 287.05
CALM = 0.1


def float_divide(top: Column, bottom: Column) -> Column:
    """IEEE division: x/0 is +-inf, 0/0 is NaN."""
    zero = (
        F.when(top > 0, F.lit(INF)).when(top < 0, F.lit(-INF)).when(top.isNotNull(), F.lit(NAN))
    )
    return F.when(bottom == 0, zero).otherwise(F.try_divide(top.cast("double"), bottom.cast("double")))


def turbulence_intensity(mean: Column, std: Column) -> Column:
    return float_divide(std, mean)


def turbulence_from_variance(mean: Column, variance: Column) -> Column:
    return float_divide(F.sqrt(variance), mean)


def wind_shear(low_speed: Column, high_speed: Column, low_height: float, high_height: float) -> Column:
    """Power-law exponent from two heights: the slope of ln(speed) over ln(height).

    Zero speed is replaced by 0.1 m/s first; negative speed gives NULL.
    """
    def log_speed(speed: Column) -> Column:
        return F.ln(F.when(speed == 0, F.lit(CALM)).otherwise(speed))

    return (log_speed(high_speed) - log_speed(low_speed)) / F.lit(math.log(high_height) - math.log(low_height))


def add_wind_shear(df: DataFrame, speeds: Sequence[str], heights: Sequence[float], name: str = "Wind Shear") -> DataFrame:
    first, second = speeds
    return df.withColumn(name, wind_shear(F.col(f"`{first}`"), F.col(f"`{second}`"), heights[0], heights[1]))


def air_density(pressure: Column, temperature: Column) -> Column:
    return float_divide(pressure, temperature * DRY_AIR)


def wind_power(temperature: Column, speed: Column, pressure: Column, area: Column) -> Column:
    return air_density(pressure, temperature) * 0.5 * area * speed * speed * speed


def turbine_power(temperature: Column, speed: Column, pressure: Column, area: Column, coefficient: Column) -> Column:
    return coefficient * wind_power(temperature, speed, pressure, area)


def power_coefficient(actual: Column, temperature: Column, speed: Column, pressure: Column, area: Column) -> Column:
    return float_divide(actual, wind_power(temperature, speed, pressure, area))


def hyperbolic_power_curve(speed: Column, params: Sequence[float], x_scale: float = 1.0, y_scale: float = 1.0) -> Column:
    """Modified hyperbolic tangent power curve with nine given parameters."""
    a1, a2, a3, a4, a5, a6, a7, a8, a9 = (float(p) for p in params)
    x = speed / F.lit(float(x_scale))
    top = F.exp(x * a2) * a1 - F.exp(x * -a4) * a3
    bottom = F.exp(x * a6) * a5 + F.exp(x * -a8) * a7
    return (float_divide(top, bottom) + a9) * F.lit(float(y_scale))


def product(first: Column, second: Column) -> Column:
    """Product of two metadata columns, such as a panel area."""
    return first * second
