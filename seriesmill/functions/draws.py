"""Reproducible random numbers from hashes: the same row and seed give the same draw on any executor."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def poisson_steps(mean: float = 1.0) -> tuple[float, ...]:
    """Cumulative Poisson probabilities for a mean of at most about 1, as far as a double tells them from 1."""
    steps, total, term = [], 0.0, math.exp(-mean)
    while total + term < 1.0 and term > 2.0**-53:
        total += term
        steps.append(total)
        term *= mean / len(steps)
    return tuple(steps)


POISSON_STEPS = poisson_steps()


def hash_share(*parts: Column | str | int, method: str = "md5") -> Column:
    """A number in [0, 1) from the given parts.

    ``md5`` can be recomputed by any SQL engine; ``xxhash64`` is the faster one.
    """
    columns = [F.lit(p) if isinstance(p, (str, int)) else p for p in parts]
    if method == "md5":
        text = F.concat_ws("|", *[c.cast("string") for c in columns])
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0
    if method == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / 9007199254740992.0
    raise ValueError(f"unknown hash {method!r}")


def poisson_weight(share: Column, steps: tuple[float, ...] = POISSON_STEPS) -> Column:
    """Poisson multiplicity for a uniform share; the mean is that of ``steps``."""
    weight = F.lit(len(steps))
    for i, top in reversed(list(enumerate(steps))):
        weight = F.when(share < top, F.lit(i)).otherwise(weight)
    return weight
