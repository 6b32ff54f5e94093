"""Feature catalogs: a feature name with its set of tags."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tags = Mapping[str, frozenset]

TREE_MODELS = ("lgbm", "xgboost", "rf")
MULTIVARIATE_MODELS = ("mlp", "lgbm", "xgboost", "rf")


def select_by_tags(tags: Tags, include_all: Iterable = (), include_any: Iterable = (), exclude: Iterable = ()) -> list[str]:
    """Names in catalog order: no excluded tag, every tag of ``include_all``, one of ``include_any``."""
    every, some, none = frozenset(include_all or ()), frozenset(include_any or ()), frozenset(exclude or ())
    return [
        name
        for name, own in tags.items()
        if not (none & own) and every <= own and (not some or some & own)
    ]


def tag_filter(tags: Column, include_all: Iterable = (), include_any: Iterable = (), exclude: Iterable = ()) -> Column:
    """The same rule as a predicate over an ``ARRAY<STRING>`` column."""
    every, some, none = sorted(set(include_all or ())), sorted(set(include_any or ())), sorted(set(exclude or ()))
    keep = F.lit(True)
    if none:
        keep = keep & ~F.arrays_overlap(tags, F.array(*[F.lit(t) for t in none]))
    if every:
        keep = keep & (F.size(F.array_except(F.array(*[F.lit(t) for t in every]), tags)) == 0)
    if some:
        keep = keep & F.arrays_overlap(tags, F.array(*[F.lit(t) for t in some]))
    return keep


def target_of(tags: Tags) -> str:
    """The one feature tagged ``target``."""
    found = select_by_tags(tags, include_any={"target"})
    if len(found) != 1:
        raise ValueError(f"expected exactly one target feature, got {len(found)}")
    return found[0]


def needs_cyclical_encoding(model: str) -> bool:
    return model in MULTIVARIATE_MODELS and model not in TREE_MODELS


def scenario_features(tags: Tags, scenario: str, model: str) -> list[str]:
    """Input features of a scenario (``forecast_available`` or ``digital_twin``) for a model family."""
    return select_by_tags(tags, **scenario_rule(scenario, model))


def scenario_rule(scenario: str, model: str) -> dict[str, set]:
    """Tags to include and exclude; models that need it get the sine/cosine columns, all others the raw angle."""
    include, exclude = {"forecast_available"}, {"meta", "target", "power_proxy"}
    if scenario == "forecast_available":
        exclude.add("system_state")
    else:
        include.add("system_state")
    wanted, unwanted = ("cyclical_encoding", "circular") if needs_cyclical_encoding(model) else ("circular", "cyclical_encoding")
    return {"include_any": include | {wanted}, "exclude": exclude | {unwanted}}


def catalog_frame(spark: SparkSession, tags: Tags, ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """The catalog as a table ``feature, tags, min, max``."""
    ranges = ranges or {}
    rows = [
        (name, sorted(own), *(float(x) for x in ranges[name])) if name in ranges else (name, sorted(own), None, None)
        for name, own in tags.items()
    ]
    return spark.createDataFrame(rows, "feature string, tags array<string>, min double, max double")
