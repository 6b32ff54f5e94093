"""List cells, key=value names, key paths and formatted numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_list(cell: Column) -> Column:
    """Comma list to trimmed items."""
    return F.transform(F.split(cell, ","), lambda item: F.trim(item))


def append_when_absent(cell: Column, *, item: str, only: str, without: str) -> Column:
    """Add an implied item to a list cell.

    ``only`` is shortened to ``item``; a cell with ``without`` stays; every other cell gets ``item`` appended.
    """
    return (
        F.when(cell.contains(only), F.replace(cell, F.lit(only), F.lit(item)))
        .when(cell.contains(without), cell)
        .otherwise(F.concat(cell, F.lit(f", {item}")))
    )


def map_values(value: Column, mapping: Mapping[str, str]) -> Column:
    """Look a value up in a fixed mapping; unknown values stay."""
    if not mapping:
        return value
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), value)


def map_values_table(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The same for a mapping table ``(item, category)`` of any size."""
    joined = df.join(mapping.select(F.col("item").alias(column), F.col("category").alias("__category")), column, "left")
    return joined.withColumn(column, F.coalesce("__category", column)).select(*df.columns)


def parse_name(name: Column) -> Column:
    """``k=v_k2=v2_flag`` to a map; a bare part maps to ``True``, a repeated key keeps its last value."""
    parts = F.split(name, "_")
    keys = F.transform(parts, lambda p: F.split(p, "=", 2)[0])
    last = F.array_distinct(keys)

    def value_of(key: Column) -> Column:
        own = F.filter(parts, lambda p: F.split(p, "=", 2)[0] == key)
        part = F.element_at(own, -1)
        return F.when(part.contains("="), F.get(F.split(part, "=", 2), F.lit(1))).otherwise(F.lit("True"))

    return F.map_from_arrays(last, F.transform(last, value_of))


def under_prefix(key: Column, prefix: str, separator: str = "/") -> Column:
    """True for keys below ``prefix``."""
    return key.startswith(prefix + separator)


def key_part(key: Column, index: int, separator: str = "/") -> Column:
    """One part of a key path; negative counts from the end, NULL when there is none."""
    parts = F.filter(F.split(key, F.lit("\\Q" + separator + "\\E")), lambda p: p != "")
    return F.try_element_at(parts, F.lit(index + 1 if index >= 0 else index))


def flatten_struct(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs to flat columns whose names are key paths."""
    def leaves(schema, path: list[str]):
        for field in schema:
            here = [*path, field.name]
            if hasattr(field.dataType, "fields"):
                yield from leaves(field.dataType, here)
            else:
                yield here

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in leaves(df.schema, [])])


def unflatten_struct(df: DataFrame, separator: str = "/") -> DataFrame:
    """Flat key-path columns back to nested structs."""
    tree: dict = {}
    for name in df.columns:
        node = tree
        *above, leaf = [p for p in name.split(separator) if p]
        for part in above:
            node = node.setdefault(part, {})
        node[leaf] = name

    def build(node: dict) -> list[Column]:
        return [
            F.struct(*build(child)).alias(part) if isinstance(child, dict) else F.col(f"`{child}`").alias(part)
            for part, child in node.items()
        ]

    return df.select(*build(tree))


# Text patterns of numbers in reports.
VALUE_AND_ERROR = "{number} \\pm {number}"
COLOURED = "\\textcolor{%s}{%s}"
MEDIAN_AND_INTERVAL = "${number}\\%%\\, (\\text{{{level}\\%% CI}}: {number}\\!-\\!{number}\\%%)$"


def value_and_error(mean: Column, std: Column, precision: int = 2, colour: bool = False) -> Column:
    """``$1.23 \\pm 0.45$``; optionally dark red when the value is clearly above zero, else dark green."""
    number = f"%.{precision}f"
    body = F.format_string(VALUE_AND_ERROR.format(number=number), mean, std)
    if not colour:
        return F.concat(F.lit("$"), body, F.lit("$"))
    shade = F.when(mean - std - F.lit(0.6 / 10**precision) > 0, F.lit("darkred")).otherwise(F.lit("darkgreen"))
    return F.concat(F.lit("$"), F.format_string(COLOURED, shade, body), F.lit("$"))


def median_and_interval(median: Column, low: Column, high: Column, p: float, precision: int = 2) -> Column:
    """``$1.0\\%\\, (\\text{95\\% CI}: 0.1\\!-\\!2.0\\%)$`` from three percentages."""
    number = f"%.{precision}f"
    return F.format_string(MEDIAN_AND_INTERVAL.format(number=number, level=f"{p * 100:.0f}"), median, low, high)


#: Stored name of the cluster-based selection method.
CLUSTERWISE = "clusterwise"


def method_label(method: Column, clustering: Column, labels: Mapping[str, str]) -> Column:
    """Selection method for display; the cluster-based method carries its clustering."""
    full = F.when(method == CLUSTERWISE, F.concat_ws(" ", method, clustering)).otherwise(method)
    return map_values(full, labels)


def scenario_label(domain: Column, kind: Column) -> Column:
    """``WT-S1`` .. ``PV-S2``; NULL for anything else."""
    prefix = F.when(domain == "wind", "WT").when(domain == "pv", "PV")
    suffix = F.when(kind == "digital_twin", "S1").when(kind == "forecast_available", "S2")
    return F.when(prefix.isNotNull() & suffix.isNotNull(), F.concat_ws("-", prefix, suffix))


# Display labels of the selection methods.
METHOD_LABELS = {
    "clusterwise feature_importance": "CW\n(FI)",
    "clusterwise correlation": "CW\n(corr.)",
    "clusterwise random": "CW\n(rnd.)",
    "clusterwise singletons": "SFS",
    "mutual_info": "MI",
    "f_value": "F-value",
    "RF_FI": "RF FI",
}


def method_family(label: Column, families: Mapping[str, Sequence[str]]) -> Column:
    """Coarser method group of a label; unknown labels stay."""
    return map_values(label, {member: family for family, members in families.items() for member in members})
