"""Choosing, renaming and retyping columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.session import as_list, require_columns

STATISTICS = ("avg", "min", "max", "std", "var")


def keep_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The given columns in the frame's own order; unknown names are ignored."""
    wanted = set(columns)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in wanted])


def drop_columns(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """Drop columns; an unknown name is an error."""
    require_columns(df, columns)
    return df.drop(*as_list(columns))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename; names that are not in the frame are ignored, a clash is an error."""
    result = df.withColumnsRenamed(dict(names))
    clashes = sorted({c for c in result.columns if result.columns.count(c) > 1})
    if clashes:
        raise ValueError(f"several columns would be called {clashes}")
    return result


def keep_averages(df: DataFrame, extra: Mapping[str, Iterable[str]] | None = None, compat: bool = False) -> DataFrame:
    """Keep plain columns and ``<signal>_Avg`` (suffix removed); other statistics only when listed.

    ``extra`` maps a statistic (``"std"``) to the signals that keep it.  Where a
    plain column already has the shortened name, the average keeps its suffix.
    ``compat=True`` keeps every ``_Min/_Max/_Std/_Var`` column, as the published
    pipeline does before its tag filter removes them.
    """
    extra = {stat: set(signals) for stat, signals in (extra or {}).items()}
    chosen: list[Column] = []
    for name in df.columns:
        stem, _, suffix = name.rpartition("_")
        stat = suffix.lower()
        if not stem or stat not in STATISTICS:
            chosen.append(F.col(f"`{name}`"))
        elif stat == "avg":
            chosen.append(F.col(f"`{name}`").alias(name if stem in df.columns else stem))
        elif compat or stem in extra.get(stat, ()):
            chosen.append(F.col(f"`{name}`"))
    return df.select(*chosen)


def health_columns(df: DataFrame, raw_only: bool = False) -> list[str]:
    """Names that start with ``smart`` (and end with ``raw``)."""
    return [c for c in df.columns if c.startswith("smart") and (not raw_only or c.endswith("raw"))]


def keep_health_columns(df: DataFrame, also_keep: Sequence[str] | str = (), raw_only: bool = False) -> DataFrame:
    return keep_columns(df, [*health_columns(df, raw_only), *as_list(also_keep)])


def set_column_types(df: DataFrame) -> DataFrame:
    """Types of an asset-day table; columns that are absent are skipped, bad values become NULL."""
    types = {"date": "timestamp", "failure": "boolean", "serial_number": "string", "model": "string", "datacenter": "string"}
    types.update(dict.fromkeys(health_columns(df), "double"))
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def downcast_floats(df: DataFrame) -> DataFrame:
    """DOUBLE columns to FLOAT."""
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating point column."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, present values and sample variance; one aggregation over the table.

    NaN counts as missing.  Variance is NULL for non-numeric columns and below two values.
    """
    numeric = set(numeric_columns(df))
    cells = []
    for name in df.columns:
        present = ~is_missing(df, name)
        spread = F.var_samp(F.when(present, F.col(f"`{name}`").cast("double"))) if name in numeric else F.lit(None).cast("double")
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count(F.when(present, 1)).alias("n_present"),
                spread.alias("variance"),
            )
        )
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def sparse_columns(df: DataFrame, share: float, profile: Mapping | None = None) -> list[str]:
    """Columns with fewer than ``int(share * rows)`` present values.  Runs one job without ``profile``."""
    profile = profile or read_profile(df)
    return [c for c in df.columns if profile[c]["n_present"] < int(share * profile[c]["n_rows"])]


def flat_columns(df: DataFrame, threshold: float, columns: Iterable[str] | None = None, profile: Mapping | None = None) -> list[str]:
    """Columns whose sample variance is at most ``threshold``; undefined variance never counts."""
    profile = profile or read_profile(df)
    among = set(df.columns if columns is None else columns)
    return [c for c in df.columns if c in among and profile[c]["variance"] is not None and profile[c]["variance"] <= threshold]


def read_profile(df: DataFrame) -> dict[str, dict]:
    """The column profile on the driver: one job, one small row per column."""
    return {row["column"]: row.asDict() for row in column_profile(df).collect()}


def drop_sparse_columns(df: DataFrame, share: float) -> DataFrame:
    """Keep columns with at least ``int(share * rows)`` present values.  Runs one job."""
    return df.drop(*sparse_columns(df, share))


def drop_flat_columns(df: DataFrame, threshold: float = 0.0, columns: Iterable[str] | None = None) -> DataFrame:
    """Drop columns with sample variance <= ``threshold`` (0: constant columns).  Runs one job."""
    return df.drop(*flat_columns(df, threshold, columns))


def drop_constant_averages(df: DataFrame) -> DataFrame:
    """Drop columns named with ``Avg`` whose variance is exactly zero.  Runs one job."""
    return drop_flat_columns(df, 0.0, [c for c in numeric_columns(df) if "Avg" in c])


def to_matrix(df: DataFrame, columns: Sequence[str] | None = None, name: str = "values", keep: Sequence[str] = ()) -> DataFrame:
    """One ``ARRAY<DOUBLE>`` column that holds the row, next to the columns ``keep``."""
    columns = [c for c in df.columns if c not in keep] if columns is None else list(columns)
    return df.select(*keep, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias(name))
