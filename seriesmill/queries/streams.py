"""Which operators run on a stream of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.queries.registry import load, query
from seriesmill.streaming.capabilities import OPERATORS, capabilities

#: Rows that an operator keeps, where it keeps not all.
KEPT = {
    "filter_rows": "value > 50",
    "filter_assets": "asset IN (3, 5, 8)",
    "drop_missing_rows": "value IS NOT NULL",
    "drop_infinite_rows": "value IS NOT NULL",
    "keep_daytime": "ts BETWEEN date_trunc('day', ts) + INTERVAL 6 HOUR AND date_trunc('day', ts) + INTERVAL 18 HOUR",
    "select_daterange": "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'",
    "quality_rules": "value > 50 AND value <= other * 1.5 * f + 100 AND other <= other * 0.95 * f + 50 AND value < 1361 * 1.5 * f + 100 AND other < 1361 * 0.95 * f + 50",
}
#: Operators that need the whole table or an order of its rows.
WHOLE_TABLE = ["drop_sparse_columns", "drop_flat_columns", "keep_failing_assets", "normalise", "add_quantile_labels", "fill_gaps", "next_event", "row_index"]


def _flags_sql() -> str:
    parts = [
        f"SELECT '{name}' AS operator, {'false AS streamable, 0::BIGINT AS n' if name in WHOLE_TABLE else f'true AS streamable, count(*) FILTER ({KEPT.get(name, "true")}) AS n'} FROM r"
        + (" LIMIT 1" if name in WHOLE_TABLE else "")
        for name in OPERATORS
    ]
    return """
    WITH r AS (SELECT user_id AS asset, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value, value / 2 AS other, pow(cos(radians(33)), 1.2) AS f FROM events)
    """ + " UNION ALL ".join(f"({p})" for p in parts)


@query(_flags_sql())
def stream_capabilities(spark, folder):
    """Every operator run on a stream of the events: whether Spark takes it, and the rows that came out."""
    events = load(spark, folder, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    readings = events.select(
        F.col("user_id").alias("asset"),
        F.col("ts").cast("timestamp").alias("ts"),
        value.alias("value"),
        (F.col("value") / 2).alias("other"),
        (F.col("event_id") % 20 + 1).cast("double").alias("speed"),
    )
    return capabilities(readings)
