"""Metrics, bootstrap, tests and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions.draws import POISSON_STEPS
from seriesmill.operators import evaluation as E
from seriesmill.operators.leakage import data_leakage
from seriesmill.queries.registry import load, query, rounded
from seriesmill.queries.shaping import DAY, SPLIT_SQL
from seriesmill.operators.split import split_by_time

REPLICATES = 20
SEED = 7

SCORED_SQL = """
scored AS (
  SELECT o_orderkey AS row_id, o_totalprice / 1000 AS y, c.candidate,
         CASE c.candidate WHEN 'baseline' THEN avg(o_totalprice) OVER () / 1000
                          WHEN 'status' THEN avg(o_totalprice) OVER (PARTITION BY o_orderstatus) / 1000
                          ELSE o_totalprice / 1000 * 0.9 + (o_orderkey % 7) END AS y_hat
  FROM orders, (VALUES ('baseline'), ('status'), ('close')) c(candidate))
"""

DRAWS_SQL = f"""
u AS (SELECT o_orderkey AS row_id, b.b AS replicate,
             ('0x' || substr(md5(o_orderkey || '|' || b.b || '|' || {SEED}), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM orders, (SELECT unnest(range(0, {REPLICATES})) AS b) b),
w AS (SELECT row_id, replicate, CASE {" ".join(f"WHEN u < {top!r}::DOUBLE THEN {k}" for k, top in enumerate(POISSON_STEPS))} ELSE {len(POISSON_STEPS)} END AS w FROM u),
boot AS (SELECT candidate, cast(replicate AS INTEGER) AS replicate, -sqrt(sum(w * (y - y_hat) * (y - y_hat)) / sum(w)) AS neg_rmse,
                sum(w * abs(y - y_hat)) / sum(w) AS mae, sum(w * (y - y_hat)) / sum(w) AS me
         FROM scored JOIN w USING (row_id) GROUP BY 1, 2)
"""


def scored_orders(spark, folder):
    """Three predictions of the order price: the mean, the status mean and a close one."""
    orders = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1000).alias("y"), "o_orderstatus", F.col("o_totalprice").alias("price")
    )
    by_status = orders.groupBy("o_orderstatus").agg((F.avg("price") / 1000).alias("status_mean"))
    both = orders.join(by_status, "o_orderstatus").withColumn("mean", orders.agg(F.avg("price") / 1000).scalar())
    close = F.col("y") * 0.9 + F.col("row_id") % 7
    cells = [("baseline", F.col("mean")), ("status", F.col("status_mean")), ("close", close)]
    return both.select(
        "row_id", "y", F.inline(F.array(*[F.struct(F.lit(n).alias("candidate"), v.cast("double").alias("y_hat")) for n, v in cells]))
    )


@query(
    """
    WITH s AS (SELECT l_returnflag, l_extendedprice / 1000 AS y, l_quantity * 2.0 AS p FROM lineitem),
    e AS (SELECT *, y - p AS e, avg(y) OVER (PARTITION BY l_returnflag) AS my FROM s)
    SELECT l_returnflag, round(-sqrt(avg(e * e)), 5) + 0.0 AS neg_rmse, round(-avg(e * e), 5) + 0.0 AS neg_mse, round(avg(e * e), 5) + 0.0 AS mse,
           round(greatest(0, 1 - sum(e * e) / (sum((y - my) * (y - my)) + 2.220446049250313e-16)), 6) + 0.0 AS r2, round(avg(abs(e)), 5) + 0.0 AS mae,
           round(sqrt(avg(e * e)), 5) + 0.0 AS rmse, round(median(abs(e)), 5) + 0.0 AS mdae, round(avg(e), 5) + 0.0 AS me, round(median(e), 5) + 0.0 AS mde,
           round(abs(avg(e)), 5) + 0.0 AS ame, round(abs(median(e)), 5) + 0.0 AS amde
    FROM e GROUP BY 1
    """
)
def regression_metrics(spark, folder):
    """All metrics of a prediction per group; medians are exact."""
    items = load(spark, folder, "lineitem").select(
        "l_returnflag", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 2.0).alias("p")
    )
    found = E.regression_metrics(items, "y", "p", "l_returnflag")
    return found.select("l_returnflag", *[rounded(m, 6 if m == "r2" else 5).alias(m) for m in E.METRICS])


@query(
    f"""
    WITH {SCORED_SQL}, {DRAWS_SQL}
    SELECT candidate, replicate, round(neg_rmse, 6) AS neg_rmse, round(mae, 6) AS mae, round(me, 6) + 0.0 AS me FROM boot
    """
)
def paired_bootstrap(spark, folder):
    """Metrics per candidate and replicate on shared draws."""
    found = E.paired_bootstrap(
        scored_orders(spark, folder), "row_id", "y", "y_hat", REPLICATES, SEED, "candidate", ["neg_rmse", "mae", "me"], method="md5"
    )
    return found.select("candidate", "replicate", *[rounded(m).alias(m) for m in ("neg_rmse", "mae", "me")])


@query(
    f"""
    WITH {SCORED_SQL}, {DRAWS_SQL},
    e AS (SELECT candidate, replicate, abs(y - y_hat) AS a, w FROM scored JOIN w USING (row_id) WHERE w > 0),
    x AS (SELECT candidate, replicate, a FROM e, range({len(POISSON_STEPS)}) r(i) WHERE r.i < e.w)
    SELECT candidate, cast(replicate AS INTEGER) AS replicate, round(median(a), 6) AS mdae FROM x GROUP BY 1, 2
    """
)
def bootstrap_median_error(spark, folder):
    """Weighted medians per replicate, exact, without holding a replicate in one task."""
    found = E.paired_bootstrap(scored_orders(spark, folder), "row_id", "y", "y_hat", REPLICATES, SEED, "candidate", ["mdae"], method="md5")
    return found.select("candidate", "replicate", rounded("mdae").alias("mdae"))


@query(
    f"""
    WITH {SCORED_SQL}, {DRAWS_SQL}
    SELECT candidate, round(median(neg_rmse), 5) AS median, round(quantile_cont(neg_rmse, 0.025), 5) AS ci_low, round(quantile_cont(neg_rmse, 0.975), 5) AS ci_high
    FROM boot GROUP BY 1
    """
)
def percentile_interval(spark, folder):
    """Median and 95% interval over replicates."""
    boot = E.paired_bootstrap(scored_orders(spark, folder), "row_id", "y", "y_hat", REPLICATES, SEED, "candidate", method="md5")
    found = E.percentile_interval(boot, "neg_rmse", "candidate")
    return found.select("candidate", *[rounded(c, 5).alias(c) for c in ("median", "ci_low", "ci_high")])


@query(
    """
    WITH s AS (SELECT c_mktsegment, avg(c_acctbal) AS m, stddev_samp(c_acctbal) / sqrt(count(*)) * 1.96 AS h FROM customer GROUP BY 1)
    SELECT c_mktsegment, round(m, 5) AS mean, round(m - h, 5) AS low, round(m + h, 5) AS high FROM s
    """
)
def mean_interval(spark, folder):
    """Mean and its interval."""
    found = E.mean_interval(load(spark, folder, "customer"), "c_acctbal", 1.96, "c_mktsegment")
    return found.select("c_mktsegment", *[rounded(c, 5).alias(c) for c in ("mean", "low", "high")])


#: Fixed value: the 0.975 quantile of Student's t with four degrees of freedom (a region has five nations).
T_FOUR = 2.7764451051977987


@query(
    f"""
    WITH b AS (SELECT n_nationkey, n_regionkey, coalesce(avg(c_acctbal), 0) AS m FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
    s AS (SELECT n_regionkey, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) * {T_FOUR} AS h FROM b GROUP BY 1)
    SELECT n_regionkey, round(mean, 5) AS mean, round(mean - h, 5) AS low, round(mean + h, 5) AS high FROM s
    """
)
def mean_interval_by_t(spark, folder):
    """Mean balance of a region's nations with its t interval; the quantile follows from the number of nations."""
    nations, customers = load(spark, folder, "nation"), load(spark, folder, "customer")
    balance = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("m"))
    means = nations.join(balance, "n_nationkey", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    found = E.mean_interval(means, "m", group="n_regionkey")
    return found.select("n_regionkey", *[rounded(c, 5).alias(c) for c in ("mean", "low", "high")])


@query(
    f"""
    WITH {SCORED_SQL}, {DRAWS_SQL},
    d AS (SELECT a.candidate, a.neg_rmse - b.neg_rmse AS d FROM boot a JOIN boot b USING (replicate) WHERE b.candidate = 'baseline' AND a.candidate <> 'baseline')
    SELECT candidate, round(quantile_cont(d, 0.05), 5) AS lower_bound, quantile_cont(d, 0.05) >= 0 AS non_inferior FROM d GROUP BY 1
    """
)
def non_inferiority_test(spark, folder):
    """Paired one-sided test of each candidate against the baseline."""
    boot = E.paired_bootstrap(scored_orders(spark, folder), "row_id", "y", "y_hat", REPLICATES, SEED, "candidate", method="md5")
    found = E.non_inferiority(boot, "candidate", "baseline", "neg_rmse")
    return found.withColumn("lower_bound", rounded("lower_bound", 5))


def _share_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 8))::BIGINT / 4294967296.0"


@query(
    f"""
    WITH {SCORED_SQL}, n AS (SELECT n, greatest(0, 1 - {E.FILL_MARGIN} / sqrt(n)) AS mean FROM (SELECT count(DISTINCT o_orderkey) AS n FROM orders)),
    steps AS (SELECT k, sum(p) OVER (ORDER BY k) AS top FROM (SELECT k, exp(-mean) * pow(mean, k) / factorial(k::INTEGER) AS p FROM n, range(0, 18) r(k))),
    low AS (SELECT list(top ORDER BY k) AS tops FROM steps),
    u AS (SELECT o_orderkey AS row_id, b.b AS replicate, {_share_sql("o_orderkey", "b.b", str(SEED))} AS u FROM orders, (SELECT unnest(range(0, {REPLICATES})) AS b) b),
    w AS (SELECT row_id, replicate, len(list_filter(tops, lambda x: x <= u)) AS w FROM u, low),
    p AS (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY floor({_share_sql("o_orderkey", "'order'")} * (1 + n // {E.CHUNK_ROWS})), o_orderkey) - 1 AS place FROM orders, n),
    lacking AS (SELECT replicate, n - sum(w) AS k FROM w, n GROUP BY replicate, n),
    more AS (SELECT replicate, floor({_share_sql("j", "replicate", str(SEED), "'more'")} * n) AS place FROM (SELECT replicate, unnest(range(1, k::BIGINT + 1)) AS j FROM lacking), n),
    c AS (SELECT row_id, replicate, sum(w) AS w FROM (SELECT row_id, replicate, w FROM w UNION ALL SELECT row_id, replicate, 1 FROM more JOIN p USING (place)) GROUP BY 1, 2)
    SELECT candidate, cast(replicate AS INTEGER) AS replicate, round(-sqrt(sum(w * (y - y_hat) * (y - y_hat)) / sum(w)), 6) AS neg_rmse
    FROM scored JOIN c USING (row_id) GROUP BY 1, 2
    """
)
def multinomial_bootstrap(spark, folder):
    """The same with exactly n draws per replicate."""
    found = E.paired_bootstrap(
        scored_orders(spark, folder), "row_id", "y", "y_hat", REPLICATES, SEED, "candidate", ["neg_rmse"], method="md5", mode="multinomial"
    )
    return found.select("candidate", "replicate", rounded("neg_rmse").alias("neg_rmse"))


@query(
    """
    WITH s AS (SELECT l_returnflag, CASE WHEN l_linenumber = 2 THEN 0 ELSE l_quantity END AS y,
                      CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 0 ELSE l_quantity * (1 + l_tax) END AS p FROM lineitem)
    SELECT l_returnflag, round(avg(CASE WHEN y <> 0 AND p <> 0 THEN abs(y - p) / y END) * 100, 6) AS mape, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
           round(avg(abs(y - p)), 6) AS mae FROM s WHERE p IS NOT NULL GROUP BY 1
    """
)
def skipping_metrics(spark, folder):
    """Metrics that skip missing predictions and zeros."""
    items = load(spark, folder, "lineitem").select(
        "l_returnflag",
        F.when(F.col("l_linenumber") == 2, 0.0).otherwise(F.col("l_quantity")).alias("y"),
        F.when(F.col("l_linenumber") == 4, 0.0).when(F.col("l_linenumber") != 3, F.col("l_quantity") * (1 + F.col("l_tax"))).alias("p"),
    )
    found = E.skipping_metrics(items, "y", "p", "l_returnflag")
    return found.select("l_returnflag", *[rounded(c).alias(c) for c in ("mape", "rmse", "mae")])


LEAKAGE_SQL = """
d1 AS (SELECT floor((epoch_us(b.ts) - epoch_us(a.ts)) / 86400000000.0) AS d FROM te a JOIN tr b USING (g)),
d2 AS (SELECT floor((epoch_us(b.ts) - epoch_us(a.ts)) / 86400000000.0) AS d FROM te a JOIN te b USING (g))
SELECT round((SELECT sum(CASE WHEN d >= 0 THEN exp(-d) ELSE {alpha} * exp(d) END) FROM d1)
           / (SELECT sum(CASE WHEN d >= 0 THEN exp(-d) ELSE {alpha} * exp(d) END) FROM d2), 9) AS leakage
"""


@query(
    "WITH te AS (SELECT user_id AS g, ts FROM events WHERE event_id % 3 = 0), tr AS (SELECT user_id AS g, ts FROM events WHERE event_id % 3 <> 0), "
    + LEAKAGE_SQL.format(alpha=0.5)
)
def leakage_of_random_split(spark, folder):
    """Leakage when rows of one user fall on both sides; no pair is formed."""
    events = load(spark, folder, "events").select("event_id", "user_id", "ts")
    test, train = events.filter(F.col("event_id") % 3 == 0), events.filter(F.col("event_id") % 3 != 0)
    return data_leakage(test, train, "ts", "user_id", alpha=0.5).withColumn("leakage", rounded("leakage", 9))


@query(
    f"WITH {SPLIT_SQL}, te AS (SELECT 1 AS g, ts FROM split WHERE split = 'test'), tr AS (SELECT 1 AS g, ts FROM split WHERE split = 'train'), "
    + LEAKAGE_SQL.format(alpha=1.0)
)
def leakage_of_time_split(spark, folder):
    """Leakage of a split in time, all rows in one group."""
    split = split_by_time(load(spark, folder, "events"), "ts", (0.75, 0.25), DAY)
    test, train = split.filter(F.col("split") == "test"), split.filter(F.col("split") == "train")
    return data_leakage(test, train, "ts", alpha=1.0).withColumn("leakage", rounded("leakage", 9))
