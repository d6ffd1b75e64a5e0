"""Registered queries: payload parsing, sampling/splits, streaming, ML/ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.core import round_doubles
from ..operators import ml as ML
from ..operators import sampling as L
from ..session import read_table
from ..sources import payloads as S
from ..streaming import flows as X
from . import q_clean  # noqa: F401 - its SQL is reused below
from .registry import ORACLE_SQL, register


@register("s13_api_usage_stats", """
SELECT COUNT(*) AS total_calls, COUNT(CASE WHEN event_type <> 'error' THEN 1 END) AS successful_calls,
  COUNT(*) - COUNT(CASE WHEN event_type <> 'error' THEN 1 END) AS failed_calls,
  round(COUNT(CASE WHEN event_type <> 'error' THEN 1 END) / COUNT(*), 4) AS success_rate,
  round(epoch(MAX(ts) - MIN(ts)) / 3600, 4) AS time_range_hours,
  round(CASE WHEN epoch(MAX(ts) - MIN(ts)) > 0 THEN COUNT(*) / (epoch(MAX(ts) - MIN(ts)) / 3600) ELSE 0 END, 4)
    AS calls_per_hour,
  round(COALESCE(AVG(CASE WHEN value <> 0 THEN value END), 0.0), 2) AS avg_response_time_ms
FROM events""")
def s13_api_usage_stats(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    calls = e.select(F.col("ts").cast("timestamp").alias("timestamp"), (F.col("event_type") != "error").alias("success"),
                     F.col("value").alias("response_time"))
    return round_doubles(S.api_usage_stats(calls))


@register("s10_json_payload_numbers", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def s10_json_payload_numbers(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "props")
    return S.flat_json_numbers(e, "props", ["k"], keys=["event_id"])


@register("s12_validate_payloads", """
SELECT event_id, COALESCE(json_extract(props, '$.k') IS NOT NULL, false) AS valid FROM events""")
def s12_validate_payloads(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "props")
    return S.validate_response(e, "props", ["k"], keys=["event_id"])


@register("l3_stratified_sample")
def l3_stratified_sample(spark, sf_dir):
    """Hash-based sample (own hash): rows-only."""
    return L.sample_stratified(fx.customers(spark, sf_dir), 200, "segment", ["customer_id"])


@register("l3_random_sample")
def l3_random_sample(spark, sf_dir):
    """Hash-based sample (own hash): rows-only."""
    return L.sample_random(fx.flows(spark, sf_dir), 500, ["customer_id", "date"])


@register("l4_chronological_split", fx.sql_with("flows") + """
SELECT customer_id, date, CASE WHEN pos < floor(n * 0.7) THEN 'train' WHEN pos < floor(n * 0.85) THEN 'validation'
       ELSE 'test' END AS split
FROM (SELECT customer_id, date, row_number() OVER (ORDER BY date, customer_id) - 1 AS pos, COUNT(*) OVER () AS n
      FROM flows)""")
def l4_chronological_split(spark, sf_dir):
    f = fx.flows(spark, sf_dir).select("customer_id", "date")
    return L.chronological_split(f, ["date", "customer_id"], (0.7, 0.15))


@register("l6_expanding_folds", fx.sql_with("flows") + """,
p AS (SELECT customer_id, date, deposit_flow, row_number() OVER (ORDER BY date, customer_id) - 1 AS pos,
             COUNT(*) OVER () AS n FROM flows),
x AS (SELECT *, n // 6 AS size, unnest([0, 1, 2, 3, 4]) AS fold FROM p),
s AS (SELECT *, (fold + 1) * size + (n - 6 * size) AS start FROM x)
SELECT customer_id, date, deposit_flow, fold, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role
FROM s WHERE pos < start + size""")
def l6_expanding_folds(spark, sf_dir):
    """Time-series folds by position."""
    f = fx.flows(spark, sf_dir).select("customer_id", "date", "deposit_flow")
    return L.expanding_folds(f, ["date", "customer_id"], 5)


@register("x1_streaming_segment_daily", fx.sql_with("customers") + """
SELECT CAST(e.ts AS DATE) AS date, c.segment,
  round(SUM(CASE WHEN event_type IN ('purchase', 'error') THEN -value ELSE value END), 4) AS deposit_flow,
  round(SUM(CASE WHEN event_type IN ('purchase', 'error') THEN 0.0 ELSE value END), 4) AS inflow,
  round(SUM(CASE WHEN event_type IN ('purchase', 'error') THEN -value ELSE 0.0 END), 4) AS outflow,
  COUNT(*) AS events, COUNT(DISTINCT c.customer_id) AS active_customers
FROM events e LEFT JOIN customers c ON printf('CUST_%06d', e.user_id) = c.customer_id
GROUP BY CAST(e.ts AS DATE), c.segment""")
def x1_streaming_segment_daily(spark, sf_dir):
    ev = X.arriving(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = X.customer_daily_stream(ev, fx.customers(spark, sf_dir))
    out = X.segment_daily(X.run_to_table(spark, stream, X.CUSTOMER_DAY, "x1_segment_daily"))
    return round_doubles(out)


@register("e1_weighted_ensemble", fx.sql_with("predictions") + """
SELECT row_id, MAX(actual) AS actual,
  round(SUM(CASE model_name WHEN 'a' THEN 0.4 ELSE 0.6 END * predicted) / SUM(CASE model_name WHEN 'a' THEN 0.4 ELSE 0.6 END), 4)
    AS predicted, COUNT(*) AS n_models
FROM predictions GROUP BY row_id""")
def e1_weighted_ensemble(spark, sf_dir):
    return round_doubles(ML.weighted_ensemble(fx.predictions(spark, sf_dir), {"a": 0.4, "b": 0.6}))


@register("e6_prediction_spread", fx.sql_with("predictions") + """
SELECT row_id, round(AVG(predicted), 4) AS mean_prediction, round(STDDEV_POP(predicted), 4) AS std_prediction
FROM predictions GROUP BY row_id""")
def e6_prediction_spread(spark, sf_dir):
    return round_doubles(ML.prediction_spread(fx.predictions(spark, sf_dir)))


@register("t1_random_forest_segment_flows")
def t1_random_forest_segment_flows(spark, sf_dir):
    """Spark ML random forest on segment-day features: rows-only."""
    from ..operators import windows as W
    d = fx.flows(spark, sf_dir).groupBy("segment", "date").agg(F.sum("deposit_flow").alias("y"))
    m = fx.market(spark, sf_dir).select("date", "FED_FUNDS_RATE", "VIX")
    d = W.lag_features(d.join(F.broadcast(m), "date", "left"), ["y"], [1, 2], ["date"], ["segment"])
    d = d.select("*", F.concat_ws("|", "segment", "date").alias("row_id"))
    feats = ["y_lag_1", "y_lag_2", "FED_FUNDS_RATE", "VIX"]
    model = ML.fit_regressor(d, feats, "y", "random_forest")
    return ML.predict_long(model, d, feats, "y", "random_forest")


@register("x2_streaming_dynamic_weights", fx.sql_with("predictions") + """,
p AS (SELECT model_name, actual, predicted,
             (row_number() OVER (PARTITION BY model_name ORDER BY row_id) - 1) // 20 AS w FROM predictions),
e AS (SELECT w, model_name, COUNT(*) AS n, 1 / (sqrt(AVG((actual - predicted) * (actual - predicted))) + 1e-8) AS inv
      FROM p GROUP BY w, model_name HAVING COUNT(*) >= 10)
SELECT w AS "window", model_name, n AS rows, round(inv / SUM(inv) OVER (PARTITION BY w), 9) AS weight FROM e""")
def x2_streaming_dynamic_weights(spark, sf_dir):
    """Weight updates over a file stream of orders, one per 20 rows of a model."""
    o = X.arriving(spark, sf_dir, "orders")
    variants = F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(k).alias("k")) for n, k in fx.MODEL_VARIANTS])
    p = o.select("o_orderkey", "o_totalprice", F.explode(variants).alias("m")).select(
        F.col("m.model_name").alias("model_name"), F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("actual"),
        (F.col("o_totalprice") * (1 + ((F.col("o_orderkey") * F.col("m.k")) % 21 - 10).cast("double") / 100))
        .alias("predicted"))
    return round_doubles(X.run_dynamic_weights(spark, p, order_by="row_id"), 9)


def _v6_sql(result: str) -> str:
    """The cleaned tables by the SQL of P5, P6 and P7, then P8 and P9 on them."""
    def sparse(columns: str) -> str:
        names = columns.split()
        return f"({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in names)}) / {len(names)}.0 > 0.5"

    return fx.sql_with("market_gappy", "flows") + f""",
m5 AS ({ORACLE_SQL["p5_clean_market_data"]}),
c6 AS ({ORACLE_SQL["p6_clean_customer_data"]}),
f7 AS ({ORACLE_SQL["p7_clean_flow_data"]}),
wild AS (SELECT c.customer_id FROM c6 c JOIN (SELECT customer_id, STDDEV_SAMP(deposit_flow) AS sd FROM f7 GROUP BY customer_id) s
         ON c.customer_id = s.customer_id WHERE s.sd / NULLIF(c.balance_avg, 0) > 0.5),
m AS (SELECT * FROM m5 WHERE NOT ({sparse("FED_FUNDS_RATE TREASURY_10Y TREASURY_5Y TREASURY_2Y TREASURY_3M VIX")})),
c AS (SELECT *, true AS insufficient_history FROM c6 WHERE NOT ({sparse("balance_avg rate_sensitivity loyalty_score volatility_factor")})),
f AS (SELECT * FROM f7 WHERE customer_id NOT IN (SELECT customer_id FROM wild)
      AND NOT ({sparse("deposit_flow inflow outflow balance_start balance_end")})){result}"""


def _v6_report_sql() -> str:
    def gaps(table: str, columns: list[str]) -> str:
        return f"(SELECT COUNT(*) AS n, COUNT(*) * {len(columns)} - {' - '.join(f'COUNT({c})' for c in columns)} AS gone FROM {table})"

    market = ["date", "FED_FUNDS_RATE", "TREASURY_10Y", "TREASURY_5Y", "TREASURY_2Y", "TREASURY_3M", "VIX"]
    customers = ["customer_id", "segment", "balance_avg", "rate_sensitivity", "loyalty_score", "volatility_factor", "region",
                 "industry", "account_opening_date"]
    flows = ["customer_id", "date", "deposit_flow", "inflow", "outflow", "segment", "balance_start", "balance_end"]
    parts = [f"SELECT '{name}' AS \"table\", o.n AS n0, k.n AS n1, o.gone AS g0, k.gone AS g1, {len(after)} AS width "
             f"FROM {gaps(old, before)} o, {gaps(new, after)} k"
             for name, old, before, new, after in (
                 ("market_data", "market_gappy", market, "m", market),
                 ("customer_data", "customers", customers, "c", [*customers, "insufficient_history"]),
                 ("flow_data", "flows", flows, "f", flows))]
    return _v6_sql(f""",
t AS ({" UNION ALL ".join(parts)}),
r AS (SELECT *, (n0 - n1) * 100.0 / n0 AS rp, 100.0 * (1 - g1 / (n1 * width)) AS whole FROM t)
SELECT "table", n0 AS original_rows, n1 AS cleaned_rows, n0 - n1 AS rows_removed, round(rp, 4) AS removal_percentage,
  CAST(g0 AS BIGINT) AS missing_before, CAST(g1 AS BIGINT) AS missing_after, round(whole, 4) AS completeness,
  CAST(CASE WHEN rp <= 5 THEN 95 ELSE 80 END AS DOUBLE) AS consistency, CAST(90 AS DOUBLE) AS validity,
  round(0.4 * whole + 0.3 * CASE WHEN rp <= 5 THEN 95 ELSE 80 END + 0.3 * 90, 4) AS overall_score FROM r""")


@register("v6_clean_all_integrity", _v6_sql(""",
r AS (SELECT (SELECT MIN(date) FROM m) AS ms, (SELECT MAX(date) FROM m) AS me, (SELECT COUNT(*) FROM m) AS mn,
             (SELECT MIN(date) FROM f) AS fs, (SELECT MAX(date) FROM f) AS fe, (SELECT COUNT(*) FROM f) AS fn,
             (SELECT COUNT(*) FROM c) AS cn,
             (SELECT COUNT(DISTINCT customer_id) FROM f WHERE customer_id NOT IN (SELECT customer_id FROM c)) AS lost),
k AS (SELECT *, COALESCE(fs >= ms AND fe <= me, false) AS inside FROM r),
i AS (SELECT *, list_filter([CASE WHEN NOT inside THEN 'Flow dates outside market data range' END,
                             CASE WHEN lost > 0 THEN 'Orphan flow records' END,
                             CASE WHEN mn < 30 THEN 'Insufficient market data' END,
                             CASE WHEN cn < 100 THEN 'Insufficient customer data' END,
                             CASE WHEN fn < 1000 THEN 'Insufficient flow data' END], lambda x: x IS NOT NULL) AS issues FROM k)
SELECT ms AS market_start, me AS market_end, mn AS market_rows, fs AS flow_start, fe AS flow_end, fn AS flow_rows,
  cn AS customer_rows, lost AS orphan_flow_customers, inside AS dates_in_market_range, issues, len(issues) = 0 AS overall_valid FROM i"""))
def v6_clean_all_integrity(spark, sf_dir):
    """V6 composition: the integrity row of the cleaned tables."""
    from .compositions import clean_all
    c = fx.customers(spark, sf_dir)
    out = clean_all(fx.market_gappy(spark, sf_dir), c, fx.flows(spark, sf_dir, c), fx.last_day(spark, sf_dir))
    return out["integrity"]


@register("v6_clean_all_quality_report", _v6_report_sql())
def v6_clean_all_quality_report(spark, sf_dir):
    """V6 composition: the quality report of each table."""
    from .compositions import clean_all
    c = fx.customers(spark, sf_dir)
    out = clean_all(fx.market_gappy(spark, sf_dir), c, fx.flows(spark, sf_dir, c), fx.last_day(spark, sf_dir))
    return round_doubles(out["quality_report"])


@register("m4_feature_table")
def m4_feature_table(spark, sf_dir):
    """M4 composition (market features + segment features + targets): rows-only."""
    from .compositions import feature_table
    return feature_table(fx.market(spark, sf_dir), fx.flows(spark, sf_dir))


@register("t5_train_and_compare")
def t5_train_and_compare(spark, sf_dir):
    """RF and GBT on the segment-day table, ranked by rmse: rows-only."""
    from ..operators import flows as A
    from .compositions import train_and_compare
    seg = A.segment_behavioral_features(fx.flows(spark, sf_dir))
    m = fx.market(spark, sf_dir).select("date", "FED_FUNDS_RATE", "VIX")
    t = seg.join(F.broadcast(m), "date", "left")
    feats = ["segment_sum_deposit_flow_ma_7", "segment_net_flow_rate_ma_7", "FED_FUNDS_RATE", "VIX"]
    _, cmp = train_and_compare(t, feats, "segment_sum_deposit_flow", ML.date_cutoff(t))
    return cmp
