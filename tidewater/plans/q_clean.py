"""Registered queries: cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.core import round_doubles
from ..operators import clean as C
from .registry import register

LAST = fx.LAST_DAY_SQL
MK = ["FED_FUNDS_RATE", "TREASURY_10Y", "TREASURY_5Y", "TREASURY_2Y", "TREASURY_3M", "VIX"]


def rd(expr: str, name: str) -> str:
    return f"round({expr}, 4) AS {name}"


# ---------------------------------------------------------------------- P1
@register("p1_clean_numeric", fx.sql_with("flows") + """,
s AS (SELECT AVG(deposit_flow) AS m1, STDDEV_SAMP(deposit_flow) AS s1, AVG(inflow) AS m2,
             STDDEV_SAMP(inflow) AS s2, AVG(outflow) AS m3, STDDEV_SAMP(outflow) AS s3 FROM flows)
SELECT customer_id, date,
  round(CASE WHEN s1 > 0 AND abs((deposit_flow - m1) / s1) > 5 THEN NULL ELSE deposit_flow END, 4) AS deposit_flow,
  round(CASE WHEN s2 > 0 AND abs((inflow - m2) / s2) > 5 THEN NULL ELSE inflow END, 4) AS inflow,
  round(CASE WHEN s3 > 0 AND abs((outflow - m3) / s3) > 5 THEN NULL ELSE outflow END, 4) AS outflow
FROM flows, s""")
def p1_clean_numeric(spark, sf_dir):
    f = fx.flows(spark, sf_dir).select("customer_id", "date", "deposit_flow", "inflow", "outflow")
    return round_doubles(C.clean_numeric_data(f, ["deposit_flow", "inflow", "outflow"]))


# ---------------------------------------------------------------------- P2
@register("p2_outlier_flags", fx.sql_with("flows") + """,
q AS (SELECT quantile_cont(deposit_flow, 0.25) AS q1, quantile_cont(deposit_flow, 0.75) AS q3,
             quantile_cont(deposit_flow, 0.5) AS med FROM flows),
mad AS (SELECT quantile_cont(abs(deposit_flow - med), 0.5) AS mad FROM flows, q),
z AS (SELECT segment, AVG(deposit_flow) AS m, STDDEV_SAMP(deposit_flow) AS s FROM flows GROUP BY segment)
SELECT f.customer_id, f.date, round(f.deposit_flow, 4) AS deposit_flow,
  COALESCE(f.deposit_flow < q1 - 1.5 * (q3 - q1) OR f.deposit_flow > q3 + 1.5 * (q3 - q1), false) AS is_outlier_iqr,
  COALESCE(abs((f.deposit_flow - z.m) / z.s) > 3, false) AS is_outlier_z,
  COALESCE(abs(0.6745 * (f.deposit_flow - med) / mad) > 3.5, false) AS is_outlier_mz
FROM flows f LEFT JOIN z ON f.segment = z.segment, q, mad""")
def p2_outlier_flags(spark, sf_dir):
    f = fx.flows(spark, sf_dir).select("customer_id", "date", "segment", "deposit_flow")
    d = C.outlier_flag(f, "deposit_flow", "iqr", name="is_outlier_iqr")
    d = C.outlier_flag(d, "deposit_flow", "zscore", by=["segment"], name="is_outlier_z")
    d = C.outlier_flag(d, "deposit_flow", "modified_zscore", name="is_outlier_mz")
    return round_doubles(d.drop("segment"))


# ---------------------------------------------------------------------- P3
def _interp_sql(src: str, col: str, order: str = "date") -> str:
    """SQL of linear interpolation by position with ffill + bfill of edges."""
    return f"""(SELECT {order}, CASE WHEN x IS NOT NULL THEN x
                   WHEN xp IS NOT NULL AND xn IS NOT NULL THEN xp + (xn - xp) * (rn - xpp) / (xnp - xpp)
                   ELSE COALESCE(xp, xn) END AS {col}
       FROM (SELECT {order}, x, rn,
               last_value(x IGNORE NULLS) OVER past AS xp,
               last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER past AS xpp,
               first_value(x IGNORE NULLS) OVER fut AS xn,
               first_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER fut AS xnp
             FROM (SELECT {order}, {col} AS x, CAST(row_number() OVER (ORDER BY {order}) AS DOUBLE) AS rn
                   FROM {src})
             WINDOW past AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    fut AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""


@register("p3_handle_missing_values", fx.sql_with("market_gappy") + f""",
i AS {_interp_sql("market_gappy", "TREASURY_3M")},
g AS (SELECT AVG(FED_FUNDS_RATE) AS m, quantile_cont(TREASURY_10Y, 0.5) AS md FROM market_gappy)
SELECT mg.date,
  round(COALESCE(mg.FED_FUNDS_RATE, g.m), 4) AS FED_FUNDS_RATE,
  round(COALESCE(mg.TREASURY_10Y, g.md), 4) AS TREASURY_10Y,
  round(COALESCE(mg.TREASURY_5Y, 0), 4) AS TREASURY_5Y,
  round(first_value(mg.TREASURY_2Y IGNORE NULLS) OVER (ORDER BY mg.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS TREASURY_2Y,
  round(i.TREASURY_3M, 4) AS TREASURY_3M,
  round(last_value(mg.VIX IGNORE NULLS) OVER (ORDER BY mg.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS VIX
FROM market_gappy mg JOIN i ON mg.date = i.date, g""")
def p3_handle_missing_values(spark, sf_dir):
    g = fx.market_gappy(spark, sf_dir)
    strategy = {"FED_FUNDS_RATE": "mean", "TREASURY_10Y": "median", "TREASURY_5Y": "zero",
                "TREASURY_2Y": "backward_fill", "TREASURY_3M": "interpolate", "VIX": "forward_fill"}
    return round_doubles(C.handle_missing_values(g, strategy, order_by=["date"]))


# ---------------------------------------------------------------------- P5
def _p5_sql() -> str:
    # step 1: per-series fill; step 2-4: range checks; step 7: interpolate + ffill + bfill
    ff = "last_value(mg.{c} IGNORE NULLS) OVER (ORDER BY mg.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    s1 = [f"{ff.format(c='FED_FUNDS_RATE')} AS FED_FUNDS_RATE", "i10.TREASURY_10Y", "mg.TREASURY_5Y",
          "i2.TREASURY_2Y", "i3.TREASURY_3M", f"{ff.format(c='VIX')} AS VIX"]
    rng = [f"CASE WHEN {c} < -2.0 OR {c} > 20.0 THEN NULL ELSE {c} END AS {c}" for c in MK[:5]]
    rng.append("CASE WHEN VIX < 8 OR VIX > 100 THEN NULL ELSE VIX END AS VIX")
    final = ",\n".join(f"i_{c}.{c}" for c in MK)
    interps = ",\n".join(f"i_{c} AS {_interp_sql('r', c)}" for c in MK)
    joins = " ".join(f"JOIN i_{c} ON r.date = i_{c}.date" for c in MK)
    return fx.sql_with("market_gappy") + f""",
i10 AS {_interp_sql("market_gappy", "TREASURY_10Y")},
i2 AS {_interp_sql("market_gappy", "TREASURY_2Y")},
i3 AS {_interp_sql("market_gappy", "TREASURY_3M")},
s1 AS (SELECT mg.date, {", ".join(s1)} FROM market_gappy mg JOIN i10 ON mg.date = i10.date
       JOIN i2 ON mg.date = i2.date JOIN i3 ON mg.date = i3.date),
r AS (SELECT date, {", ".join(rng)} FROM s1),
{interps},
o AS (SELECT r.date, {final} FROM r {joins})
SELECT date, {", ".join(rd(c, c) for c in MK)} FROM o"""


@register("p5_clean_market_data", _p5_sql())
def p5_clean_market_data(spark, sf_dir):
    return round_doubles(C.clean_market_data(fx.market_gappy(spark, sf_dir)))


# ---------------------------------------------------------------------- P6
@register("p6_clean_customer_data", fx.sql_with("flows") + f"""
SELECT customer_id, segment, round(balance_avg, 4) AS balance_avg,
  round(CASE WHEN rate_sensitivity < 0 THEN 0.0 WHEN rate_sensitivity > 1 THEN 1.0 ELSE rate_sensitivity END, 4) AS rate_sensitivity,
  round(CASE WHEN loyalty_score < 0 THEN 0.0 WHEN loyalty_score > 1 THEN 1.0 ELSE loyalty_score END, 4) AS loyalty_score,
  round(CASE WHEN volatility_factor < 0 THEN 0.0 WHEN volatility_factor > 1 THEN 1.0 ELSE volatility_factor END, 4) AS volatility_factor,
  region, industry, account_opening_date
FROM customers
WHERE NOT COALESCE(balance_avg < 0 OR balance_avg > 1e8, false)
  AND COALESCE(segment IN ('RETAIL_SMALL', 'RETAIL_MEDIUM', 'RETAIL_LARGE', 'SME', 'CORPORATE'), false)
  AND NOT COALESCE(account_opening_date < DATE '1990-01-01' OR account_opening_date > {LAST}, false)""")
def p6_clean_customer_data(spark, sf_dir):
    return round_doubles(C.clean_customer_data(fx.customers(spark, sf_dir), fx.last_day(spark, sf_dir)))


# ---------------------------------------------------------------------- P7
def _clip(c: str) -> str:
    return (f"CASE WHEN {c} < q_{c}1 - 3 * (q_{c}3 - q_{c}1) THEN q_{c}1 - 3 * (q_{c}3 - q_{c}1) "
            f"WHEN {c} > q_{c}3 + 3 * (q_{c}3 - q_{c}1) THEN q_{c}3 + 3 * (q_{c}3 - q_{c}1) ELSE {c} END")


@register("p7_clean_flow_data", fx.sql_with("flows") + f""",
f AS (SELECT * FROM flows WHERE NOT COALESCE(date > {LAST}, false)),
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS q_{c}1, quantile_cont({c}, 0.75) AS q_{c}3"
                        for c in ("deposit_flow", "inflow", "outflow"))} FROM f),
c AS (SELECT customer_id, date, segment, balance_start, balance_end,
             {_clip("deposit_flow")} AS deposit_flow, {_clip("inflow")} AS inflow, {_clip("outflow")} AS outflow
      FROM f, q),
b AS (SELECT *, CASE WHEN abs(balance_end - (balance_start + deposit_flow)) > 0.01
                     THEN balance_start + deposit_flow ELSE balance_end END AS be FROM c)
SELECT customer_id, date, round(COALESCE(deposit_flow, 0), 4) AS deposit_flow,
  round(COALESCE(inflow, 0), 4) AS inflow, round(COALESCE(outflow, 0), 4) AS outflow, segment,
  round(CASE WHEN balance_start < 0 THEN 0.0 ELSE balance_start END, 4) AS balance_start,
  round(CASE WHEN be < 0 THEN 0.0 ELSE be END, 4) AS balance_end
FROM b""")
def p7_clean_flow_data(spark, sf_dir):
    return round_doubles(C.clean_flow_data(fx.flows(spark, sf_dir), fx.last_day(spark, sf_dir)))


# ---------------------------------------------------------------------- P8
_P8_CUST = fx.sql_with("flows") + f""",
c1 AS (SELECT customer_id, balance_avg, account_opening_date > {LAST} - INTERVAL 30 DAY AS insufficient_history,
              CASE WHEN segment = 'CORPORATE' AND balance_avg < 1000000 THEN 'SME' ELSE segment END AS seg
       FROM customers),
c2 AS (SELECT *, COALESCE((seg = 'RETAIL_SMALL' AND (balance_avg < 0 OR balance_avg > 10000))
          OR (seg = 'RETAIL_MEDIUM' AND (balance_avg < 10000 OR balance_avg > 100000))
          OR (seg = 'RETAIL_LARGE' AND (balance_avg < 100000 OR balance_avg > 1000000))
          OR (seg = 'SME' AND (balance_avg < 50000 OR balance_avg > 5000000))
          OR (seg = 'CORPORATE' AND balance_avg < 1000000), false) AS mismatch FROM c1)
SELECT customer_id, round(balance_avg, 4) AS balance_avg, COALESCE(insufficient_history, false) AS insufficient_history,
  CASE WHEN mismatch THEN COALESCE(CASE WHEN balance_avg >= 0 AND balance_avg < 10000 THEN 'RETAIL_SMALL'
                                        WHEN balance_avg >= 10000 AND balance_avg < 100000 THEN 'RETAIL_MEDIUM'
                                        WHEN balance_avg >= 100000 AND balance_avg < 1000000 THEN 'RETAIL_LARGE'
                                        WHEN balance_avg >= 50000 AND balance_avg < 5000000 THEN 'SME'
                                        WHEN balance_avg >= 1000000 THEN 'CORPORATE' END, seg)
       ELSE seg END AS segment
FROM c2"""


@register("p8_business_rules_customers", _P8_CUST)
def p8_business_rules_customers(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    cc, _ = C.apply_business_rules(c, fx.flows(spark, sf_dir, c), fx.last_day(spark, sf_dir))
    return round_doubles(cc.select("customer_id", "balance_avg", "insufficient_history", "segment"))


@register("p8_business_rules_flows", fx.sql_with("flows") + """,
s AS (SELECT customer_id, STDDEV_SAMP(deposit_flow) AS sd FROM flows GROUP BY customer_id),
x AS (SELECT s.customer_id FROM s JOIN customers c ON s.customer_id = c.customer_id
      WHERE s.sd / NULLIF(c.balance_avg, 0) > 0.5)
SELECT customer_id, date, round(deposit_flow, 4) AS deposit_flow FROM flows
WHERE customer_id NOT IN (SELECT customer_id FROM x)""")
def p8_business_rules_flows(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    _, ff = C.apply_business_rules(c, fx.flows(spark, sf_dir, c), fx.last_day(spark, sf_dir))
    return round_doubles(ff.select("customer_id", "date", "deposit_flow"))


# ---------------------------------------------------------------------- P9
@register("p9_drop_sparse_rows", fx.sql_with("market_gappy") + """
SELECT date, """ + ", ".join(rd(c, c) for c in MK) + """ FROM market_gappy
WHERE NOT ((CASE WHEN FED_FUNDS_RATE IS NULL THEN 1 ELSE 0 END + CASE WHEN TREASURY_10Y IS NULL THEN 1 ELSE 0 END
  + CASE WHEN TREASURY_5Y IS NULL THEN 1 ELSE 0 END + CASE WHEN TREASURY_2Y IS NULL THEN 1 ELSE 0 END
  + CASE WHEN TREASURY_3M IS NULL THEN 1 ELSE 0 END + CASE WHEN VIX IS NULL THEN 1 ELSE 0 END) / 6.0 > 0.5)""")
def p9_drop_sparse_rows(spark, sf_dir):
    cleaned, _ = C.remove_anomalous_patterns(fx.market_gappy(spark, sf_dir), [], ["date"])
    return round_doubles(cleaned)


@register("p9_pattern_report", fx.sql_with("market") + """,
m AS (SELECT date, round(VIX) AS vix_level, round(FED_FUNDS_RATE, 1) AS rate_level FROM market),
c AS (SELECT date, vix_level, rate_level,
        CASE WHEN vix_level = LAG(vix_level) OVER (ORDER BY date) THEN 0 ELSE 1 END AS cv,
        CASE WHEN rate_level = LAG(rate_level) OVER (ORDER BY date) THEN 0 ELSE 1 END AS cr FROM m),
g AS (SELECT SUM(cv) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS gv,
             SUM(cr) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS gr FROM c),
r AS (SELECT 'vix_level' AS col, MAX(n) AS max_run FROM (SELECT gv, COUNT(*) AS n FROM g GROUP BY gv)
      UNION ALL SELECT 'rate_level', MAX(n) FROM (SELECT gr, COUNT(*) AS n FROM g GROUP BY gr)),
u AS (SELECT 'vix_level' AS col, COUNT(DISTINCT vix_level) AS n_unique FROM m
      UNION ALL SELECT 'rate_level', COUNT(DISTINCT rate_level) FROM m)
SELECT r.col AS "column", u.n_unique, u.n_unique = 1 AS is_constant, r.max_run - 1 AS max_consecutive_equal,
       r.max_run - 1 > 10 AS suspicious
FROM r JOIN u ON r.col = u.col""")
def p9_pattern_report(spark, sf_dir):
    m = fx.market(spark, sf_dir).select("date", F.round("VIX").alias("vix_level"),
                                         F.round("FED_FUNDS_RATE", 1).alias("rate_level"))
    _, rep = C.remove_anomalous_patterns(m, ["vix_level", "rate_level"], ["date"])
    return rep


# --------------------------------------------------------------------- P10
@register("p10_convert_data_types", """
SELECT event_id, CAST(value AS VARCHAR) AS value_text, TRY_CAST(substr(props, 7, 2) AS DOUBLE) AS k_num,
       TRY_CAST(props AS DOUBLE) AS props_num, event_type
FROM events""")
def p10_convert_data_types(spark, sf_dir):
    from ..session import read_table
    e = read_table(spark, sf_dir, "events").select(
        "event_id", F.col("value").alias("value_text"), F.substring("props", 7, 2).alias("k_num"),
        F.col("props").alias("props_num"), "event_type")
    return C.convert_data_types(e, {"value_text": "string", "k_num": "numeric", "props_num": "numeric",
                                    "event_type": "category"})
