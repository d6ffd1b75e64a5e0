"""Registered queries: validation/quality (V1-V5) and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.core import round_doubles
from ..operators import clean as C
from ..operators import quality as Q
from ..operators import reports as RP
from .registry import register

CF = fx.sql_with("customers")
MS = fx.sql_with("market")

RULES = {
    "balance_range": {"type": "range", "column": "balance_avg", "min": 0, "max": 1e8},
    "id_not_null": {"type": "not_null", "column": "customer_id"},
    "id_unique": {"type": "unique", "column": "customer_id"},
    "segment_values": {"type": "values", "column": "segment",
                       "allowed_values": ["RETAIL_SMALL", "RETAIL_MEDIUM", "RETAIL_LARGE", "SME", "CORPORATE"]},
    "id_pattern": {"type": "pattern", "column": "customer_id", "pattern": "CUST_[0-9]{6}"},
    "region_pattern": {"type": "pattern", "column": "region", "pattern": "A"},
    "unknown_rule": {"type": "monotonic", "column": "balance_avg"},
    "absent_column": {"type": "not_null", "column": "no_such_column"},
}


@register("v1_validate_consistency", CF + """
SELECT 'balance_range' AS rule, COUNT(CASE WHEN NOT COALESCE(balance_avg BETWEEN 0 AND 1e8, false) THEN 1 END) = 0 AS passed,
       COUNT(CASE WHEN NOT COALESCE(balance_avg BETWEEN 0 AND 1e8, false) THEN 1 END) AS violations FROM customers
UNION ALL SELECT 'id_not_null', COUNT(CASE WHEN customer_id IS NULL THEN 1 END) = 0,
       COUNT(CASE WHEN customer_id IS NULL THEN 1 END) FROM customers
UNION ALL SELECT 'id_unique', COUNT(*) - COUNT(DISTINCT customer_id) = 0, COUNT(*) - COUNT(DISTINCT customer_id) FROM customers
UNION ALL SELECT 'segment_values',
       COUNT(CASE WHEN NOT COALESCE(segment IN ('RETAIL_SMALL','RETAIL_MEDIUM','RETAIL_LARGE','SME','CORPORATE'), false) THEN 1 END) = 0,
       COUNT(CASE WHEN NOT COALESCE(segment IN ('RETAIL_SMALL','RETAIL_MEDIUM','RETAIL_LARGE','SME','CORPORATE'), false) THEN 1 END)
       FROM customers
UNION ALL SELECT 'id_pattern', COUNT(CASE WHEN NOT regexp_matches(COALESCE(customer_id, 'nan'), '^(?:CUST_[0-9]{6})') THEN 1 END) = 0,
       COUNT(CASE WHEN NOT regexp_matches(COALESCE(customer_id, 'nan'), '^(?:CUST_[0-9]{6})') THEN 1 END) FROM customers
UNION ALL SELECT 'region_pattern', COUNT(CASE WHEN NOT regexp_matches(COALESCE(region, 'nan'), '^(?:A)') THEN 1 END) = 0,
       COUNT(CASE WHEN NOT regexp_matches(COALESCE(region, 'nan'), '^(?:A)') THEN 1 END) FROM customers
UNION ALL SELECT 'unknown_rule', false, CAST(NULL AS BIGINT)
UNION ALL SELECT 'absent_column', false, CAST(NULL AS BIGINT)""")
def v1_validate_consistency(spark, sf_dir):
    return Q.validate_consistency(fx.customers(spark, sf_dir), RULES)


@register("v2_validate_integrity", fx.sql_with("market", "flows") + """,
mr AS (SELECT MIN(date) AS ms, MAX(date) AS me, COUNT(*) AS mn FROM market),
fr AS (SELECT MIN(date) AS fs, MAX(date) AS fe, COUNT(*) AS fn FROM flows),
o AS (SELECT COUNT(*) AS orphans FROM (SELECT DISTINCT customer_id FROM flows) f
      WHERE NOT EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = f.customer_id)),
nc AS (SELECT COUNT(*) AS nc FROM customers),
r AS (SELECT *, COALESCE(fs >= ms AND fe <= me, false) AS ok FROM mr, fr, o, nc)
SELECT ms AS market_start, me AS market_end, mn AS market_rows, fs AS flow_start, fe AS flow_end, fn AS flow_rows,
  nc AS customer_rows, orphans AS orphan_flow_customers, ok AS dates_in_market_range,
  list_filter([CASE WHEN NOT ok THEN 'Flow dates outside market data range' END,
               CASE WHEN orphans > 0 THEN 'Orphan flow records' END,
               CASE WHEN mn < 30 THEN 'Insufficient market data' END,
               CASE WHEN nc < 100 THEN 'Insufficient customer data' END,
               CASE WHEN fn < 1000 THEN 'Insufficient flow data' END], lambda x: x IS NOT NULL) AS issues,
  len(list_filter([CASE WHEN NOT ok THEN 'a' END, CASE WHEN orphans > 0 THEN 'b' END, CASE WHEN mn < 30 THEN 'c' END,
                   CASE WHEN nc < 100 THEN 'd' END, CASE WHEN fn < 1000 THEN 'e' END], lambda x: x IS NOT NULL)) = 0
    AS overall_valid
FROM r""")
def v2_validate_integrity(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    return Q.validate_integrity(fx.market(spark, sf_dir), c, fx.flows(spark, sf_dir, c))


@register("v3_quality_report", fx.sql_with("flows") + f""",
cl AS (SELECT * FROM customers WHERE NOT COALESCE(balance_avg < 0 OR balance_avg > 1e8, false)
       AND COALESCE(segment IN ('RETAIL_SMALL','RETAIL_MEDIUM','RETAIL_LARGE','SME','CORPORATE'), false)
       AND NOT COALESCE(account_opening_date < DATE '1990-01-01' OR account_opening_date > {fx.LAST_DAY_SQL}, false)),
a AS (SELECT COUNT(*) AS n0 FROM customers), b AS (SELECT COUNT(*) AS n1 FROM cl),
r AS (SELECT n0, n1, (n0 - n1) * 100.0 / n0 AS rp FROM a, b)
SELECT 'customers' AS "table", n0 AS original_rows, n1 AS cleaned_rows, n0 - n1 AS rows_removed,
  round(rp, 4) AS removal_percentage, CAST(0 AS BIGINT) AS missing_before, CAST(0 AS BIGINT) AS missing_after,
  round(100.0, 4) AS completeness, CASE WHEN rp <= 5 THEN 95.0 ELSE 80.0 END AS consistency,
  CAST(90.0 AS DOUBLE) AS validity,
  round(100.0 * 0.4 + (CASE WHEN rp <= 5 THEN 95.0 ELSE 80.0 END) * 0.3 + 90.0 * 0.3, 4) AS overall_score
FROM r""")
def v3_quality_report(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    return round_doubles(Q.quality_report(c, C.clean_customer_data(c, fx.last_day(spark, sf_dir)), "customers"))


@register("v4_quality_score", fx.sql_with("market_gappy") + """,
n AS (SELECT COUNT(*) AS n, SUM((FED_FUNDS_RATE IS NULL)::INT + (TREASURY_10Y IS NULL)::INT + (TREASURY_5Y IS NULL)::INT
        + (TREASURY_2Y IS NULL)::INT + (TREASURY_3M IS NULL)::INT + (VIX IS NULL)::INT + (date IS NULL)::INT) AS m
      FROM market_gappy)
SELECT round((1 - m / (n * 7.0)) * 100, 4) AS completeness,
       round((1 - m / (n * 7.0)) * 100 * 0.3 + 0.2 * 100 + 0.2 * 100 + 0.2 * 90 + 0.1 * 95, 4) AS quality_score FROM n""")
def v4_quality_score(spark, sf_dir):
    return round_doubles(Q.quality_score(fx.market_gappy(spark, sf_dir)))


@register("v5_assess_bundle", fx.sql_with("market_gappy", "flows") + """,
m AS (SELECT COUNT(*) AS n, MIN(date) AS s, MAX(date) AS e,
        SUM((FED_FUNDS_RATE IS NULL)::INT + (TREASURY_10Y IS NULL)::INT + (TREASURY_5Y IS NULL)::INT
        + (TREASURY_2Y IS NULL)::INT + (TREASURY_3M IS NULL)::INT + (VIX IS NULL)::INT) * 100.0 / (COUNT(*) * 6) AS mp
      FROM market_gappy),
c AS (SELECT COUNT(*) AS nc FROM customers), f AS (SELECT COUNT(*) AS nf FROM flows)
SELECT n AS market_records, s AS start, e AS "end", round(mp, 4) AS market_missing_pct, nc AS customer_records,
  nf AS flow_records, round((100 - mp) * 0.6 + (CASE WHEN nc > 100 THEN 100.0 ELSE 0.0 END) * 0.4, 4) AS quality_score,
  list_filter([CASE WHEN mp > 10 THEN 'High missing data in market series' END,
               CASE WHEN nc <= 100 THEN 'Limited customer data' END], lambda x: x IS NOT NULL) AS issues
FROM m, c, f""")
def v5_assess_bundle(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    return round_doubles(Q.assess_bundle(fx.market_gappy(spark, sf_dir), c, fx.flows(spark, sf_dir, c)))


# ---------------------------------------------------------------------- reports
@register("a7_summary_statistics", CF + """,
s AS (SELECT 'rate_sensitivity' AS "column", rate_sensitivity AS x FROM customers
      UNION ALL SELECT 'balance_avg', balance_avg FROM customers),
g AS (SELECT "column", COUNT(x) AS n, AVG(x) AS m, STDDEV_SAMP(x) AS sd, MIN(x) AS mn, MAX(x) AS mx,
             quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3,
             VAR_SAMP(x) AS v FROM s GROUP BY "column"),
mo AS (SELECT s."column", AVG(pow(x - g.m, 2)) AS m2, AVG(pow(x - g.m, 3)) AS m3, AVG(pow(x - g.m, 4)) AS m4
       FROM s JOIN g ON s."column" = g."column" GROUP BY s."column"),
k AS (SELECT g.*, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM g JOIN mo ON g."column" = mo."column")
SELECT "column", statistic, round(value, 4) AS value FROM k,
  LATERAL (VALUES ('count', CAST(n AS DOUBLE)), ('mean', m), ('std', sd), ('min', mn), ('25%', q1), ('50%', q2),
                  ('75%', q3), ('max', mx),
                  ('skewness', CASE WHEN n > 2 THEN g1 * sqrt(n * (n - 1.0)) / (n - 2) END),
                  ('kurtosis', CASE WHEN n > 3 THEN (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * g2 + 6) END),
                  ('variance', v)) AS t(statistic, value)""")
def a7_summary_statistics(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    return round_doubles(RP.summary_statistics(c, ["rate_sensitivity", "balance_avg"]))


@register("a7_top_values", CF + """
SELECT "column", value, count FROM (
  SELECT 'region' AS "column", region AS value, COUNT(*) AS count,
         row_number() OVER (ORDER BY COUNT(*) DESC, region) AS rn FROM customers WHERE region IS NOT NULL GROUP BY region
  UNION ALL
  SELECT 'industry', industry, COUNT(*), row_number() OVER (ORDER BY COUNT(*) DESC, industry)
  FROM customers WHERE industry IS NOT NULL GROUP BY industry) WHERE rn <= 10""")
def a7_top_values(spark, sf_dir):
    return RP.top_values(fx.customers(spark, sf_dir), ["region", "industry"], 10)


_PROFILED = {"customer_id": "string", "segment": "string", "balance_avg": "double", "rate_sensitivity": "double",
             "loyalty_score": "double", "volatility_factor": "double", "region": "string", "industry": "string",
             "account_opening_date": "date"}
_NUMBERS = [c for c, t in _PROFILED.items() if t == "double"]


@register("a7_grouped_statistics", CF + ", p AS (" + " UNION ALL ".join(
    f"SELECT segment, '{c}' AS \"column\", AVG({c}) AS m, STDDEV_SAMP({c}) AS s, COUNT({c}) AS n FROM customers "
    "WHERE segment IS NOT NULL GROUP BY segment" for c in _NUMBERS) + """)
SELECT segment AS "group", "column", statistic, round(value, 4) AS value FROM p,
  LATERAL (VALUES ('mean', m), ('std', s), ('count', CAST(n AS DOUBLE))) AS t(statistic, value)""")
def a7_grouped_statistics(spark, sf_dir):
    return round_doubles(RP.grouped_statistics(fx.customers(spark, sf_dir), "segment"))


_MISSING = {"date": "date", "FED_FUNDS_RATE": "double", "TREASURY_10Y": "double", "VIX": "double"}


@register("a7_missing_summary", fx.sql_with("market_gappy") + ", p AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS missing FROM market_gappy"
    for c, t in _MISSING.items()) + """)
SELECT "column", dtype, rows, missing, round(100.0 * missing / rows, 4) AS missing_percentage FROM p
UNION ALL SELECT '(table)', NULL, MAX(rows), CAST(SUM(missing) AS BIGINT), round(100.0 * SUM(missing) / SUM(rows), 4) FROM p""")
def a7_missing_summary(spark, sf_dir):
    """The table with gaps is the one whose missing values are reported."""
    return round_doubles(RP.missing_summary(fx.market_gappy(spark, sf_dir).select(*_MISSING)))


def _profile_sql() -> str:
    parts = []

    def add(metrics: dict, source: str = "customers", texts: dict | None = None, column: str = "") -> None:
        rows = [f"('{m}', CAST({e} AS DOUBLE), CAST(NULL AS VARCHAR))" for m, e in metrics.items()]
        rows += [f"('{m}', CAST(NULL AS DOUBLE), CAST({e} AS VARCHAR))" for m, e in (texts or {}).items()]
        parts.append(f"SELECT '{column}' AS \"column\", t.metric, t.value, t.text FROM {source}, "
                     f"LATERAL (VALUES {', '.join(rows)}) AS t(metric, value, text)")

    for c, kind in _PROFILED.items():
        add({"non_null_count": "v", "null_count": "n - v", "unique_count": "u", "null_percentage": "100.0 * (n - v) / n",
             "unique_percentage": "100.0 * u / n"},
            f"(SELECT COUNT(*) AS n, COUNT({c}) AS v, COUNT(DISTINCT {c}) AS u FROM customers)", {"dtype": f"'{kind}'"}, c)
        if kind == "double":
            add({k: k.replace("min", "lo").replace("max", "hi") if k in ("min", "max") else k for k in (
                    "min", "max", "mean", "std", "skewness", "kurtosis", "zeros_count", "negative_count", "median", "outliers_count")},
                f"(SELECT MIN({c}) AS lo, MAX({c}) AS hi, AVG({c}) AS mean, STDDEV_SAMP({c}) AS std, skewness({c}) AS skewness, "
                f"kurtosis({c}) AS kurtosis, COUNT(CASE WHEN {c} = 0 THEN 1 END) AS zeros_count, "
                f"COUNT(CASE WHEN {c} < 0 THEN 1 END) AS negative_count, quantile_cont({c}, 0.5) AS median, "
                f"COUNT(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers_count "
                f"FROM customers, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM customers))", None, c)
        elif kind == "string":
            add({"min_length": "lo", "max_length": "hi", "avg_length": "mean"},
                f"(SELECT MIN(length({c})) AS lo, MAX(length({c})) AS hi, AVG(length({c})) AS mean FROM customers)", None, c)
            add({"most_frequent_count": "k"},
                f"(SELECT {c} AS x, COUNT(*) AS k FROM customers WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY k DESC, x LIMIT 1)",
                {"most_frequent": "x"}, c)
    cells = " + ".join(f"COUNT({c})" for c in _PROFILED)
    add({"rows": "n", "columns": str(len(_PROFILED)),
         "quality_score": f"round_even(30.0 * cells / (n * {len(_PROFILED)}) + 20 + 20 + 18 + 9.5, 2)"},
        f"(SELECT COUNT(*) AS n, {cells} AS cells FROM customers)", None, "(table)")
    return CF + ", p AS (" + "\nUNION ALL ".join(parts) + ") SELECT \"column\", metric, round(value, 4) AS value, text FROM p"


@register("a8_data_profile", _profile_sql())
def a8_data_profile(spark, sf_dir):
    """Profile of every column of the customers, with the table's score."""
    return round_doubles(RP.data_profile(fx.customers(spark, sf_dir)))


_CORR_COLS = ["FED_FUNDS_RATE", "TREASURY_10Y", "VIX"]


@register("a9_pearson_correlation", fx.sql_with("market_gappy") + ", p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, CASE WHEN COUNT(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) >= 10 "
    f"THEN corr(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END) END AS c FROM market_gappy"
    for a in _CORR_COLS for b in _CORR_COLS) + ") SELECT var1, var2, round(c, 4) AS corr FROM p")
def a9_pearson_correlation(spark, sf_dir):
    return round_doubles(RP.correlation_matrix(fx.market_gappy(spark, sf_dir), _CORR_COLS))


@register("a9_spearman_correlation", fx.sql_with("market_gappy") + ", p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM market_gappy "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in _CORR_COLS for b in _CORR_COLS) + """),
r AS (SELECT var1, var2,
        rank() OVER (PARTITION BY var1, var2 ORDER BY x) + (COUNT(*) OVER (PARTITION BY var1, var2, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY var1, var2 ORDER BY y) + (COUNT(*) OVER (PARTITION BY var1, var2, y) - 1) / 2.0 AS ry
      FROM p)
SELECT var1, var2, round(CASE WHEN COUNT(*) >= 10 THEN corr(rx, ry) END, 4) AS corr FROM r GROUP BY var1, var2""")
def a9_spearman_correlation(spark, sf_dir):
    return round_doubles(RP.correlation_matrix(fx.market_gappy(spark, sf_dir), _CORR_COLS, "spearman"))


@register("a12_top_correlated_pairs", MS + ", p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS c FROM market"
    for i, a in enumerate(["FED_FUNDS_RATE", "TREASURY_10Y", "TREASURY_2Y", "VIX"])
    for b in ["FED_FUNDS_RATE", "TREASURY_10Y", "TREASURY_2Y", "VIX"][i + 1:]) + """)
SELECT var1, var2, round(c, 4) AS corr FROM (SELECT * FROM p ORDER BY abs(round(c, 9)) DESC, var1, var2 LIMIT 10)
WHERE abs(c) > 0.3""")
def a12_top_correlated_pairs(spark, sf_dir):
    cols = ["FED_FUNDS_RATE", "TREASURY_10Y", "TREASURY_2Y", "VIX"]
    cm = RP.correlation_matrix(fx.market(spark, sf_dir), cols, min_periods=1)
    return round_doubles(RP.top_correlated_pairs(cm, order=cols))


@register("a10_calendar_heatmap", fx.sql_with("flows") + """
SELECT year(date) AS year, month(date) AS month, """ + ", ".join(
    f'round(AVG(CASE WHEN day(date) = {d} THEN deposit_flow END), 4) AS "{d}"' for d in range(1, 32)) + """
FROM flows GROUP BY year(date), month(date)""")
def a10_calendar_heatmap(spark, sf_dir):
    return round_doubles(RP.calendar_heatmap(fx.flows(spark, sf_dir), "deposit_flow"))


@register("a13_histogram", CF + """,
r AS (SELECT MIN(loyalty_score) AS lo, MAX(loyalty_score) AS hi FROM customers),
b AS (SELECT CAST(CASE WHEN (hi - lo) / 20 = 0 THEN 0 ELSE least(floor((loyalty_score - lo) / ((hi - lo) / 20)), 19) END
             AS INTEGER) AS bin, lo, hi FROM customers, r WHERE loyalty_score IS NOT NULL)
SELECT bin, round(lo + (hi - lo) / 20 * bin, 4) AS lower, round(lo + (hi - lo) / 20 * (bin + 1), 4) AS upper,
       COUNT(*) AS count FROM b GROUP BY bin, lo, hi""")
def a13_histogram(spark, sf_dir):
    return round_doubles(RP.histogram(fx.customers(spark, sf_dir), "loyalty_score", 20))


@register("a13_box_stats_by_segment", CF + """
SELECT segment, round(MIN(balance_avg), 4) AS min, round(quantile_cont(balance_avg, 0.25), 4) AS q1,
  round(quantile_cont(balance_avg, 0.5), 4) AS median, round(quantile_cont(balance_avg, 0.75), 4) AS q3,
  round(MAX(balance_avg), 4) AS max FROM customers GROUP BY segment""")
def a13_box_stats_by_segment(spark, sf_dir):
    return round_doubles(RP.box_stats(fx.customers(spark, sf_dir), "balance_avg", ["segment"]))


@register("a14_regime_day_counts", MS + """,
t AS (SELECT COUNT(*) AS n, COUNT(CASE WHEN VIX < 15 THEN 1 END) AS r0,
             COUNT(CASE WHEN VIX >= 15 AND VIX < 25 THEN 1 END) AS r1,
             COUNT(CASE WHEN VIX >= 25 AND VIX < 35 THEN 1 END) AS r2, COUNT(CASE WHEN VIX >= 35 THEN 1 END) AS r3
      FROM market)
SELECT regime_order, regime, days, round(days * 100.0 / n, 4) AS percentage FROM t,
  LATERAL (VALUES (0, 'Low Volatility (VIX < 15)', r0), (1, 'Normal Volatility (15 <= VIX < 25)', r1),
                  (2, 'High Volatility (25 <= VIX < 35)', r2), (3, 'Extreme Volatility (VIX >= 35)', r3))
  AS v(regime_order, regime, days)""")
def a14_regime_day_counts(spark, sf_dir):
    return round_doubles(RP.regime_day_counts(fx.market(spark, sf_dir)))


@register("a15_latest_vix_snapshot", MS + """,
s AS (SELECT date, VIX, CASE WHEN COUNT(VIX) OVER w >= 21 THEN STDDEV_SAMP(VIX) OVER w END AS sd
      FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
l AS (SELECT * FROM s ORDER BY date DESC LIMIT 1),
a AS (SELECT AVG(VIX) AS m, AVG(CAST(VIX <= (SELECT VIX FROM l) AS DOUBLE)) * 100 AS p FROM market)
SELECT l.date AS as_of, round(l.VIX, 4) AS current, round(a.m, 4) AS mean, round(l.VIX - a.m, 4) AS delta_vs_mean,
       round(l.sd, 4) AS std_21, round(a.p, 4) AS current_percentile FROM l, a""")
def a15_latest_vix_snapshot(spark, sf_dir):
    return round_doubles(RP.latest_snapshot(fx.market(spark, sf_dir)))


@register("a16_spread_statistics", MS + """,
s AS (SELECT date, TREASURY_10Y - TREASURY_2Y AS a, TREASURY_2Y - TREASURY_3M AS b FROM market)
SELECT '10Y_2Y_Spread' AS spread, round(arg_max(a, date), 4) AS current, round(AVG(a), 4) AS mean,
       round(STDDEV_SAMP(a), 4) AS std, round(MIN(a), 4) AS min, round(MAX(a), 4) AS max FROM s
UNION ALL
SELECT '2Y_3M_Spread', round(arg_max(b, date), 4), round(AVG(b), 4), round(STDDEV_SAMP(b), 4), round(MIN(b), 4),
       round(MAX(b), 4) FROM s""")
def a16_spread_statistics(spark, sf_dir):
    m = fx.market(spark, sf_dir)
    return round_doubles(RP.spread_statistics(m, {
        "10Y_2Y_Spread": F.col("TREASURY_10Y") - F.col("TREASURY_2Y"),
        "2Y_3M_Spread": F.col("TREASURY_2Y") - F.col("TREASURY_3M")}))


@register("a17_current_metrics", fx.sql_with("market", "flows") + """,
m AS (SELECT * FROM market ORDER BY date DESC LIMIT 1),
t AS (SELECT COUNT(*) AS total_customers, SUM(balance_avg) AS total_deposits, SUM((rate_sensitivity * 0.4
        + (1 - loyalty_score) * 0.3 + volatility_factor * 0.3) * balance_avg) / SUM(balance_avg) AS behavioral_risk FROM customers),
h AS (SELECT SUM((e / total_deposits) ** 2) AS hhi FROM (SELECT segment, SUM(balance_avg) AS e FROM customers GROUP BY segment), t),
f AS (SELECT SUM(CASE WHEN date = d THEN deposit_flow END) AS latest_daily_flow, AVG(deposit_flow) AS avg_flow,
        COALESCE(AVG(CASE WHEN deposit_flow < 0 THEN abs(deposit_flow) END), 0) AS avg_outflow,
        SUM(CASE WHEN date = d THEN balance_end END) AS latest_balance FROM flows, (SELECT MAX(date) AS d FROM flows))
SELECT m.date AS as_of, round(FED_FUNDS_RATE, 4) AS FED_FUNDS_RATE, round(VIX, 4) AS VIX,
  round(TREASURY_10Y - TREASURY_2Y, 4) AS yield_spread, total_customers, round(total_deposits, 4) AS total_deposits,
  round(behavioral_risk, 4) AS behavioral_risk, round(latest_daily_flow, 4) AS latest_daily_flow, round(avg_flow, 4) AS avg_flow,
  round(0.15 * latest_balance / NULLIF(30 * avg_outflow, 0), 4) AS lcr_estimate, round(least(1.0, hhi * 10), 4) AS concentration_index
FROM m, t, h, f""")
def a17_current_metrics(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    return round_doubles(RP.current_metrics(fx.market(spark, sf_dir), c, fx.flows(spark, sf_dir, c)))


@register("a21_current_yield_curve", MS + """,
l AS (SELECT * FROM market ORDER BY date DESC LIMIT 1)
SELECT tenor_order, maturity, round(yield, 4) AS yield FROM l,
  LATERAL (VALUES (0, '3M', TREASURY_3M), (1, '2Y', TREASURY_2Y), (2, '5Y', TREASURY_5Y), (3, '10Y', TREASURY_10Y))
  AS v(tenor_order, maturity, yield) WHERE yield IS NOT NULL""")
def a21_current_yield_curve(spark, sf_dir):
    return round_doubles(RP.current_yield_curve(fx.market(spark, sf_dir)))


@register("p24_rate_sensitivity_whatif", CF + """
SELECT segment, round(SUM(rate_sensitivity * balance_avg * (100 / 10000.0) * 0.1), 4) AS impact,
       COUNT(*) AS customers FROM customers GROUP BY ROLLUP (segment)""")
def p24_rate_sensitivity_whatif(spark, sf_dir):
    return round_doubles(RP.rate_sensitivity_whatif(fx.customers(spark, sf_dir), 100.0))
