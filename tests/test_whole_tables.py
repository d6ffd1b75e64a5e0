"""Joins and fills over sources with gaps, against SQL with the same gaps."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tidewater import fixtures as fx
from tidewater.functions.core import round_doubles
from tidewater.operators import joins as J
from tidewater.sources import payloads as S

from test_oracle import SF, TABLES, _canon

MARKET_GAPS = fx.sql_with("market", "flows") + """,
m AS (SELECT date, FED_FUNDS_RATE, TREASURY_10Y, VIX, TREASURY_10Y - TREASURY_2Y AS YIELD_SPREAD_10Y2Y,
             FED_FUNDS_RATE - LAG(FED_FUNDS_RATE) OVER (ORDER BY date) AS FED_FUNDS_RATE_CHANGE
      FROM market WHERE date >= DATE '2024-01-05' AND dayofweek(date) NOT IN (0, 6)),
e AS (SELECT * FROM m ORDER BY date LIMIT 1),
j AS (SELECT f.customer_id, f.date, f.deposit_flow, m.date AS mdate, m.FED_FUNDS_RATE, m.TREASURY_10Y, m.VIX,
             m.YIELD_SPREAD_10Y2Y, m.FED_FUNDS_RATE_CHANGE
      FROM flows f ASOF LEFT JOIN m ON f.date >= m.date)
SELECT j.customer_id, j.date, round(j.deposit_flow, 4) AS deposit_flow,
  round(CASE WHEN j.mdate IS NULL THEN e.FED_FUNDS_RATE ELSE j.FED_FUNDS_RATE END, 4) AS fed_funds_rate,
  round(CASE WHEN j.mdate IS NULL THEN e.TREASURY_10Y ELSE j.TREASURY_10Y END, 4) AS treasury_10y,
  round(CASE WHEN j.mdate IS NULL THEN e.VIX ELSE j.VIX END, 4) AS vix,
  round(CASE WHEN j.mdate IS NULL THEN e.YIELD_SPREAD_10Y2Y ELSE j.YIELD_SPREAD_10Y2Y END, 4) AS yield_spread,
  round(CASE WHEN j.mdate IS NULL THEN e.FED_FUNDS_RATE_CHANGE ELSE j.FED_FUNDS_RATE_CHANGE END, 4) AS rate_change
FROM j, e"""

BALANCE_GAPS = fx.sql_with("flows") + """,
b AS (SELECT customer_id, date AS ts, balance_end FROM flows WHERE dayofweek(date) IN (1, 3, 5)),
q AS (SELECT customer_id, date AS ts, deposit_flow FROM flows)
SELECT q.customer_id, q.ts, round(q.deposit_flow, 4) AS deposit_flow, round(b.balance_end, 4) AS balance_end
FROM q ASOF LEFT JOIN b ON q.customer_id = b.customer_id AND q.ts >= b.ts"""

SOURCE_GAPS = fx.sql_with("market") + """,
rates AS (SELECT date, FED_FUNDS_RATE, TREASURY_10Y FROM market WHERE dayofmonth(date) <> 15),
vol AS (SELECT date, VIX, TREASURY_10Y FROM market WHERE dayofweek(date) <> 2),
dates AS (SELECT date FROM rates UNION SELECT date FROM vol),
j AS (SELECT d.date, r.FED_FUNDS_RATE, COALESCE(r.TREASURY_10Y, v.TREASURY_10Y) AS TREASURY_10Y, v.VIX
      FROM dates d LEFT JOIN rates r ON d.date = r.date LEFT JOIN vol v ON d.date = v.date)
SELECT date,
  round(last_value(FED_FUNDS_RATE IGNORE NULLS) OVER w, 4) AS FED_FUNDS_RATE,
  round(last_value(TREASURY_10Y IGNORE NULLS) OVER w, 4) AS TREASURY_10Y,
  round(last_value(VIX IGNORE NULLS) OVER w, 4) AS VIX
FROM j WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

SERIES_GAPS = fx.sql_with("market") + """,
l AS (SELECT date, 'FED_FUNDS_RATE' AS series, FED_FUNDS_RATE AS value FROM market WHERE dayofmonth(date) <> 10
      UNION ALL SELECT date, 'VIX', VIX FROM market WHERE dayofmonth(date) <> 20),
d AS (SELECT date, MAX(CASE WHEN series = 'FED_FUNDS_RATE' THEN value END) AS FED_FUNDS_RATE,
             MAX(CASE WHEN series = 'VIX' THEN value END) AS VIX FROM l GROUP BY date)
SELECT date,
  round(last_value(FED_FUNDS_RATE IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 4) AS FED_FUNDS_RATE,
  round(last_value(VIX IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 4) AS VIX
FROM d"""


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def same(df, con, sql):
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    want = _canon(res.fetchall(), names)
    assert want and _canon([tuple(r) for r in df.collect()], df.columns) == want


def test_market_gaps(spark, con, monkeypatch):
    market = fx.market
    monkeypatch.setattr(fx, "market", lambda s, d: market(s, d).where("date >= date'2024-01-05' and dayofweek(date) not in (1, 7)"))
    same(E.queries()["j6_asof_market_conditions"](spark, SF), con, MARKET_GAPS)


def test_balance_gaps(spark, con):
    f = fx.flows(spark, SF).withColumnRenamed("date", "ts")
    right = f.where("dayofweek(ts) in (2, 4, 6)").select("customer_id", "ts", "balance_end")
    out = J.asof_join_entity(f.select("customer_id", "ts", "deposit_flow"), right, "customer_id", "ts", ["balance_end"])
    same(round_doubles(out), con, BALANCE_GAPS)


def test_source_gaps(spark, con):
    m = fx.market(spark, SF)
    rates = m.where("day(date) <> 15").select("date", "FED_FUNDS_RATE", "TREASURY_10Y")
    vol = m.where("dayofweek(date) <> 3").select("date", "VIX", "TREASURY_10Y")
    same(round_doubles(J.assemble_on_date([rates, vol], "date", fill="ffill")), con, SOURCE_GAPS)


def test_series_gaps(spark, con):
    m = fx.market(spark, SF)
    part = lambda c, day: m.where(F.dayofmonth("date") != day).select("date", F.lit(c).alias("series"), F.col(c).alias("value"))
    long = part("FED_FUNDS_RATE", 10).unionByName(part("VIX", 20))
    same(round_doubles(S.wide_from_series(long, ["FED_FUNDS_RATE", "VIX"])), con, SERIES_GAPS)
