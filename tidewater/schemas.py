"""Table schemas and the fixed business constants.

The values in the "fixed values" blocks must equal the modelled
application's constants for results to agree; they are stated plainly and
in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (segment list, balance bands, risk limits, scenarios)
# ---------------------------------------------------------------------------
SEGMENTS = ["RETAIL_SMALL", "RETAIL_MEDIUM", "RETAIL_LARGE", "SME", "CORPORATE"]

# (min_balance, max_balance) per segment, in this order; max None = unbounded
SEGMENT_BANDS = [
    ("RETAIL_SMALL", 0.0, 10_000.0),
    ("RETAIL_MEDIUM", 10_000.0, 100_000.0),
    ("RETAIL_LARGE", 100_000.0, 1_000_000.0),
    ("SME", 50_000.0, 5_000_000.0),
    ("CORPORATE", 1_000_000.0, None),
]

LCR_MINIMUM = 1.0
LCR_BUFFER = 0.1
VAR_CONFIDENCE = 0.95
CORPORATE_MIN_BALANCE = 1_000_000.0
MIN_HISTORY_DAYS = 30
RELATIVE_VOLATILITY_LIMIT = 0.5

# standard scenario templates: name, rate shock (bps), outflow rate, VIX shock, economic shock
STANDARD_SCENARIOS = [
    ("mild_rate_shock", 100.0, 0.05, 10.0, "none"),
    ("severe_rate_shock", 300.0, 0.20, 20.0, "mild_recession"),
    ("financial_crisis", 0.0, 0.30, 40.0, "financial_crisis"),
    ("economic_recession", -200.0, 0.15, 25.0, "severe_recession"),
]

# economic shocks: name, deposit impact, flow volatility multiplier, rate sensitivity increase
ECONOMIC_SHOCKS = [
    ("mild_recession", 0.95, 1.3, 0.1),
    ("severe_recession", 0.85, 2.0, 0.2),
    ("financial_crisis", 0.75, 3.0, 0.3),
    ("inflation_spike", 0.90, 1.5, 0.25),
]

# stress presets of the risk configuration: name, rate shock, deposit outflow
RISK_STRESS_PRESETS = [
    ("MILD", 0.01, 0.1),
    ("MODERATE", 0.025, 0.2),
    ("SEVERE", 0.05, 0.4),
]

# ---------------------------------------------------------------------------
# Schemas of the modelled tables (FIXTURES.md section 1)
# ---------------------------------------------------------------------------
CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("segment", T.StringType(), True),
    T.StructField("balance_avg", T.DoubleType(), True),
    T.StructField("rate_sensitivity", T.DoubleType(), True),
    T.StructField("loyalty_score", T.DoubleType(), True),
    T.StructField("volatility_factor", T.DoubleType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("industry", T.StringType(), True),
    T.StructField("account_opening_date", T.DateType(), True),
])

FLOWS = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("deposit_flow", T.DoubleType(), True),
    T.StructField("inflow", T.DoubleType(), True),
    T.StructField("outflow", T.DoubleType(), True),
    T.StructField("segment", T.StringType(), True),
    T.StructField("balance_start", T.DoubleType(), True),
    T.StructField("balance_end", T.DoubleType(), True),
])

MARKET_SERIES = ["FED_FUNDS_RATE", "TREASURY_10Y", "TREASURY_5Y", "TREASURY_2Y",
                 "TREASURY_3M", "VIX"]

PREDICTIONS = T.StructType([
    T.StructField("model_name", T.StringType(), False),
    T.StructField("row_id", T.LongType(), False),
    T.StructField("date", T.DateType(), True),
    T.StructField("actual", T.DoubleType(), True),
    T.StructField("predicted", T.DoubleType(), True),
])

API_CALLS = T.StructType([
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("success", T.BooleanType(), True),
    T.StructField("response_time", T.DoubleType(), True),
])
