"""End-to-end compositions of the operators.

Each returns lazy DataFrames; nothing is collected except fitted model
parameters.  The market feature table is one row per day (calendar
bounded); the segment-day table is one row per (day, segment).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as CAL
from ..functions.core import columns_matching
from ..operators import clean as C
from ..operators import features as FE
from ..operators import flows as A
from ..operators import quality as Q
from ..operators import windows as W
from ..session import reliable_checkpoint


# --------------------------------------------------------------------------- V6
def clean_all(market: DataFrame, customers: DataFrame, flows: DataFrame, as_of: str) -> dict:
    """P5-P7, then P8, then P9 (NULL-heavy rows dropped), then V2 integrity
    and V3 quality reports per table.  Each cleaned table is written once to
    the shared checkpoint folder, where both reports and the caller read it;
    the flows are also written between P7 and P8, which reads them twice."""
    m = C.clean_market_data(market)
    c = C.clean_customer_data(customers, as_of)
    f = reliable_checkpoint(C.clean_flow_data(flows, as_of))
    c, f = C.apply_business_rules(c, f, as_of)
    m, _ = C.remove_anomalous_patterns(m, [], ["date"])
    c, _ = C.remove_anomalous_patterns(c, [], ["customer_id"])
    f, _ = C.remove_anomalous_patterns(f, [], ["date"], ["customer_id"])
    m, c, f = reliable_checkpoint(m), reliable_checkpoint(c), reliable_checkpoint(f)
    integrity = Q.validate_integrity(m, c, f)
    report = (Q.quality_report(market, m, "market_data")
                .unionByName(Q.quality_report(customers, c, "customer_data"))
                .unionByName(Q.quality_report(flows, f, "flow_data")))
    return {"market": m, "customers": c, "flows": f, "integrity": integrity, "quality_report": report}


# --------------------------------------------------------------------------- M4
def market_feature_table(market: DataFrame) -> DataFrame:
    """Lags 1/5/21 of rate columns; rolling stats 5/21/63 of rate and price
    columns; technical indicators of price columns; rate-change features;
    yield curve; regimes; calendar.  One row per day."""
    rates = columns_matching(market, "RATE", "TREASURY", "YIELD", numeric_only=True)
    prices = [c for c in columns_matching(market, "TREASURY", "VIX", "EUR", "GBP", numeric_only=True)]
    d = W.lag_features(market, rates, [1, 5, 21], ["date"])
    d = W.rolling_features(d, list(dict.fromkeys(rates + prices)), [5, 21, 63], ["date"])
    tech = FE.technical_indicators(market, prices)
    wide_tech = tech.groupBy("date").pivot("series", prices).agg(
        *[F.first(c).alias(c) for c in ("rsi_14", "macd", "macd_signal", "macd_histogram", "bb_upper",
                                        "bb_middle", "bb_lower", "bb_width", "williams_r")])
    d = d.join(wide_tech, "date", "left")
    d = FE.rate_change_features(d, rates)
    d = FE.yield_curve_features(d)
    d = FE.engineer_regimes(d)
    return CAL.calendar_features(d)


def feature_table(market: DataFrame, flows: DataFrame, horizons=(1, 5, 21)) -> DataFrame:
    """Segment-day behavioural features (A2) left-joined to the daily
    market features (broadcast: one row per day), market x segment
    interactions (P13), targets per segment; rows without targets are dropped
    first, then features are forward filled within the segment (the
    corrected order, Q8).  Both sides of the join are written once."""
    seg = reliable_checkpoint(A.segment_behavioral_features(flows))
    mk = reliable_checkpoint(market_feature_table(market))
    d = FE.segment_day_interactions(seg.join(F.broadcast(mk), "date", "left"))
    d = FE.target_variables(d, horizons)
    targets = [c for c in d.columns if c.startswith("target_flow_")]
    d = d.dropna(subset=targets)
    feats = [c for c in d.columns if c not in ("date", "segment") and not c.startswith("target_")]
    return W.forward_fill(d, feats, ["date"], ["segment"])


# --------------------------------------------------------------------------- T5
def train_and_compare(table: DataFrame, features, label: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Fit random forest and gradient-boosted trees on rows before
    ``cutoff``, predict the rest, and rank the models by rmse (EV8).
    Returns (long predictions, comparison)."""
    from ..operators import evaluate as EV
    from ..operators import ml as ML
    d = table.select("*", F.concat_ws("|", "segment", "date").alias("row_id"))
    train = d.where(F.col("date") < F.lit(cutoff).cast("date"))
    test = d.where(F.col("date") >= F.lit(cutoff).cast("date"))
    preds = None
    for kind in ("random_forest", "gbt"):
        m = ML.fit_regressor(train, features, label, kind)
        p = ML.predict_long(m, test, features, label, kind)
        preds = p if preds is None else preds.unionByName(p)
    return preds, EV.compare_models(EV.simple_metrics(preds, mape_mode="nonzero"))

