"""Validation and data-quality reports (V1-V5), one aggregation each.

Every rule becomes an aggregate of a single ``agg`` over the table, so a
report costs one scan regardless of the number of rules; results are
one-row or long (rule, passed, violations) frames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import numeric_columns, scalar_fields


# --------------------------------------------------------------------------- V1
def _violations(df: DataFrame, rule: Mapping) -> Column | None:
    c = rule.get("column")
    if c not in df.columns:
        return None
    x = F.col(c)
    t = rule.get("type")
    if t == "range":
        ok = x.between(rule["min"], rule["max"])
        return F.count(F.when(~F.coalesce(ok, F.lit(False)), 1))
    if t == "not_null":
        return F.count(F.when(x.isNull(), 1))
    if t == "unique":
        # pandas nunique excludes NULL while len counts it: any NULL fails
        return F.count(F.lit(1)) - F.countDistinct(x)
    if t == "values":
        ok = x.isin(*rule.get("allowed_values", []))
        return F.count(F.when(~F.coalesce(ok, F.lit(False)), 1))
    if t == "pattern":
        # NULL becomes the text 'nan' before the anchored match
        txt = F.coalesce(x.cast("string"), F.lit("nan"))
        return F.count(F.when(~txt.rlike("^(?:" + rule["pattern"] + ")"), 1))
    return None


def validate_consistency(df: DataFrame, rules: Mapping[str, Mapping]) -> DataFrame:
    """Long (rule, passed, violations); unknown rule type or absent column
    fails with NULL violations."""
    aggs, names = [], []
    for name, rule in rules.items():
        v = _violations(df, rule)
        if v is not None:
            aggs.append(v.cast("long").alias(name))
            names.append(name)
    wide = df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("__n"))
    arr = [F.struct(F.lit(n).alias("rule"), (F.col(f"`{n}`") == 0).alias("passed"),
                    F.col(f"`{n}`").alias("violations")) for n in names]
    arr += [F.struct(F.lit(n).alias("rule"), F.lit(False).alias("passed"), F.lit(None).cast("long")
                     .alias("violations")) for n in rules if n not in names]
    return wide.select(F.explode(F.array(*arr)).alias("s")).select("s.*")


# --------------------------------------------------------------------------- V2
def validate_integrity(market: DataFrame, customers: DataFrame, flows: DataFrame,
                       min_market: int = 30, min_customers: int = 100, min_flows: int = 1000) -> DataFrame:
    """One row: flow dates inside the market range, orphan flow customers
    (anti-join count), minimum volumes, required columns, issue list."""
    mr = market.agg(F.min("date").alias("mn"), F.max("date").alias("mx"), F.count(F.lit(1)).alias("n"))
    fr = flows.agg(F.min("date").alias("mn"), F.max("date").alias("mx"), F.count(F.lit(1)).alias("n"))
    n_cust = customers.agg(F.count(F.lit(1))).scalar()
    orphans = (flows.select("customer_id").distinct()
                    .join(customers.select("customer_id"), "customer_id", "left_anti")
                    .agg(F.count(F.lit(1))).scalar())
    req = {"customers": ["customer_id", "segment"], "flows": ["customer_id", "date", "deposit_flow"]}
    missing = [f"{t}.{c}" for t, cols in req.items() for c in cols
               if c not in (customers.columns if t == "customers" else flows.columns)]
    row = mr.select(F.col("mn").alias("market_start"), F.col("mx").alias("market_end"),
                    F.col("n").alias("market_rows"),
                    *[scalar_fields(fr)[c].alias(f"flow_{c}") for c in ("mn", "mx", "n")],
                    n_cust.alias("customer_rows"), orphans.alias("orphan_flow_customers"))
    row = row.withColumnsRenamed({"flow_mn": "flow_start", "flow_mx": "flow_end", "flow_n": "flow_rows"})
    in_range = (F.col("flow_start") >= F.col("market_start")) & (F.col("flow_end") <= F.col("market_end"))
    issues = F.array_compact(F.array(
        F.when(~F.coalesce(in_range, F.lit(False)), F.lit("Flow dates outside market data range")),
        F.when(F.col("orphan_flow_customers") > 0, F.lit("Orphan flow records")),
        F.when(F.col("market_rows") < min_market, F.lit("Insufficient market data")),
        F.when(F.col("customer_rows") < min_customers, F.lit("Insufficient customer data")),
        F.when(F.col("flow_rows") < min_flows, F.lit("Insufficient flow data")),
        *[F.lit(f"Missing column {m}") for m in missing]))
    return row.select("*", F.coalesce(in_range, F.lit(False)).alias("dates_in_market_range"),
                      issues.alias("issues"), (F.size(issues) == 0).alias("overall_valid"))


# --------------------------------------------------------------------------- V3
def quality_report(original: DataFrame, cleaned: DataFrame, name: str = "table") -> DataFrame:
    """Rows removed and %, missing cells before/after, completeness %,
    consistency 95 (<= 5 % removed) or 80, validity 90, weighted score
    .4/.3/.3."""
    o = original.agg(F.count(F.lit(1)).alias("n0"),
                     F.sum(sum((F.col(c).isNull().cast("long") for c in original.columns), F.lit(0))).alias("m0"))
    c = cleaned.agg(F.count(F.lit(1)).alias("n1"),
                    F.sum(sum((F.col(x).isNull().cast("long") for x in cleaned.columns), F.lit(0))).alias("m1"))
    cf = scalar_fields(c)
    n1, m1 = cf["n1"], cf["m1"]
    row = o.select(F.lit(name).alias("table"), F.col("n0").alias("original_rows"), n1.alias("cleaned_rows"),
                   (F.col("n0") - n1).alias("rows_removed"),
                   ((F.col("n0") - n1) / F.col("n0") * 100).alias("removal_percentage"),
                   F.coalesce(F.col("m0"), F.lit(0)).alias("missing_before"),
                   F.coalesce(m1, F.lit(0)).alias("missing_after"),
                   ((1 - F.coalesce(m1, F.lit(0)) / (n1 * len(cleaned.columns))) * 100).alias("completeness"))
    consistency = F.when(F.col("removal_percentage") <= 5, 95.0).otherwise(80.0)
    row = row.select("*", consistency.alias("consistency"), F.lit(90.0).alias("validity"))
    return row.select("*", (F.col("completeness") * 0.4 + F.col("consistency") * 0.3 + F.col("validity") * 0.3)
                      .alias("overall_score"))


# --------------------------------------------------------------------------- V4
def quality_score(df: DataFrame) -> DataFrame:
    """.3*completeness + .2*100 + .2*100 + .2*90 + .1*95 (fixed parts as in
    the modelled application)."""
    n = df.agg(F.count(F.lit(1)).alias("n"),
               F.sum(sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))).alias("m"))
    comp = (1 - F.coalesce(F.col("m"), F.lit(0)) / (F.col("n") * len(df.columns))) * 100
    return n.select(comp.alias("completeness"),
                    (comp * 0.3 + 0.2 * 100 + 0.2 * 100 + 0.2 * 90 + 0.1 * 95).alias("quality_score"))


# --------------------------------------------------------------------------- V5
def assess_bundle(market: DataFrame, customers: DataFrame, flows: DataFrame) -> DataFrame:
    """Records, date range, market missing %, score .6*market completeness
    + .4*(100 if customers > 100), issues."""
    num = numeric_columns(market)
    m = market.agg(F.count(F.lit(1)).alias("market_records"), F.min("date").alias("start"),
                   F.max("date").alias("end"),
                   F.sum(sum((F.col(c).isNull().cast("long") for c in num), F.lit(0))).alias("__miss"))
    miss_pct = F.col("__miss") / (F.col("market_records") * len(num)) * 100
    nc = customers.agg(F.count(F.lit(1))).scalar()
    nf = flows.agg(F.count(F.lit(1))).scalar()
    score = (100 - miss_pct) * 0.6 + F.when(nc > 100, 100.0).otherwise(0.0) * 0.4
    issues = F.array_compact(F.array(F.when(miss_pct > 10, F.lit("High missing data in market series")),
                                     F.when(nc <= 100, F.lit("Limited customer data"))))
    return m.select("market_records", "start", "end", miss_pct.alias("market_missing_pct"),
                    nc.alias("customer_records"), nf.alias("flow_records"), score.alias("quality_score"),
                    issues.alias("issues"))


def segment_distribution(customers: DataFrame) -> DataFrame:
    return customers.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))


def rules_for(columns: Sequence[str]) -> dict:
    """Default rule set used in the checks of the customer table."""
    return {c: {"type": "not_null", "column": c} for c in columns}
