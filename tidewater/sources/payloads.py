"""JSON payload parsing (S7-S13) as column expressions over text columns.

The HTTP clients are not part of this library: payloads arrive as text in
a table (one document per row) and are parsed with ``from_json`` +
``explode``; bad values become NULL with ``try_cast``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRED = T.StructType([T.StructField("observations", T.ArrayType(T.StructType([
    T.StructField("date", T.StringType()), T.StructField("value", T.StringType())])))])

TREASURY = T.StructType([T.StructField("data", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])

ECB = T.StructType([
    T.StructField("dataSets", T.ArrayType(T.StructType([
        T.StructField("observations", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))]))),
    T.StructField("structure", T.StructType([T.StructField("dimensions", T.StructType([
        T.StructField("observation", T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("values", T.ArrayType(T.StructType([T.StructField("id", T.StringType())])))])))]))]))])


def fred_observations(df: DataFrame, text_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Observations -> (date, value); '.' and other non-numbers dropped."""
    obs = df.select(*keys, F.explode(F.from_json(text_col, FRED)["observations"]).alias("o"))
    return (obs.select(*keys, F.to_date(F.col("o.date")).alias("date"),
                       F.col("o.value").try_cast("double").alias("value"))
               .where(F.col("value").isNotNull()))


def treasury_records(df: DataFrame, text_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """data[] -> one row per record with record_date parsed."""
    rec = df.select(*keys, F.explode(F.from_json(text_col, TREASURY)["data"]).alias("r"))
    return rec.select(*keys, F.to_date(F.col("r")["record_date"]).alias("record_date"), "r")


def ecb_observations(df: DataFrame, text_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Observation map key -> index before the first ':' -> TIME_PERIOD
    value at that position; out-of-range indices are skipped."""
    j = F.from_json(text_col, ECB)
    obs = j["dataSets"][0]["observations"]
    dims = j["structure"]["dimensions"]["observation"]
    tp = F.filter(dims, lambda d: d["id"] == "TIME_PERIOD")[0]["values"]
    x = df.select(*keys, tp.alias("tp"), F.explode(obs).alias("k", "v"))
    idx = F.split(F.col("k"), ":")[0].try_cast("int")
    period = F.try_element_at(F.col("tp"), idx + 1)["id"]
    return (x.select(*keys, period.alias("period"), F.col("v")[0].alias("value"))
             .where(F.col("period").isNotNull()))


def generic_records(df: DataFrame, text_col: str, numeric: Sequence[str], date_field: str = "date",
                    keys: Sequence[str] = ()) -> DataFrame:
    """data[] of flat objects; date parsed, listed fields numeric-coerced."""
    arr = F.from_json(text_col, T.StructType([T.StructField("data", T.ArrayType(
        T.MapType(T.StringType(), T.StringType())))]))["data"]
    r = df.select(*keys, F.explode(arr).alias("r"))
    return r.select(*keys, F.to_date(F.col("r")[date_field]).alias(date_field),
                    *[F.col("r")[c].try_cast("double").alias(c) for c in numeric])


def flat_json_numbers(df: DataFrame, text_col: str, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """S10 for one flat object per row: listed fields coerced to double."""
    m = F.from_json(text_col, T.MapType(T.StringType(), T.StringType()))
    return df.select(*keys, *[m[c].try_cast("double").alias(c) for c in fields])


def validate_response(df: DataFrame, text_col: str, required: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """All required top-level keys present (per payload row)."""
    m = F.from_json(text_col, T.MapType(T.StringType(), T.StringType()))
    ok = F.lit(True)
    for r in required:
        ok = ok & F.coalesce(F.map_contains_key(m, r), F.lit(False))
    return df.select(*keys, ok.alias("valid"))


def api_usage_stats(calls: DataFrame, ts: str = "timestamp", success: str = "success",
                    response_time: str = "response_time") -> DataFrame:
    """Totals, success rate, calls per hour over the observed span,
    mean of non-zero response times rounded to 2 (one aggregation)."""
    hours = (F.max(ts).cast("double") - F.min(ts).cast("double")) / 3600
    n = F.count(F.lit(1))
    ok = F.count(F.when(F.col(success), 1))
    rt = F.col(response_time)
    return calls.agg(n.alias("total_calls"), ok.alias("successful_calls"), (n - ok).alias("failed_calls"),
                     (ok / n).alias("success_rate"), hours.alias("time_range_hours"),
                     F.when(hours > 0, n / hours).otherwise(0.0).alias("calls_per_hour"),
                     F.round(F.coalesce(F.avg(F.when((rt != 0) & rt.isNotNull(), rt)), F.lit(0.0)), 2)
                     .alias("avg_response_time_ms"))


def wide_from_series(long: DataFrame, names: Sequence[str], date_col: str = "date") -> DataFrame:
    """(date, series, value) -> one column per series (explicit list),
    forward filled over dates (one row per day: calendar bounded)."""
    from ..operators import windows as W
    wide = long.groupBy(date_col).pivot("series", list(names)).agg(F.first("value", ignorenulls=True))
    return W.forward_fill(wide, list(names), [date_col])
