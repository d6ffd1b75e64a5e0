"""Registry of named queries: each maps ``(spark, sf_dir) -> DataFrame``
and may carry an independent DuckDB SQL text over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def _split_last_arg(text: str) -> tuple[str, str | None]:
    depth = 0
    for i in range(len(text) - 1, -1, -1):
        ch = text[i]
        if ch == ")":
            depth += 1
        elif ch == "(":
            depth -= 1
        elif ch == "," and depth == 0:
            return text[:i], text[i + 1:].strip()
    return text, None


def _plus_zero(sql: str) -> str:
    """Rewrite every ``round(x, d)`` as ``(round(round(x, 9), d) + 0.0)``:
    snapping to 9 decimals first removes summation-order noise so a value
    such as 658.04375 rounds alike in both engines, and IEEE addition turns
    -0.0 into +0.0 as Spark's decimal rounding does."""
    out, i = [], 0
    low = sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _plus_zero(sql[j + 6:k])
        expr, digits = _split_last_arg(inner)
        if digits is None:
            out.append(sql[i:j] + "(round(" + inner + ") + CAST(0 AS DOUBLE))")
        else:
            out.append(sql[i:j] + f"(round(round({expr}, 9), {digits}) + CAST(0 AS DOUBLE))")
        i = k + 1


def _snap_round_even(sql: str) -> str:
    """``round_even(x, d)`` -> ``round_even(round(x, 9), d)`` (the same
    9-decimal snap that ``np_round`` applies on the Spark side)."""
    out, i = [], 0
    low = sql.lower()
    key = "round_even("
    while True:
        j = low.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _snap_round_even(sql[j + len(key):k])
        expr, digits = _split_last_arg(inner)
        out.append(sql[i:j] + f"round_even(round({expr}, 9), {digits})")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = _plus_zero(_snap_round_even(sql))
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its registrations run."""
    from . import (q_clean, q_economics, q_evaluate, q_extra, q_features, q_flows, q_joins, q_misc, q_quality_reports,  # noqa: F401
                   q_risk,
                   q_scenarios, q_windows)
