"""Gates as rows: gate, check_name, passed, rows_checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(gate: str, name: str, passed: Column) -> list[Column]:
    return [F.lit(gate).alias("gate"), F.lit(name).alias("check_name"), passed.alias("passed"), F.count("*").alias("rows_checked")]


def always(rows: DataFrame, gate: str, name: str, rule: Column) -> DataFrame:
    """Passed if no row breaks the rule; a row for which it is null doesn't, and an empty table passes."""
    return rows.agg(*_row(gate, name, F.coalesce(F.bool_and(rule), F.lit(True))))


def unique(rows: DataFrame, gate: str, column: str) -> DataFrame:
    """Passed if the column holds no null and no value twice."""
    counts = rows.groupBy(column).agg(F.count("*").alias("c"))
    single = F.coalesce(F.bool_and((F.col("c") == 1) & F.col(column).isNotNull()), F.lit(True))
    return counts.agg(
        F.lit(gate).alias("gate"), F.lit(f"{column} unique").alias("check_name"), single.alias("passed"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows_checked"),
    )


def report(gates: Sequence[DataFrame]) -> DataFrame:
    out = gates[0]
    for gate in gates[1:]:
        out = out.unionByName(gate)
    return out


def assert_passed(gates: DataFrame) -> None:
    """Raise if a gate failed; a report has a row for each check, so this collects few rows."""
    failed = gates.where("not passed").collect()
    if failed:
        raise ValueError("; ".join(f"{r['gate']}: {r['check_name']}" for r in failed))
