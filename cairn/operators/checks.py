"""Integrity checks as rows, and reshapes of wide tables.

A check is a one-row aggregate ``(contract, check_name, passed, detail)``; a check log is their union, so a whole suite is one
job. ``require`` is the fail-closed end: it raises if any row failed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailure(ValueError):
    pass


def check(table: DataFrame, contract: str, name: str, violations: Column) -> DataFrame:
    """``violations``: an aggregate that counts what is wrong; zero passes, and an empty table has none."""
    n = F.coalesce(violations, F.lit(0)).cast("bigint")
    return table.agg(n.alias("violations")).select(F.lit(contract).alias("contract"), F.lit(name).alias("check_name"), (F.col("violations") == 0).alias("passed"), "violations")


def unique(table: DataFrame, contract: str, name: str, keys: Sequence[str]) -> DataFrame:
    return check(table, contract, name, F.count("*") - F.count_distinct(F.struct(*keys)))


def no_orphans(child: DataFrame, parent: DataFrame, contract: str, name: str, key: str, parent_key: str) -> DataFrame:
    orphans = child.join(parent.select(F.col(parent_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    return check(orphans, contract, name, F.count("*"))


def disjoint(a: DataFrame, b: DataFrame, contract: str, name: str, keys: Sequence[str]) -> DataFrame:
    return check(a.select(*keys).intersect(b.select(*keys)), contract, name, F.count("*"))


def one_value(table: DataFrame, contract: str, name: str, key: str, value: str) -> DataFrame:
    """Each key has a single value."""
    return check(table.groupBy(key).agg(F.count_distinct(value).alias("n")), contract, name, F.count_if(F.col("n") > 1))


def increasing(table: DataFrame, contract: str, name: str, key: str, order: str, value: str) -> DataFrame:
    from cairn.operators.ordered import ordered

    step = F.col(value) - F.lag(value).over(ordered(key, order))
    return check(table.select(step.alias("step")), contract, name, F.count_if(F.col("step") <= 0))


def log(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame) -> None:
    """Raises on any failed check, with the first few names."""
    failed = [f"{r.contract}/{r.check_name} ({r.violations})" for r in checks.where("not passed").orderBy("contract", "check_name").limit(20).collect()]
    if failed:
        raise CheckFailure("; ".join(failed))
