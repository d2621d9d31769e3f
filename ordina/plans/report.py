"""What a plan reads: columns and filters that reach the scan, and how many shuffles it has."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def text(df: DataFrame, mode: str = "formatted") -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def report(df: DataFrame) -> dict[str, list[str]]:
    """live: columns read; predicate: filters pushed down; operators: the physical operators, with exchanges."""
    plan = text(df)
    live = [c.split(":")[0] for s in re.findall(r"ReadSchema: struct<(.*)>", plan) for c in re.split(r",(?![^<]*>)", s) if c]
    pushed = [f for s in re.findall(r"PushedFilters: \[(.*)\]", plan) for f in re.split(r",\s*(?![^(]*\))", s) if f]
    return {"live": live, "predicate": pushed, "operators": re.findall(r"^\(\d+\) ([\w ]+)", plan, re.M)}
