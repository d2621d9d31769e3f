"""Combinations and permutations of one gathered multiset, as a table function's rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def _combinations(counts: list[int], k: int) -> Iterator[list[int]]:
    """Numbers taken of each value, in the order in which the choices read as sequences."""
    if not counts:
        if k == 0:
            yield []
        return
    for n in range(min(counts[0], k), -1, -1):
        for rest in _combinations(counts[1:], k - n):
            yield [n, *rest]


def _permutations(counts: list[int], left: int) -> Iterator[list[int]]:
    if left == 0:
        yield []
        return
    for i, c in enumerate(counts):
        if c:
            counts[i] -= 1
            for rest in _permutations(counts, left - 1):
                yield [i, *rest]
            counts[i] += 1


def choose(one: DataFrame, what: str, k: int, kind: str, name: str) -> DataFrame:
    """(_pos, array) for the row's ``vs``: array of (v, n) in the order of first occurrence."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            for vs in frame["vs"]:
                values, counts = [v["v"] for v in vs], [int(v["n"]) for v in vs]
                if what == "c":
                    found = ([v for v, n in zip(values, own) for _ in range(n)] for own in _combinations(counts, k)) if 0 <= k <= sum(counts) else iter(())
                else:
                    found = ([values[i] for i in own] for own in _permutations(counts, sum(counts)))
                part: list = []
                for i, row in enumerate(found):
                    part.append((i, row))
                    if len(part) == 4096:
                        yield pd.DataFrame(part, columns=["_pos", name])
                        part = []
                yield pd.DataFrame(part, columns=["_pos", name])

    return one.mapInPandas(run, f"_pos bigint, {name} array<{kind}>")
