"""Likeness of strings and greedy clustering of names."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        at[c] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths; two empty strings are 100."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def canonicalise(names: list[str], least: float = 88.0) -> dict[str, str]:
    """Each name's representative: names from the longest on, ties by text, join the representative most like them by
    sorted words if it is at least `least`, the earliest of equals, or become one. Only lengths that can reach `least`
    are compared."""
    heads: list[tuple[str, str]] = []
    out: dict[str, str] = {}
    for name in sorted(set(names), key=lambda x: (-len(x), x)):
        key = sorted_tokens(name)
        best, top = None, least
        for head, hk in heads:
            if 200.0 * min(len(key), len(hk)) >= top * (len(key) + len(hk)):
                r = indel_ratio(key, hk)
                if r > top or best is None and r >= top:
                    best, top = head, r
        if best is None:
            heads.append((name, key))
        out[name] = best or name
    return out


def canonical_names(names: DataFrame, group: str, least: float = 88.0) -> DataFrame:
    """(group, name, canonical) of the different non-null names of each group. The order of clustering is the result's
    definition, so that a group is one task; its different names are counted before."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        got = canonicalise(pdf["name"].tolist(), least)
        return pd.DataFrame({group: key[0], "name": list(got), "canonical": list(got.values())})

    return names.where(F.col("name").isNotNull() & F.col(group).isNotNull()).select(group, "name").distinct().groupBy(group).applyInPandas(run, f"{group} string, name string, canonical string")
