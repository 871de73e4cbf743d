"""From overlapping candidates to kept spans."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from umbra.functions.shipping import ship
from umbra.schemas import NOT_OFFERED, SPANS


def without(spans: Column, disabled: list[str]) -> Column:
    """Drop disabled categories; they have seeded pass 2 by then."""
    return F.filter(spans, lambda s: ~s["category"].isin(disabled)) if disabled else spans


def keep_best(spans: Sequence[dict]) -> list[dict]:
    """Greedy: surest first, then longest, then earliest, then first emitted; keep what overlaps nothing kept; by start.

    Kept spans don't overlap, so a candidate need only be held against its two neighbours.
    """
    kept: list[tuple[int, int, int]] = []
    for n in sorted(range(len(spans)), key=lambda n: (-spans[n]["confidence"], -spans[n]["length"], spans[n]["start"], spans[n]["seq"])):
        lo, hi = spans[n]["start"], spans[n]["start"] + spans[n]["length"]
        at = bisect_left(kept, (lo,))
        if hi > lo and not (at and kept[at - 1][1] > lo) and not (at < len(kept) and kept[at][0] < hi):
            insort(kept, (lo, hi, n))
    return [spans[n] for _, _, n in kept]


def resolve(spans: Column) -> Column:
    """The spans of a page's array that ``keep_best`` keeps."""
    ship(SparkSession.active())

    @F.pandas_udf(SPANS)
    def kept(each: pd.Series) -> pd.Series:
        return pd.Series([keep_best(x) if x is not None else None for x in each])

    return kept(spans)


def accepted(category: Column, confidence: Column, threshold: float = 0.6) -> Column:
    """Whether a finding is offered as accepted."""
    return ~category.isin(*NOT_OFFERED) & (confidence >= threshold)
