"""Ranked subsequence ("fuzzy") matching as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def subsequence_score(label: Column, needle: str) -> Column:
    """Lower is better, null when the needle's characters don't occur in order; an empty needle scores 0.

    The cost adds the offset of the first match to the gaps between matches. That sum telescopes to
    where the leftmost-greedy match ends, so one lazy regex gives it. Null labels score null.
    """
    n = needle.lower()
    if not n:
        return F.when(label.isNotNull(), F.lit(0))
    pattern = "(?s)^" + "".join(".*?" + re.escape(c) for c in n)
    low = F.lower(label)
    return F.when(low.rlike(pattern), F.length(F.regexp_extract(low, pattern, 0)) - F.lit(len(n)))


def subsequence_score_col(label: Column, needle: Column) -> Column:
    """The same score for a needle in a column, folded with locate(); it runs without a cross join of patterns."""
    low, want = F.lower(label), F.lower(needle)

    def step(at: Column, ch: Column) -> Column:
        # at: 1-based place of the last match, 0 before the first, -1 after a miss
        hit = F.call_function("locate", ch, low, at + 1)
        return F.when(at < 0, F.lit(-1)).when(hit > 0, hit).otherwise(F.lit(-1))

    end = F.aggregate(F.split(want, ""), F.lit(0), step)
    return (
        F.when(label.isNull() | needle.isNull(), F.lit(None).cast("int"))
        .when(want == "", F.lit(0))
        .when(end > 0, end - F.length(want))
    )
