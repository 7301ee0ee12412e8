"""Thresholds that grow with the corpus."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ELIGIBLE = ("include", "maybe")


def eligible(label: str = "triage_label") -> Column:
    """Papers that count: labelled include or maybe."""
    return F.col(label).isin(*ELIGIBLE)


def stated(value: str) -> Column:
    """Neither null, empty nor 'unknown'."""
    return F.col(value).isNotNull() & ~F.col(value).cast("string").isin("", "unknown")


@dataclass(frozen=True)
class Thresholds:
    min_papers: int
    orphan_ratio: int
    min_row: int
    min_cluster: int
    min_external: int
    top: int

    @property
    def min_strength(self) -> int:
        """Shared citations that link two papers."""
        return max(2, math.floor(0.7 * self.min_papers + 0.5))


def pick_thresholds(n_papers: int) -> Thresholds:
    """Square-root rules, a linear one and a step, each within its bounds."""
    root = math.sqrt(max(1, n_papers))
    within = lambda x, lo, hi: max(lo, min(hi, math.floor(x + 0.5)))
    return Thresholds(
        min_papers=within(root / 5, 2, 8),
        orphan_ratio=within(root / 3, 3, 15),
        min_row=max(2, min(10, math.ceil(n_papers / 30))),
        min_cluster=within(root / 6, 2, 6),
        min_external=within(root / 4, 2, 8),
        top=25 if n_papers < 50 else 50 if n_papers < 500 else 100,
    )
