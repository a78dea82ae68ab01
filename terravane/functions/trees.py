"""Oblivious trees and their ensembles as Columns over an array of features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ObliviousTree:
    """One split for each level; bit i of a leaf's number says whether split i's feature lies above its threshold."""

    features: tuple[int, ...]
    thresholds: tuple[float, ...]
    leaves: tuple[float, ...]

    def leaf(self, x: Column) -> Column:
        bits = [F.when(x[f] > F.lit(float(t)), F.lit(1 << i)).otherwise(F.lit(0)) for i, (f, t) in enumerate(zip(self.features, self.thresholds, strict=True))]
        out = F.lit(0)
        for b in bits:
            out = out + b
        return out

    def value(self, x: Column) -> Column:
        """Features that are null or missing count as not above."""
        return F.element_at(F.array(*[F.lit(float(v)) for v in self.leaves]), self.leaf(x) + 1)


@dataclass(frozen=True)
class Ensemble:
    trees: tuple[ObliviousTree, ...]
    step: float

    def staged(self, x: Column, raw_first: bool = False) -> Column:
        """Array of the scores after each tree. ``raw_first`` takes the first tree's value without the step."""
        out, total = [], F.lit(0.0)
        for i, tree in enumerate(self.trees):
            total = total + (tree.value(x) if raw_first and i == 0 else tree.value(x) * F.lit(self.step))
            out.append(total)
        return F.array(*out)

    def score(self, x: Column, raw_first: bool = False) -> Column:
        """The last of the staged scores, without building the array."""
        total = F.lit(0.0)
        for i, tree in enumerate(self.trees):
            total = total + (tree.value(x) if raw_first and i == 0 else tree.value(x) * F.lit(self.step))
        return total


def joined_numbers(x: Column) -> Column:
    """Array as text with spaces between."""
    return F.array_join(F.transform(x, lambda v: v.cast("string")), " ")


def feature_names(n: int) -> Sequence[str]:
    return [f"f{i}" for i in range(n)]
