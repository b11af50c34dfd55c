"""Dose queries under structures, on whichever grids the two are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.operators import dose, sampling
from voxelmill.operators.grid import Grid


@dataclass(frozen=True)
class DoseQuery:
    """A dose field (k, r, c, v) on its grid, and how structures see it.

    ``supersample``: None samples the centre of each voxel of a structure (the dose is resampled to
    the structure's grid, unless that is the same); 2 to 4 samples so many sub-centres per axis.
    Every result carries a ``method`` struct. Structures without voxels give no row. A grid that the
    dose was resampled to is kept (in memory and on disk, until ``release``) for the next question.
    """

    field: DataFrame
    grid: Grid
    method: str = "trilinear"
    supersample: int | None = None
    _kept: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        if self.supersample is not None and self.supersample not in (2, 3, 4):
            raise ValueError("supersampling is from 2 to 4 parts")
        if self.method not in ("trilinear", "nearest"):
            raise ValueError(f"unknown method {self.method}")

    @property
    def parts(self) -> int:
        return (self.supersample or 1) ** 3

    def samples(self, masks: DataFrame, grid: Grid) -> tuple[DataFrame, bool]:
        """mask_id, v, vol under each mask, and whether the dose was resampled."""
        if self.supersample:
            return sampling.supersample(self.field, self.grid, masks, grid, self.supersample), False
        if grid not in self._kept:
            out, resampled = sampling.field_on(self.field, self.grid, grid, method=self.method)
            self._kept[grid] = (out.persist() if resampled else out, resampled)
        out, resampled = self._kept[grid]
        return dose.samples(out, masks, grid), resampled

    def release(self) -> None:
        """Drop the resampled fields."""
        for out, resampled in self._kept.values():
            if resampled:
                out.unpersist()
        self._kept.clear()

    def _tagged(self, out: DataFrame, resampled: bool) -> DataFrame:
        return out.withColumn("method", dose.method_tag("supersample" if self.supersample else "whole", self.supersample or 1, resampled))

    def statistics(self, masks: DataFrame, grid: Grid) -> DataFrame:
        rows, resampled = self.samples(masks, grid)
        return self._tagged(dose.statistics(rows, self.parts), resampled)

    def dose_at(self, percents: list[float], masks: DataFrame, grid: Grid) -> DataFrame:
        """mask_id, percent, value: the dose that at least this share of the structure gets."""
        if not all(0 <= p <= 100 for p in percents):
            raise ValueError("percents are from 0 to 100")
        rows, resampled = self.samples(masks, grid)
        out = dose.value_at(rows, [p / 100 for p in percents])
        return self._tagged(out.select("mask_id", (F.col("fraction") * 100).alias("percent"), "value"), resampled)

    def volume_at(self, doses: list[float], masks: DataFrame, grid: Grid) -> DataFrame:
        """mask_id, threshold, vol and fraction that get at least each dose."""
        rows, resampled = self.samples(masks, grid)
        return self._tagged(dose.sensitivity(rows, doses), resampled)

    def histogram(self, masks: DataFrame, grid: Grid, bins: int = 256) -> DataFrame:
        """The cumulative histogram of each structure."""
        if not isinstance(bins, int) or bins <= 0:
            raise ValueError("bins are a positive integer")
        rows, resampled = self.samples(masks, grid)
        return self._tagged(dose.cumulative_dvh(rows, bins, by_width=bool(self.supersample)), resampled)

    def sample(self, points: DataFrame) -> DataFrame:
        """The dose at points (point_id, x, y, z), 0 outside."""
        return sampling.sample(points, self.field, self.grid, method=self.method)
