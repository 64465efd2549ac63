"""Options of table detection and of merging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

# The thresholds of table detection, in points unless said otherwise.
Y_TOLERANCE, WRAP_TOLERANCE, MIN_COLUMNS, MIN_GAP = 2.0, 15.0, 3, 10.0
WRAP_REACH, GAP_CLUSTER, ANCHOR_CLUSTER, ANCHOR_SHARE = 30.0, 5.0, 5.0, 0.15
HEADER_BYTES, COLUMN_SPACING, MAX_ANCHORS, SAME_HEADER = 30, 20.0, 10, 1.0
TUNE_MERGE_GAPS, TUNE_ROW_GAPS = (0.0, 12.0, 16.0, 20.0), (0.0, 25.0, 35.0, 50.0)


@dataclass(frozen=True)
class TableOpts:
    """headers: texts that a header row holds; row_filter: a predicate over the array ``cells``; gaps of 0 are off;
    a wrap_tolerance below 0 turns wrapped headers off, other values of 0 or less mean the default."""

    headers: tuple[str, ...] = ()
    y_tolerance: float = 0.0
    wrap_tolerance: float = 0.0
    min_columns: int = 0
    min_gap: float = 0.0
    merge_gap: float = 0.0
    max_row_gap: float = 0.0
    row_filter: Column | None = None
    anchor_column: str = ""
    require_any_column: tuple[str, ...] = ()
    auto_tune: bool = False

    @property
    def y_tol(self) -> float:
        return self.y_tolerance if self.y_tolerance > 0 else Y_TOLERANCE

    @property
    def wrap_tol(self) -> float:
        return self.wrap_tolerance if self.wrap_tolerance > 0 else 0.0 if self.wrap_tolerance < 0 else WRAP_TOLERANCE

    @property
    def columns_at_least(self) -> int:
        return self.min_columns if self.min_columns > 0 else MIN_COLUMNS

    @property
    def gap_over(self) -> float:
        return self.min_gap if self.min_gap > 0 else MIN_GAP


@dataclass(frozen=True)
class MergeOptions:
    """max_size 0: no limit; policy: fail, truncate or shrink."""

    max_size: int = 0
    policy: str = "fail"
