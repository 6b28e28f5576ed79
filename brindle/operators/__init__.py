from brindle.operators.grouped import intersection, surplus, with_totals
from brindle.operators.joins import band_join, grid_join
from brindle.operators.ordered import ROWS_PER_SPLIT_SETTING, Frame, OrderedGroups
from brindle.operators.ranking import exact_quantiles, largest_per_group, rank_rows
from brindle.operators.timeline import (
    asof_join,
    count_in_intervals,
    sessions,
    trailing_sums,
)

__all__ = [
    "ROWS_PER_SPLIT_SETTING",
    "Frame",
    "OrderedGroups",
    "asof_join",
    "band_join",
    "count_in_intervals",
    "exact_quantiles",
    "grid_join",
    "intersection",
    "largest_per_group",
    "rank_rows",
    "sessions",
    "surplus",
    "trailing_sums",
    "with_totals",
]
