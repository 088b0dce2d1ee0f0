"""Relational and time-series operators composed from Spark's own."""

from larkspur.operators.intervals import overlap_counts, overlap_join
from larkspur.operators.joins import band_join, salted_join
from larkspur.operators.python_functions import Words, aggregate, reversed_words
from larkspur.operators.quantiles import quantiles
from larkspur.operators.ranking import global_rank, heavy_hitters, page
from larkspur.operators.split_windows import asof_join, fill_forward, running_sum, sessions
from larkspur.operators.timeseries import funnel, rollup
from larkspur.operators.vectors import nearest

__all__ = [
    "Words", "aggregate", "asof_join", "band_join", "fill_forward", "funnel", "global_rank", "heavy_hitters", "nearest", "overlap_counts", "overlap_join", "page",
    "quantiles", "reversed_words", "rollup", "running_sum", "salted_join", "sessions",
]
