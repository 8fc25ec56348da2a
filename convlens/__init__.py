"""convlens: trial-conversion analytics on Spark DataFrames.

Every public operator is a function from DataFrames to DataFrames.  Nothing is
collected to the driver except single aggregated rows (a p-value tail, a model
summary) and nothing is mutated in place.
"""

from convlens.columns import LogColumns, DEFAULT_COLUMNS

__all__ = ["LogColumns", "DEFAULT_COLUMNS"]
