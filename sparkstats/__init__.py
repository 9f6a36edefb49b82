"""Table-in / table-out statistical operators on Spark DataFrames.

Every pass over rows is a Spark aggregate, join or window; only small
feature-by-feature matrices (p x p) and k-row group tables reach the driver.
"""

__version__ = "0.1.0"
