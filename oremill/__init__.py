"""oremill: data mining over review-style tables, built on Spark DataFrames.

Every operator is a function from DataFrames and parameters to a DataFrame.
"""

__version__ = "0.1.0"
