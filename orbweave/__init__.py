"""Analytics on Spark DataFrames: spherical harmonics, and operators for text corpora."""
