"""Text reuse on Spark: segments, candidate generators, judges and evaluation as DataFrames."""
