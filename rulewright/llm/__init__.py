"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; ``queries`` holds the thin registered
queries.  Intermediate tables go to the folder named by ``spark.checkpoint.dir``.
"""
