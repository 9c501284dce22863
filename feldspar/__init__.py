"""Implicit-geometry and spatial-proximity analytics on PySpark DataFrames."""
