"""Report-audit analytics on Spark: every operator takes and returns DataFrames."""

__version__ = "0.1.0"
