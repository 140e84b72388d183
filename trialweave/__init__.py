"""Event-aligned multichannel time-series analytics on Spark DataFrames."""

__version__ = "0.1.0"
