"""Recorder analytics on Spark: DataFrame operators over cell x tape x site tables."""

__version__ = "0.1.0"
