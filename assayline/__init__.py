"""assayline: longitudinal measurement analytics on Spark DataFrames."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
