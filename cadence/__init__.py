"""Cadence: speech-state analytics and corpus preparation on Spark DataFrames."""
