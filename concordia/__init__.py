"""Concordia: evidence reconciliation and training-data preparation as Spark DataFrames."""
