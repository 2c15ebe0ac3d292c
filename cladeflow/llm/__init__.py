"""Operators of a training-data pipeline: each works on whole tables and hands back a DataFrame."""
