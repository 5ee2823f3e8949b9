"""Batch analytics of recurring events on a fixed grid, on Spark."""
