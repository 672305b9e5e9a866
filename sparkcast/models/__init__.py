"""Forecast models: Spark gathers the statistics, small solves run per series."""
