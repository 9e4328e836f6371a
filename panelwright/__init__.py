"""Indicator-panel analytics on Spark.

Every operator is a plain function over DataFrames keyed
``(indicator_key, place_id, period)`` and handles all indicators of a panel at once.
"""
