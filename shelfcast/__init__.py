"""Shelfcast: retail sales panels on Spark, from raw tables to forecasts."""
