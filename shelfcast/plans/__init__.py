"""Compositions of operators: preprocessing, features, training, forecasts."""
