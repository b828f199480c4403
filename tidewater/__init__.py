"""Tidewater: time series, retrieval, grid reporting and training-data operators on PySpark."""
