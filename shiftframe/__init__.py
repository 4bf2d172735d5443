"""Leak-proof forecasting benchmarks on networked sensor data, as Spark DataFrame plans."""

__version__ = "0.1.0"
