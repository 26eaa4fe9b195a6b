"""Scalar-field topology analytics and table-scale data processing on Spark."""

__version__ = "0.1.0"
