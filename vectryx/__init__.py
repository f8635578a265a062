"""Vector, keyword and hybrid search over DataFrames, planned by Catalyst."""

__version__ = "0.1.0"
