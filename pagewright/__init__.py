"""Document analytics on Spark: page-structured text as DataFrames, declared for Catalyst and run at any size."""

__version__ = "0.1.0"
