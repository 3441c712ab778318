"""Dense N-dimensional array streams as Spark DataFrames."""

__version__ = "0.1.0"
