"""tallyloom: a Spark-first engine for go-to-market context data."""

__version__ = "0.1.0"
