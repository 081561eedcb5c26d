"""quarry: retrieval and corpus analytics as lazily planned Spark DataFrames."""

__version__ = "0.2.0"
