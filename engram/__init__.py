"""engram: a semantic-memory and vector analytics engine on Spark DataFrames."""

__version__ = "0.1.0"
