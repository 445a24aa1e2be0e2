"""chronosift: temporal interval analytics and rule mining on Spark DataFrames."""

__version__ = "0.1.0"
