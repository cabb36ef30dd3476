"""Filter, sort and index one wide table with Spark DataFrames."""

__version__ = "0.1.0"
