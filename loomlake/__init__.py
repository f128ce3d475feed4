"""loomlake: query-by-example similarity analytics and catalog maintenance as Spark DataFrame plans."""

__version__ = "0.1.0"
