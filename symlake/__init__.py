"""Code-symbol analytics on Spark: symbol and dependency relations, queried with glob conditions."""

__version__ = "0.1.0"
