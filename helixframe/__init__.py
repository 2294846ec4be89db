"""Read-depth, allele-fraction and copy-number analytics on Spark DataFrames."""

__version__ = "0.2.0"
