"""Declared analytical tables on Spark: schemas, diffs, merge reads, time-chunked replay."""

__version__ = "0.2.0"
