"""Listing intelligence as Spark jobs: collect, normalize, merge, match and report."""

__version__ = "0.1.0"
