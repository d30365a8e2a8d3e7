"""Tidemark: company-report and market-trend analytics as PySpark jobs."""

__version__ = "0.1.0"
