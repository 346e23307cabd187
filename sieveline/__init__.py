"""sieveline: a Spark-first engine that finds secrets in text at corpus scale."""

__version__ = "0.1.0"
