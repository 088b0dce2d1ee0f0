"""Spark-first analytics engine: relational, time-series, streaming and corpus operators."""
