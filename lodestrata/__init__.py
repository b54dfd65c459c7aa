"""Spark-first analytics over source-code corpora, change logs and telemetry."""

__version__ = "0.1.0"
