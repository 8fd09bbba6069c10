"""Spark-first analytics for bounded, order-aware dataflow and training-data preparation."""

__version__ = "0.1.0"
