"""Spark-first analytics over exchange order, trade and snapshot tables."""
