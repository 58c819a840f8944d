"""Spark-first analytics over daily market-session bars."""
