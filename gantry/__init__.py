"""Gantry: a Spark-first feature engine for software binaries and training text."""
