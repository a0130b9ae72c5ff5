"""Evaluation analytics on Spark: load cases, score them, fold verdicts, aggregate and report."""
