"""Sinks of evaluation results."""
