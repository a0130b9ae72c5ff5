"""Scoring, checking, counting and row operators."""
