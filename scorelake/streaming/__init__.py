"""Incremental, resumable runs."""
