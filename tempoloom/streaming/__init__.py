"""Incremental insertion."""
