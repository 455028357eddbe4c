"""Retail engine: streaming."""
