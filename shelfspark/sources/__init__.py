"""Retail engine: sources."""
