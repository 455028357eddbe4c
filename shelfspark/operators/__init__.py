"""Retail engine: operators."""
