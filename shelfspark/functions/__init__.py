"""Retail engine: functions."""
