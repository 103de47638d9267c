"""Metrics and views composed from the operators."""
