"""Column functions: JSON, dates, ranges, text."""
