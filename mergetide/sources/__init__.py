"""Landed pages, the raw table, marks, page admission, and sinks."""
