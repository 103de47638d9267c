"""DataFrame -> DataFrame operators. All take column names and work on any table."""
