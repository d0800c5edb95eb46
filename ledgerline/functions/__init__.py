"""Column expressions over the bytes and text of records."""
