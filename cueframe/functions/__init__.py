"""Column functions over caption text and times; all are built-in expressions."""
