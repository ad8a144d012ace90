"""Column builders: calendar, classes, tolerant casts, map projection."""
