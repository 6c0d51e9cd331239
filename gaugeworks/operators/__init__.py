"""Table operators: convert, validate, select ranges, join, aggregate, window, verify."""
