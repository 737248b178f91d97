"""Column expressions: missing-value logic, dates, thresholds, text recoding."""
