"""Column expressions: casts, bands, dates, text, intervals, formats."""
