"""Column expressions: flags and ranges, units, text, dates and clinical formulas."""
