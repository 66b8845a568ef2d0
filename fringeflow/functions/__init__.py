"""Column expressions: phase, geometry, dates, text and hashes."""
