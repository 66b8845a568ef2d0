"""Operators over DataFrames: joins, networks, closure, series, grids, rules, retention, diagnosis."""
