"""Operators for preparing language-model training data.

Self-contained: nothing outside this subpackage imports it.  Each operator
module has a general interface; :mod:`fringeflow.llm.queries` binds the
operators to the synthetic tables.
"""
