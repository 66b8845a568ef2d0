"""The operators bound to tables, with their SQL counterparts."""

from . import catalogue_plans, control_plans, diagnosis, grid_plans, network_plans, rule_plans, run_plans, scalar_plans, search_plans, series_plans, settings_plans, storage_plans, synthetic_plans, text_plans  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "network_pairs"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
