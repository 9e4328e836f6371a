"""All registered queries."""

from panelwright.plans import assurance, comparison, intake, movement  # noqa: F401
from panelwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
