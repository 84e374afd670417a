"""The registered queries of the engine."""

from . import calls, cascades, details, governance, lifecycle, masking, results  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
