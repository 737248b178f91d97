"""Registered queries over the driver's tables, each with SQL for the checking engine."""

from . import clinical, cox, describe, longitudinal, quality, scalar, survival, text  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
