"""All registered queries."""

from tabspark.catalog import cleaning, evaluation, modelling, profiling
from tabspark.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "evaluation", "modelling", "profiling"]
