"""All registered queries."""

from . import explore, forecast, prepare  # noqa: F401  (importing registers the queries)
from .register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
