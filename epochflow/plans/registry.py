"""All queries of the library by name, with their SQL where SQL can express them."""

from epochflow.plans import analysis, contracts, live, models, relational, reports, screening, storage, streams  # noqa: F401
from epochflow.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
