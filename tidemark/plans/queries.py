"""All registered queries of the reference's operators."""

from tidemark.plans import book_queries, factor_queries, pit_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
